"""Plain versions of the operators for small tables."""

import re
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def shingles(text, size):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near_duplicates(rows, size, percent):
    """Rows (doc_id, text); those without an id stand alone."""
    known = [(i, shingles(t, size)) for i, t in rows]
    real = [(i, s) for i, s in known if i is not None]
    union = Union({i for i, _ in real})
    for k, (i, a) in enumerate(real):
        for j, b in real[:k]:
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                union.join(i, j)
    out = []
    for i, s in known:
        root = None if i is None else union.find(i)
        out.append((i, len(s), root, i is None or root == i))
    return sorted(out, key=str)


def without_repeats(rows, length):
    """(doc_id, bytes, removed, spans, what remains) per row (doc_id, text)."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        starts = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), starts, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=str)
