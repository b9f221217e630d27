"""A packed R-tree over whole-number vectors, searched by inner product.

Vectors are packed by sort-tile-recursive slabs along the coordinates that vary
most; a leaf and the nodes above it hold one label. For an anchor, each
coordinate of a node's box bounds its share of the inner product, so the box
bounds the scores of all members. A best-first queue opens nodes by the highest
score they can still add to a window; a node is passed over where its scores lie
outside all windows, strictly below the last score kept, or equal to it with
larger ids only.

Scores are exact: in doubles while no product can leave 53 bits, else in longs.
"""

from __future__ import annotations

import heapq
import io

import numpy as np

LEAF = 64
FANOUT = 16
#: Bounds of a window without bounds.
ANY = (-(2**62), 2**62)


def tiles(rows: np.ndarray, index: np.ndarray, dims: np.ndarray) -> list[np.ndarray]:
    """The index cut into leaves, near rows together."""
    leaves = -(-len(index) // LEAF)
    if leaves <= 1:
        return [index]
    slabs = max(2, int(np.ceil(leaves ** (1 / len(dims)))))
    size = -(-leaves // slabs) * LEAF
    sorted_ = index[np.argsort(rows[index, dims[0]], kind="stable")]
    return [t for i in range(0, len(index), size) for t in tiles(rows, sorted_[i : i + size], np.roll(dims, -1))]


class Tree:
    """Rows in packed order, and nodes level by level: the leaves first."""

    FIELDS = ("rows", "ids", "marks", "first", "last", "low", "high", "least", "label", "leaves")

    def __init__(self, rows: np.ndarray, ids: np.ndarray, marks: np.ndarray, labels: np.ndarray):
        dims = np.argsort(-rows.var(axis=0), kind="stable")
        parts, of_part = [], []
        for label in np.unique(labels):
            mine = np.flatnonzero(labels == label)
            # Copies stand in the order of their ids.
            packed = tiles(rows, mine[np.lexsort((marks[mine], ids[mine]))], dims)
            parts += packed
            of_part += [label] * len(packed)
        order = np.concatenate(parts)
        self.rows, self.ids, self.marks = rows[order], ids[order], marks[order]
        ends = np.cumsum([len(p) for p in parts])
        first, last, label = ends - [len(p) for p in parts], ends, np.array(of_part)
        low, high = np.minimum.reduceat(self.rows, first), np.maximum.reduceat(self.rows, first)
        least = np.minimum.reduceat(self.ids, first)
        levels, base = [(first, last, low, high, least, label)], 0
        while len(np.unique(levels[-1][5])) < len(levels[-1][5]):
            _, _, low, high, least, label = levels[-1]
            place = np.arange(len(label)) - np.searchsorted(label, label)
            first = np.flatnonzero(place % FANOUT == 0)
            last = np.append(first[1:], len(label))
            up = (first + base, last + base, np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.minimum.reduceat(least, first), label[first])
            base += len(label)
            levels.append(up)
        self.first, self.last, self.low, self.high, self.least, self.label = (np.concatenate(x) for x in zip(*levels))
        self.leaves = np.array(len(parts))
        self._ready()

    def _ready(self) -> None:
        self.largest = int(np.abs(self.rows).max(initial=0))
        # The top level has one node per label.
        top = np.unique(self.label)
        self.roots = np.arange(len(self.label) - len(top), len(self.label))
        self.as_kind = {}

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f).astype(np.int32) if f in ("rows", "low", "high") else getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Tree:
        self = cls.__new__(cls)
        with np.load(io.BytesIO(raw)) as held:
            for f in cls.FIELDS:
                setattr(self, f, held[f])
        self._ready()
        return self

    def _of_kind(self, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if kind not in self.as_kind:
            self.as_kind[kind] = tuple(x.astype(kind) for x in (self.rows, self.low, self.high))
        return self.as_kind[kind]

    def best(
        self, anchor: np.ndarray, label: int, same: bool, windows: list[tuple[int, int]], take: int, skip: tuple[int, int] | None = None
    ) -> list[list[tuple[int, int, int]]]:
        """For each window the first ``take`` (score, id, mark) of rows of the label, or of all others.

        Higher scores come first, then smaller ids, then smaller marks; the row ``skip`` (id, mark) is left out.
        """
        small = self.largest * int(np.abs(anchor).max(initial=0)) * max(1, len(anchor)) < 2**53
        kind = np.float64 if small else np.int64
        rows, low, high = self._of_kind(kind)
        anchor = anchor.astype(kind)
        plus, minus = np.maximum(anchor, 0), np.minimum(anchor, 0)
        bottom, top = (np.array(x, kind) for x in zip(*windows))
        last_score = np.full(len(windows), ANY[0] - 1, kind)
        last_id = np.full(len(windows), np.iinfo(np.int64).max)
        found: list[list[tuple[int, int, int]]] = [[] for _ in windows]
        queue: list[tuple] = []

        def open_windows(most, least, smallest):
            """The score a box can reach in each window, and whether that still matters."""
            reach = np.minimum(most, top)
            inside = (most >= bottom) & (least <= top)
            return reach, inside & ((reach > last_score) | ((reach == last_score) & (smallest <= last_id)))

        def push(nodes):
            most = high[nodes] @ plus + low[nodes] @ minus
            least = low[nodes] @ plus + high[nodes] @ minus
            smallest = self.least[nodes]
            reach, useful = open_windows(most[:, None], least[:, None], smallest[:, None])
            some = np.flatnonzero(useful.any(axis=1))
            key = np.where(useful, reach, ANY[0] - 1).max(axis=1)
            for i in some.tolist():
                heapq.heappush(queue, (-key[i], smallest[i], nodes[i], most[i], least[i]))

        push(self.roots[(self.label[self.roots] == label) == same])
        while queue:
            _, smallest, node, most, least = heapq.heappop(queue)
            _, useful = open_windows(most, least, smallest)
            if not useful.any():
                continue
            a, b = self.first[node], self.last[node]
            if node >= self.leaves:
                push(np.arange(a, b))
                continue
            score = rows[a:b] @ anchor
            for w in np.flatnonzero(useful).tolist():
                hits = np.flatnonzero((score >= max(bottom[w], last_score[w])) & (score <= top[w]))
                if not len(hits):
                    continue
                at = (hits + a).tolist()
                new = [(-int(s), int(self.ids[i]), int(self.marks[i])) for s, i in zip(score[hits], at)]
                kept = sorted(found[w] + [x for x in new if x[1:] != skip])[:take]
                found[w] = kept
                if len(kept) == take:
                    last_score[w], last_id[w] = -kept[-1][0], kept[-1][1]
        return [[(-s, i, m) for s, i, m in kept] for kept in found]
