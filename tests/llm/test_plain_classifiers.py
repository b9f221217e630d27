"""The toxicity and language classifiers against plain versions, text by text."""

import math
import re
import unicodedata
import zlib
from collections import Counter
from functools import cache

import numpy as np

from epifold.llm import language, toxicity, words
from epifold.llm.q_language import op7_language
from epifold.llm.q_toxicity import op2_toxicity

SMALL = "/root/testdata/sf0.001"


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ------------------------------------------------------------------------------- toxicity


def features(text):
    """Words and word beginnings of a text, as (length or 0, bytes)."""
    low = re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode())
    tokens = re.findall(rb"[0-9a-z\x80-\xff]+", low)
    return {(k, t[:k] if k else t) for t in tokens for k in (0, *toxicity.PREFIXES)}


@cache
def hashed(feature):
    size, raw = feature
    data = np.frombuffer(raw, np.uint8)
    value = words.hash_spans(data, np.array([0]), np.array([len(raw)]))
    return int((words.mix(value + np.uint64(size)) if size else value)[0])


def plain_fit(positive, unlabelled, size, prior, steps=800, rate=0.1, sparse=3e-5):
    """The non-negative risk on dense rows; the gradient follows from the losses of each row."""
    p, u = np.zeros((len(positive), size + 1)), np.zeros((len(unlabelled), size + 1))
    for dense, rows in ((p, positive), (u, unlabelled)):
        dense[:, size] = 1
        for k, row in enumerate(rows):
            dense[k, row] = 1
    w, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        loss = lambda rows: np.mean(np.log1p(np.exp(rows @ w)))
        slope = lambda rows: rows.T @ (1 / (1 + np.exp(-(rows @ w)))) / len(rows)
        negative = loss(u) - prior * loss(p)
        if negative >= 0:
            gradient = prior * (slope(p) - p.mean(axis=0)) + slope(u) - prior * slope(p)
        else:
            gradient = -(slope(u) - prior * slope(p))
        gradient[:size] += sparse * np.tanh(20 * w[:size])
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:size], w[size]


def test_toxicity_equals_a_plain_version(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    kept = [(i, features(t)) for i, t in docs if zlib.crc32(str(i).encode()) % 3 != 1]
    label = {r.doc_id: r.toxic for r in table(spark, sf_dir, "labels").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    share = np.mean([v == 1 for v in label.values()])
    positive = [f for i, f in kept if label.get(i) == 1]
    n, everywhere = Counter(x for f in positive for x in f), Counter(x for _, f in kept for x in f)
    gain = {}
    for x, c in n.items():
        purity = share * ((c - math.sqrt(c)) / len(positive)) / (everywhere[x] / len(kept))
        if c >= toxicity.SUPPORT and purity >= toxicity.PURITY and purity > share:
            gain[hashed(x)] = c * math.log(purity / share)
    hashes, weight, bias = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    assert 0 < len(gain) < toxicity.FEATURES and sorted(gain) == hashes.tolist()
    place = {h: k for k, h in enumerate(hashes.tolist())}
    rows = [([place[h] for h in map(hashed, f) if h in place], label.get(i) == 1) for i, f in kept]
    w, b = plain_fit([r for r, toxic in rows if toxic], [r for r, _ in rows], len(hashes), share)
    assert np.abs(w - weight).max() < 1e-6 and abs(b - bias) < 1e-6
    got = {r.doc_id: r for r in op2_toxicity(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        total = b + sum(w[place[h]] for h in map(hashed, features(text)) if h in place)
        assert abs(got[i].score - 1 / (1 + math.exp(-total))) < 1e-6
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i].predicted == (got[i].score >= 0.7)


# ------------------------------------------------------------------------------- language


def letter(code):
    bits = np.random.Generator(np.random.PCG64(code + 1)).integers(0, 2, language.DIMENSIONS, dtype=np.int8)
    return 2 * bits.astype(int) - 1


LETTERS: dict[int, np.ndarray] = {}


def profile(text):
    codes = []
    for c in text or "":
        low = c.lower()[0]
        codes.append(ord(low) if unicodedata.category(low).startswith("L") else 0)
    line = [0]
    for c in [*codes, 0]:
        if c or line[-1]:
            line.append(c)
    total = np.zeros(language.DIMENSIONS)
    for run, times in Counter(zip(line, line[1:], line[2:])).items():
        if run[1]:
            a, b, c = (LETTERS.setdefault(x, letter(x)) for x in run)
            total += times * (np.roll(a, 2) * np.roll(b, 1) * c)
    return total


def test_language_equals_a_plain_version(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in table(spark, SMALL, "documents").collect()]
    vectors = {i: profile(t) for i, t, _ in docs}
    unit = {i: v / np.linalg.norm(v) for i, v in vectors.items() if v.any()}
    tags = sorted({t for _, _, t in docs if t is not None})
    sums = {t: sum((unit[i] for i, _, x in docs if x == t and i in unit and zlib.crc32(str(i).encode()) % 3 != 1), np.zeros(language.DIMENSIONS)) for t in tags}
    known = [t for t in tags if sums[t].any()]
    got = {r.doc_id: r for r in op7_language(spark, SMALL).collect()}
    assert len(got) == len(docs) and len(known) > 2
    for i, *_ in docs:
        if i not in unit:
            assert (got[i].lang_pred, got[i].score) == (language.UNKNOWN, 0.0)
            continue
        cosine = {t: float(unit[i] @ sums[t] / np.linalg.norm(sums[t])) for t in known}
        best = max(known, key=cosine.get)
        assert got[i].lang_pred == best and abs(got[i].score - max(0.0, cosine[best])) < 1e-4
