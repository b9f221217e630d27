import re
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from epifold.llm import boosting, words

RNG = np.random.default_rng(21)


def statistics(text):
    """The statistics of one text, letter by letter."""
    raw = (text or "").encode()
    w = brute.words(text)
    lines = (text or "").split("\n")
    real = [x for x in lines if brute.words(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    per_word, per_byte = max(len(w), 1), max(len(raw), 1)
    shape = [
        np.log1p(len(raw)),
        np.log1p(len(w)),
        sum(map(len, w)) / per_word,
        np.log1p(max((len(x.encode()) for x in w), default=0)),
        sum(c in "#*$%&|<>" for c in text or "") / per_word,
        (len(real) - len(set(real))) / len(lines),
        len(covered) / per_word,
        len(set(w)) / per_word,
        len(w) / len(lines),
        sum(bool(re.match("[A-Z]", x)) for x in w) / per_word,
    ]
    named = [sum(chr(b) in signs for b in raw if b < 128) for signs in boosting.KINDS.values()]
    beyond = sum(b >= 128 for b in raw)
    return [*shape, *(c / per_byte for c in [*named, len(raw) - sum(named) - beyond, beyond])]


def test_statistics_equal_a_plain_count():
    texts = ["", None, "One two\nONE two\n\none!! | <b> #$ 12 ê中", "a b c d e " * 4, "x" * 5000, "\n \t", "Same line\nSame line\nother/\\\"q\""]
    batch = pa.record_batch({"text": pa.array(texts)})
    for i, j, data, offsets in words.text_blocks(batch, "text"):
        got = boosting.statistics_of(data, offsets)
        assert (i, j) == (0, len(texts)) and got.shape == (len(texts), len(boosting.STATISTICS))
        assert np.allclose(got, [statistics(t) for t in texts], rtol=1e-12)


def walk(forest, tree, row):
    node, inner = 0, forest.feature.shape[1]
    while node < inner:
        node = 2 * node + 1 + bool(row[forest.feature[tree, node]] > forest.cut[tree, node])
    return forest.leaf[tree, node - inner]


def test_flat_trees_equal_a_walk_and_learn_an_interaction():
    x = RNG.normal(size=(6000, 5)).round(2)
    y = ((x[:, 1] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    forest = boosting.grow(x[:4000], y[:4000], trees=30)
    got = forest.scores(x[4000:])
    assert ((got > 0.5) == y[4000:]).mean() > 0.97
    for row, s in zip(x[4000:4050], got):
        total = forest.start + sum(walk(forest, t, row) for t in range(30))
        assert abs(s - 1 / (1 + np.exp(-total))) < 1e-12


def test_first_split_is_the_best_of_all():
    x, y = RNG.integers(0, 30, (300, 3)).astype(float), RNG.integers(0, 2, 300).astype(float)
    y[x[:, 2] > 11] = 1
    forest = boosting.grow(x, y, trees=1, depth=1)
    p = y.mean()
    g, h = p - y, np.full(300, p * (1 - p))

    def part(mask):
        return g[mask].sum() ** 2 / (h[mask].sum() + boosting.PENALTY)

    best = max((part(x[:, f] <= c) + part(x[:, f] > c), f, c) for f in range(3) for c in range(29) if min((x[:, f] <= c).sum(), (x[:, f] > c).sum()) * p * (1 - p) >= 2)
    assert (forest.feature[0, 0], forest.cut[0, 0]) == best[1:]
    right = x[:, best[1]] > best[2]
    assert np.allclose(forest.leaf[0], [-boosting.RATE * g[m].sum() / (h[m].sum() + boosting.PENALTY) for m in (~right, right)])


@pytest.fixture(scope="module")
def tables(spark, frame):
    def text(good):
        w = [f"w{k}" for k in RNG.integers(0, 900, int(RNG.integers(20, 80)))]
        return " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)

    kind = [i % 5 != 0 for i in range(1000)]
    docs = frame([(i, text(k), "en", "s", 1) for i, k in enumerate(kind)] + [(2000, None), (2001, ""), (None, "W1!! W2!!"), (3, "w1 w2")])
    labels = spark.createDataFrame(
        [(i, int(k), 0) for i, k in enumerate(kind)] + [(None, 1, 1), (9999, None, 0), (9998, 0, 0), (9998, 1, 0), (11, 7, 0)], "doc_id long, quality int, toxic int"
    )
    return docs, labels, kind


def test_held_out_documents_are_told_apart(tables):
    docs, labels, kind = tables
    forest = boosting.train(docs, labels, trees=20)
    rows = boosting.scored(docs, forest).select("doc_id", "score", boosting.held_out(F.col("doc_id")).alias("out")).collect()
    assert len(rows) == 1004 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    out = [(kind[r.doc_id], r.score) for r in rows if r.out and r.doc_id < 1000]
    assert len(out) > 150 and np.mean([(s >= 0.7) == k for k, s in out]) > 0.97
    assert len({r.score for r in rows if r.doc_id in (2000, 2001)}) == 1


def test_labels_of_held_out_rows_are_not_used(tables):
    docs, labels, _ = tables
    other = labels.withColumn("quality", F.when(boosting.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (boosting.train(docs, t, trees=5) for t in (labels, other))
    assert np.array_equal(a.leaf, b.leaf) and np.array_equal(a.cut, b.cut)


def test_one_kind_no_labels_and_empty_tables(frame, tables):
    docs, labels, _ = tables
    for rows, share in ((labels.where("quality = 1 and doc_id < 1000"), 1.0), (labels.limit(0), 0.5)):
        found = {r.score for r in boosting.scored(docs, boosting.train(docs, rows)).select("score").collect()}
        assert len(found) == 1 and abs(found.pop() - share) < 1e-5
    assert boosting.scored(frame([]), boosting.train(frame([]), labels)).collect() == []


def test_whole_table(spark, sf_dir):
    from epifold.llm.q_boosting import op11_boosting

    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = op11_boosting(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.predicted == (r.score >= 0.7) for r in rows)
    out = [(label[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in label]
    assert len(out) > 50 and np.mean([a == b for a, b in out]) > 0.95
