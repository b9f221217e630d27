import numpy as np
import pytest
from pyspark.sql import functions as F

from epifold.llm import toxicity

RNG = np.random.default_rng(11)
BAD = ["scum", "moron", "vileone", "viletwo"]


def text(bad):
    w = [f"w{k}" for k in RNG.zipf(1.3, int(RNG.integers(5, 60))) % 3000]
    if bad:
        w.insert(int(RNG.integers(0, len(w))), BAD[int(RNG.integers(0, len(BAD)))].title())
    return " ".join(w)


@pytest.fixture(scope="module")
def tables(spark, frame):
    kind = [i % 7 == 0 for i in range(1200)]
    docs = frame([(i, text(k), "en", "s", 1) for i, k in enumerate(kind)] + [(2000, None), (2001, ""), (None, "Scum"), (3, "w1 w2")])
    labels = spark.createDataFrame([(i, 1, int(k)) for i, k in enumerate(kind) if i % 3] + [(None, 1, 1), (9999, 0, None)], "doc_id long, quality int, toxic int")
    return docs, labels, kind


def test_held_out_documents_are_told_apart(tables):
    docs, labels, kind = tables
    model = toxicity.train(docs, labels)
    rows = toxicity.scored(docs, model).select("doc_id", "score", toxicity.held_out(F.col("doc_id")).alias("out")).collect()
    assert len(rows) == 1204 and all(0 <= r.score <= 1 for r in rows)
    out = [(kind[r.doc_id], r.score) for r in rows if r.out and r.doc_id < 1200]
    assert len(out) > 300
    assert np.mean([(s >= 0.7) == k for k, s in out]) > 0.97
    empty = {r.score for r in rows if r.doc_id in (2000, 2001)}
    assert len(empty) == 1 and empty.pop() < 0.7


def test_labels_of_held_out_rows_are_not_used(tables):
    docs, labels, _ = tables
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, other)
    assert all(np.array_equal(x, y) for x, y in zip(a, b))


def test_without_examples_and_empty_tables(frame, tables):
    docs, labels, _ = tables
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert {r.score for r in toxicity.scored(docs, none).select("score").collect()} == {0.0}
    assert toxicity.scored(frame([]), toxicity.train(frame([]), labels)).collect() == []
    assert {r.score for r in toxicity.scored(docs, toxicity.train(docs, labels.limit(0))).select("score").collect()} == {0.0}


def test_negative_risk_is_taken_back():
    # Without the correction the clean risk of this sample would go far below zero.
    positive, unlabelled = [[0]] * 40, [[0]] * 2 + [[1]] * 38
    weight, bias = toxicity.fit(positive, unlabelled, 2, prior=0.5)
    assert np.isfinite(weight).all() and weight[0] > weight[1]
    clean = np.logaddexp(0, np.array([weight[0] + bias] * 2 + [weight[1] + bias] * 38)).mean() - 0.5 * np.logaddexp(0, weight[0] + bias)
    assert clean > -0.5
