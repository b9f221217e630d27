import numpy as np
import pytest

from epifold.llm import negatives
from epifold.llm.rtree import ANY, Tree

RNG = np.random.default_rng(13)
SCHEMA = "vec_id long, embedding array<float>, label int, q string, mark string, part string, rank string"


def brute(rows):
    """Rows (id, vector, label) that take part, no two with one id."""
    known = [(i, np.floor(256 * np.float32(v).astype(float)).astype(int), (b + 1) % 10 if i % 7 == 0 else b) for i, v, b in rows]
    out = []
    for i, a, b in known:
        if i % 100:
            continue
        scored = sorted((-int(a @ v), j, c) for j, v, c in known if j != i and len(v) == len(a))
        for s, j, _ in [x for x in scored if x[2] == b][:5]:
            window = [(-t, k) for t, k, c in scored if c != b and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(i, j, r, k, -s, t) for r, (t, k) in enumerate(window[:10], 1)]
    return sorted(out)


def table(spark, rows):
    data = [(i, None if v is None else [None if x is None else float(x) for x in v], b, "x", "x", "x", "x") for i, v, b in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def test_matches_all_pairs(spark):
    base = RNG.normal(size=(30, 12))
    # Copies from two to hundreds, near vectors, ties in score, and a label that holds most rows.
    vectors = [*RNG.normal(size=(700, 12)), *np.repeat(base[:3], 150, axis=0), *(base[RNG.integers(0, 30, 500)] + 0.1 * RNG.normal(size=(500, 12)))]
    good = [(int(i), np.float32(v), int(b)) for i, v, b in zip(RNG.permutation(5000), vectors, RNG.integers(0, 10, len(vectors)) * RNG.integers(0, 2, len(vectors)))]
    good += [(100 * k + 10_000, np.float32(base[k]), k % 4) for k in range(12)] + [(-300, np.float32(base[0]), 2), (20_000, np.zeros(12), 1)]
    good += [(30_000, np.float32([1, 2]), 3), (30_001, np.float32([2, 2]), 3), (30_002, np.float32([1, 1]), 4), (30_003, np.float32([9, 9]), 4)]
    bad = [(40_000, None, 1), (40_100, [None] * 12, 1), (40_200, [float("nan")] * 12, 1), (40_300, [float("inf")] * 12, 1), (40_400, base[0], None), (None, base[0], 1)]
    got = negatives.hard_negatives(table(spark, good + bad + good[:40]))
    assert got.columns == negatives.RESULT
    want = brute(good)
    assert len(want) > 1000 and sorted(map(tuple, got.collect())) == want


def test_rows_with_one_id_are_different_rows(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [0.9, 0.0], 1), (5, [0.5, 0.0], 2)]
    got = sorted(map(tuple, negatives.hard_negatives(table(spark, rows)).collect()))
    assert got == [(100, 100, 1, 5, 256 * 230, 128 * 230), (100, 100, 1, 5, 256 * 230, 128 * 256)]


def test_empty_tables(spark):
    assert negatives.hard_negatives(table(spark, [])).collect() == []
    assert negatives.hard_negatives(table(spark, [(100, [], 1), (101, [], 1), (102, [], 2)])).collect()[0].negative_id == 102


@pytest.mark.parametrize("size", [1, 100, 2**24])
def test_tree_equals_a_scan(size):
    n, d = 3000, 8
    rows = RNG.integers(-size, size + 1, (n, d))
    rows[:1000] = rows[0]
    ids, marks, labels = RNG.permutation(n), np.zeros(n, np.int64), RNG.integers(0, 3, n)
    tree = Tree.load(Tree(rows, ids, marks, labels).dump())
    for k in range(20):
        score = rows @ rows[k * 60]
        middle = int(np.median(score))
        windows = [ANY, (middle, middle + abs(middle) // 2 + size), (5, 4)]
        for same in (True, False):
            for window, found in zip(windows, tree.best(rows[k * 60], 1, same, windows, 10)):
                fit = (score >= window[0]) & (score <= window[1]) & ((labels == 1) == same)
                want = sorted((-int(s), int(i)) for s, i in zip(score[fit], ids[fit]))[:10]
                assert [(-s, i) for s, i, _ in found] == want


def test_boxes_spare_leaves(monkeypatch):
    rows = np.concatenate([RNG.normal(3000 * RNG.normal(size=6), 30, (200, 6)) for _ in range(40)]).astype(np.int64)
    tree = Tree(rows, np.arange(len(rows)), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64))
    seen = []

    class Counting(np.ndarray):
        def __matmul__(self, other):
            seen.append(len(self))
            return np.asarray(self) @ np.asarray(other)

    held = tree._of_kind(np.float64)
    tree.as_kind[np.float64] = (held[0].view(Counting), *held[1:])
    tree.best(rows[5], 0, True, [ANY], 5)
    assert sum(seen) < len(rows) / 10
