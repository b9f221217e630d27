import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from epifold.llm import mixing


def expected_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while True:
        level = left / max(1, sum(weight[s] for s in open_))
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        source = ["hot", "b", "c", None, "é"][0 if i % 3 == 0 else int(rng.integers(1, 5))]
        rows.append((i, " ".join(["w"] * int(rng.integers(0, 900))), "en", source, 1))
    return rows + [(1000, None, "en", "hot", 0), (1001, "", "en", "empty", 0), (3, "a b c", "en", "tiny"), (3, "a b c", "en", "tiny"), (None, "x y", None, None), (1002, "z " * 50_000, "en", "c")]


@pytest.mark.parametrize("block", [64, None])
def test_targets_quotas_and_shards(frame, rows, block):
    known, mixture = mixing.mix(frame(rows), block, 32)
    known, drawn = known.collect(), mixture.collect()
    assert sorted((r.doc_id or -1, r.size) for r in known) == sorted((r[0] or -1, len(brute.words(r[1]))) for r in rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(brute.words(r[1]))
    target = expected_targets(sizes)
    source, size = {}, {}
    for r in known:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        source[r.doc_id, r.print, r.copy], size[r.doc_id, r.print, r.copy] = r.source, r.size
    taken, per = {}, {}
    for r in drawn:
        key = r.doc_id, r.print, r.copy
        per[key] = per.get(key, 0) + r.words
        taken[source[key]] = taken.get(source[key], 0) + r.words
    assert all(n <= 3 * size[k] for k, n in per.items())
    largest = max(size.values()) if block is None else block
    assert all(abs(taken.get(s, 0) - t) <= largest / 2 + 1e-6 for s, t in target.items() if s != "c" or block)
    # Shards are disjoint, of equal size, and their positions have no gap.
    assert len({(r.doc_id, r.print, r.copy, r.block, r["pass"]) for r in drawn}) == len(drawn)
    shards = {}
    for r in drawn:
        shards.setdefault(r.shard, []).append(r.position)
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(p) == list(range(len(p))) for p in shards.values())


def test_runs_agree(frame, rows):
    a, b = (sorted(map(str, mixing.mix(frame(rows, n), 64, 32)[1].collect())) for n in (2, 5))
    assert a == b


def test_tree_keeps_quotas_and_draws_like_urns(spark):
    quotas = spark.createDataFrame([("a", 300), ("b", 100), (None, 7), ("d", 0)], "source string, n long")
    rows = mixing.split(quotas, 5).collect()
    by = {}
    for r in rows:
        assert r.n >= 0
        by.setdefault(r.source, []).append(r.n)
    assert {s: sum(n) for s, n in by.items()} == {"a": 300, "b": 100, None: 7, "d": 0}
    per = {k: sum(r.n for r in rows if r.shard == k) for k in range(32)}
    assert max(per.values()) - min(per.values()) <= 1
    draws = spark.range(3000).select(mixing._drawn(F.lit(60), F.lit(20), F.lit(30), F.col("id")).alias("x"))
    mean, spread = draws.agg(F.avg("x"), F.variance("x")).first()
    assert abs(mean - 10) < 0.15 and abs(spread - 30 * (1 / 3) * (2 / 3) * (30 / 59)) < 0.4


def test_many_sources_are_dealt_in_groups(spark):
    quotas = {f"host{k}": 1 + k % 17 for k in range(300)} | {None: 40, "none": 0, "hot": 900}
    rows = mixing.split(spark.createDataFrame(list(quotas.items()), "source string, n long"), 4).collect()
    by, per, hot = {}, {}, {}
    for r in rows:
        assert r.n >= 0
        by[r.source], per[r.shard] = by.get(r.source, 0) + r.n, per.get(r.shard, 0) + r.n
        if r.source == "hot":
            hot[r.shard] = r.n
    assert by == quotas and max(per.values()) - min(per.values()) <= 1 and len(per) == 16
    # A source is spread as by chance: mean 900 / 16, never far from it.
    assert min(hot.values()) > 25 and max(hot.values()) < 90 and len(set(hot.values())) > 4


def test_targets_of_many_sources(spark, frame):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(0, 60)), "en", f"s{rng.integers(0, 250)}", 1) for i in range(1200)]
    known, _ = mixing.mix(frame(rows), 16, 64)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(brute.words(r[1]))
    want = expected_targets(sizes)
    got = {r.source: r.target for r in known.select("source", "target").distinct().collect()}
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(t) for s, t in want.items())


def test_empty_table_and_texts_without_words(frame):
    for rows in ([], [(1, None), (2, " ", None, "s")]):
        known, mixture = mixing.mix(frame(rows))
        assert known.count() == len(rows) and mixture.count() == 0
        assert all(r.target == 0 for r in known.collect())
