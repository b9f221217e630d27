import brute
import numpy as np
from pyspark.sql import functions as F

from epifold.llm import neighbours
from epifold.llm.hnsw import Graph
from epifold.llm.neighbours import near_vectors
from epifold.sources.storage import Scratch

RNG = np.random.default_rng(6)
SCHEMA = "vec_id long, embedding array<float>, label int, rep string, n string, part string"


def near(base, n, noise):
    return [base + noise * RNG.normal(size=len(base)) for _ in range(n)]


def test_links_and_components_match_all_pairs(spark):
    base = RNG.normal(size=(300, 24))
    vectors = [*base, *near(base[0], 150, 0.2), *near(base[1], 20, 0.3), base[2], base[2], 2 * base[2], base[3] * 1e30]
    rows = [(i, [float(x) for x in np.float32(v)], 1) for i, v in enumerate(vectors)]
    rows += [(2000, None, 1), (2001, [0.0] * 24, 1), (2002, [float("nan")] * 24, 1), (2003, [None] * 24, 1), (2004, [float("inf")] + [1.0] * 23, 1)]
    rows += [(2005, [], 1), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (None, rows[0][1], 1), (None, None, None)]
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA).repartition(3)
    got = near_vectors(df).collect()
    assert len(got) == len(rows)
    good = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and i < 2000]
    unit = np.stack([v / np.linalg.norm(v) for _, v in good])
    link = unit @ unit.T >= 0.95
    union = brute.Union(range(len(good)))
    for a, b in zip(*np.nonzero(link)):
        union.join(int(a), int(b))
    found = {r.vec_id: r for r in got if r.vec_id is not None}
    for i, _ in good:
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (link[i].sum() - 1, union.find(i), union.find(i) == i)
    for i in (2000, 2001, 2002, 2003, 2004, 2005):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert found[2006].n_links == found[2007].n_links == 1 and found[2007].component_id == 2006
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)] * 2


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_graph_finds_links_and_widens():
    x = RNG.normal(size=(3000, 16)).astype(np.float32)
    x[:400] = x[0] + 0.1 * RNG.normal(size=(400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Graph(x)
    graph.audit(0.95, 200, 0.99)
    q, p = graph.within(x, 0.95)
    true = x @ x.T >= 0.95
    assert true[q, p].all() and len(set(zip(q.tolist(), p.tolist()))) == len(q)
    assert len(q) >= 0.99 * true.sum()
    again = Graph.load(graph.dump(), x)
    assert all(np.array_equal(a, b) for a, b in zip(again.within(x[:99], 0.95), graph.within(x[:99], 0.95)))


def table_of(spark, vectors, kind="float"):
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)


def assert_all_pairs(got, vectors):
    unit = np.stack([v / np.linalg.norm(v) for v in np.float32(vectors).astype(float)])
    link = unit @ unit.T >= 0.95
    union = brute.Union(range(len(unit)))
    for a, b in zip(*np.nonzero(link)):
        union.join(int(a), int(b))
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(i, link[i].sum() - 1, union.find(i)) for i in range(len(unit))}


def test_no_row_holds_a_shard(spark, monkeypatch):
    longest = {}
    store = Scratch.store

    def watched(self, df, name, *args):
        stored = store(self, df, name, *args)
        for c in (c for c, kind in stored.dtypes if kind == "binary"):
            longest[name, c] = stored.agg(F.max(F.length(c))).first()[0]
        return stored

    monkeypatch.setattr(Scratch, "store", watched)
    base = RNG.normal(size=(2000, 24))
    vectors = np.array([*base, *near(base[0], 40, 0.1)])
    got = near_vectors(table_of(spark, vectors), shards=1).collect()
    # The vectors of the one shard alone are 190 KB.
    assert longest and max(longest.values()) <= 1 << 14
    assert_all_pairs(got, vectors)


def test_shards_and_slices_in_many_batches(spark, monkeypatch):
    base = RNG.normal(size=(400, 24))
    vectors = np.array([*base, *near(base[0], 150, 0.15), *near(base[1], 60, 0.25)])
    for name, value in (("SHARD_BYTES", 100 * 24 * 8), ("SLICE", 50), ("LONG_SLICE", 200), ("GROUPS", 12), ("PIECE", 256), ("ASKED", 30), ("COMPARED", 64), ("HELD", 128)):
        monkeypatch.setattr(neighbours, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        for kind in ("float", "double"):
            assert_all_pairs(near_vectors(table_of(spark, vectors, kind), shards=2).collect(), vectors)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pairs_come_in_pieces():
    x = np.float32(RNG.normal(size=16) + 0.01 * RNG.normal(size=(4000, 16)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Graph(x)
    most = [len(q) for q, _ in graph.pairs(x[:300], 0.95)]
    assert sum(most) == 300 * 4000 and max(most) <= 1 << 17
