import brute
import numpy as np
import pytest

from epifold.llm import minhash
from epifold.llm.graph import components
from epifold.sources.storage import Scratch

RNG = np.random.default_rng(11)
GRAPHS = {
    "chain": [(k, k + 1) for k in range(0, 120)],
    "star": [(200, k) for k in range(201, 260)] + [(k, 150) for k in range(300, 340)],
    "loops": [(1, 1), (2, 2), (2, 3), (3, 2)],
    "drawn": [tuple(map(int, RNG.integers(-200, 200, 2))) for _ in range(180)],
    "none": [],
}


def plain(links):
    real = [(a, b) for a, b in links if a != b]
    union = brute.Union({x for e in real for x in e})
    for a, b in real:
        union.join(a, b)
    return {x: union.find(x) for x in union.up}


@pytest.mark.parametrize("name", GRAPHS)
def test_components_match_a_plain_search(spark, name):
    links = GRAPHS[name]
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    want = plain(links)
    with Scratch(spark, "graph") as scratch:
        assert {r.node: r.component for r in components(df, scratch, "all").collect()} == want
        # Fewer rounds never put nodes together that are not linked.
        some = components(df, scratch, "some", rounds=1).collect()
        assert sorted(r.node for r in some) == sorted(want)
        assert all(want[r.component] == want[r.node] for r in some)


def test_few_tables_and_jobs_where_one_round_links_all(spark, frame):
    """Components in full after every turn, and once more over all documents, took 116 jobs for these rows; now 76."""
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(i, f"{base} x{i % 9}") for i in range(60)] + [(5, f"{base} y"), (70, "a b c")]
    docs = frame(rows)
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("few-jobs", "near duplicates")
    try:
        got = minhash.near_duplicates(docs, 2, 80).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((tuple(r) for r in got), key=str) == brute.near_duplicates(rows, 2, 80)
    assert 0 < len(tracker.getJobIdsForGroup("few-jobs")) < 96
