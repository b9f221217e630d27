"""Every registered query against its SQL check, and the shape of its plan."""

from __future__ import annotations

import compare
import pytest

from epifold.plans import all_queries

QUERIES = all_queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, sf_dir, con, name):
    q = QUERIES[name]
    assert compare.difference(q.build(spark, sf_dir), con, q.sql) is None


WRITES = {q for q in QUERIES if q.startswith(("src", "snk")) or q in ("linelist_ingest", "linelist_arrival", "linelist_current", "linelist_deliveries")}


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in WRITES])
def test_plan_without_products_or_python(spark, sf_dir, name):
    """With broadcasts by size switched off, as for tables that are large."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name].build(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval"):
        assert word not in plan


def test_every_survey_entry_is_covered():
    part_a = {
        "SRC": 6, "SNK": 4, "PRJ": 7, "FLT": 9, "UPD": 3, "JOIN": 9, "AGG": 10, "RSH": 5,
        "WIN": 10, "SRT": 2, "LIM": 1, "SET": 1, "CND": 9, "NUL": 3, "DAT": 5, "STR": 6,
        "MTH": 5, "ROW": 3, "PIPE": 44,
    }
    wanted = {f"{k}-{i}" for k, n in part_a.items() for i in range(1, n + 1)}
    covered = {c for q in QUERIES.values() for c in q.covers}
    assert wanted - covered == set()
    assert covered - wanted == set()


def test_entry_runs(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.columns == ["age_group", "month", "n"]
    assert rows.count() > 0
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())
