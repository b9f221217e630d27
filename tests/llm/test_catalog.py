import compare
import pytest

from epifold.llm import catalog

BUILDS, SQL = catalog.load()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, name):
    con = compare.connect(sf_dir)
    for table in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    assert compare.difference(BUILDS[name](spark, sf_dir), con, SQL[name]) is None


@pytest.mark.parametrize("name", ["op4_mixing", "op10_chat"])
def test_native_queries_run_no_python(spark, sf_dir, name):
    plan = BUILDS[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert all(word not in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
