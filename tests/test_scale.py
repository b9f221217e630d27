"""Hot keys, shape of the heavy plans and relations between results."""

from __future__ import annotations

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from epifold import dims
from epifold.functions import age_band, dose_level
from epifold.operators import causes, comorbidity, coverage, linelist, reports, series
from epifold.plans import fixtures as X
from epifold.plans import registers as R

N = 30_000


def hot_lines(spark):
    """A third of all rows belong to case 0."""
    i = F.col("id")
    return spark.range(N).select(
        F.when(i % 3 == 0, F.lit(0)).otherwise(i % 997 + 1).alias("case_id"),
        ((i * 7919) % N).alias("seq"),
        ((i * 31) % 20).cast("double").alias("age"),
        F.when(
            (i * 13) % 11 == 0, F.date_add(F.lit("2020-01-01").cast("date"), (i % 900).cast("int"))
        ).alias("death_date"),
        F.when(i % 5 == 0, "Tuberculosis").alias("condition"),
        F.when(i % 4 == 0, "y").alias("d1"),
    )


def test_deduplication_of_a_hot_case(spark):
    lines = hot_lines(spark)
    got = {
        r["case_id"]: r
        for r in linelist.dedup_linelist(
            lines.select("case_id", "seq", "age", "death_date"), "case_id", "seq", ["death_date"]
        ).collect()
    }
    by_case = defaultdict(list)
    for r in lines.collect():
        by_case[r["case_id"]].append(r)
    assert len(by_case[0]) == N // 3 and len(got) == len(by_case)
    for case, rows in by_case.items():
        rows.sort(key=lambda r: r["seq"])
        dated = [r["death_date"] for r in rows if r["death_date"]]
        assert got[case]["age"] == rows[0]["age"]
        assert got[case]["death_date"] == (dated[0] if dated else None)


def test_conditions_of_a_hot_case(spark):
    lines = hot_lines(spark)
    got = {
        r["case_id"]: r
        for r in comorbidity.condition_from_rows(lines, after=None, until=None).collect()
    }
    assert got[0]["condition"] == "Multiple comorbidities"
    assert got[0]["n_rows"] == N // 3


def test_earliest_doses_of_a_hot_person(spark):
    i = F.col("id")
    ledger = spark.range(N).select(
        F.when(i % 3 == 0, 0).otherwise(i % 401 + 1).alias("person_id"),
        F.when(i % 2 == 0, "1ra").otherwise("Unica").alias("dose_name"),
        F.concat(F.lit("P"), (i % 4).cast("string")).alias("province"),
        F.lit("0-2").alias("age_group"),
        F.date_add(F.lit("2021-01-01").cast("date"), ((i * 17) % 29).cast("int")).alias(
            "dose_date"
        ),
    )
    rows = ledger.collect()
    first = {}
    for r in rows:
        first[r["person_id"]] = min(first.get(r["person_id"], r["dose_date"]), r["dose_date"])
    wanted = defaultdict(int)
    for r in rows:
        if r["dose_date"] == first[r["person_id"]]:
            wanted[(r["dose_date"], r["province"])] += 1
    got = {
        (r["dose_date"], r["province"]): r["n"] for r in coverage.earliest_doses(ledger).collect()
    }
    assert got == dict(wanted)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_deduplication_reduces_before_its_only_shuffle(spark):
    lines = hot_lines(spark).select(
        "case_id", "seq", "age", "death_date", dose_level("d1", "d1", "d1").alias("level")
    )
    plan = plan_of(linelist.dedup_linelist(lines, "case_id", "seq", ["death_date"]))
    assert len(re.findall("Exchange", plan)) == 1
    assert plan.count("HashAggregate") == 2 and "partial_min_by" in plan
    assert "Window" not in plan and "SortAggregate" not in plan


def test_condition_rows_hash_in_one_shuffle(spark):
    plan = plan_of(comorbidity.condition_from_rows(hot_lines(spark)))
    assert len(re.findall("Exchange", plan)) == 1
    assert plan.count("HashAggregate") == 2 and "Join" not in plan


def test_daily_frame_reads_once_and_shares_its_windows(spark, sf_dir):
    plan = plan_of(R.daily_wide(spark, sf_dir))
    assert plan.count("FileScan") == 1
    # by case, by group and day, by group
    assert len(re.findall("Exchange hashpartitioning", plan)) == 3
    assert "SortMergeJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    cut = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("open_date"), "o_orderstatus"
    )
    plan = plan_of(
        linelist.monthly_counts(cut.where("o_orderstatus = 'F'"), "open_date", ["o_orderstatus"])
    )
    assert "EqualTo(o_orderstatus,F)" in plan
    assert "ReadSchema: struct<o_orderstatus:string,o_orderdate" in plan or (
        "ReadSchema: struct<o_orderdate" in plan
    )


def test_leaders_are_cut_before_the_shuffle(spark, sf_dir):
    plan = plan_of(causes.top_causes(R.cause_rows(spark, sf_dir)))
    assert plan.count("WindowGroupLimit") == 2


def test_monthly_sums_are_yearly_sums(spark, sf_dir):
    daily = R.daily_wide(spark, sf_dir).where(F.col("date") <= F.lit(X.CAP).cast("date"))
    monthly = (
        reports.deaths_by_period(daily, "month")
        .groupBy("age_group", F.year("month").alias("year"))
        .agg(F.sum("nonvac").alias("nonvac"), F.sum("vac").alias("vac"))
    )
    yearly = reports.deaths_by_period(daily, "year")
    a = sorted(tuple(r) for r in monthly.collect())
    b = sorted(tuple(r) for r in yearly.collect())
    assert a == b and len(a) == 18


def test_grid_sizes(spark, sf_dir):
    provinces = 25
    assert R.province_rows(spark, sf_dir).count() == provinces * 3 * 3 * 84
    assert R.national_doses(spark, sf_dir).count() == 3 * 84


def test_running_sums_do_not_fall(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("province", "age_group", "dose_name").orderBy("month")
    falls = (
        R.province_rows(spark, sf_dir)
        .withColumn("step", F.col("cum_n") - F.lag("cum_n").over(w))
        .where((F.col("step") < 0) | (F.col("step") != F.col("n")))
    )
    assert falls.count() == 0


def test_shares_add_up(spark, sf_dir):
    wide = (
        R.coverage_rows(spark, sf_dir)
        .groupBy("age_group", "month")
        .pivot("dose_label", [dims.ZERO_DOSE, "1+ doses"])
        .agg(F.first("pct"))
    )
    for r in wide.collect():
        assert r[dims.ZERO_DOSE] + r["1+ doses"] == pytest.approx(100.0)


def test_ranks_of_a_year_add_up(spark, sf_dir):
    ranked = causes.rank_series(R.register(spark, sf_dir))
    per_year = ranked.groupBy("year").agg(F.sum("rank").alias("s"), F.count(F.lit(1)).alias("n"))
    for r in per_year.collect():
        assert r["s"] == r["n"] * (r["n"] + 1) / 2


def test_totals_match_their_parts(spark):
    df = hot_lines(spark).withColumn("age_group", age_band("age"))
    monthly = linelist.monthly_counts(df, "death_date")
    both = series.totals_with_parts(monthly, "month", "age_group")
    totals = {r["month"]: r["n"] for r in both.where("is_total").collect()}
    assert totals == {r["month"]: r["n"] for r in series.period_totals(monthly, "month").collect()}


def test_hot_key_of_a_join_is_split(spark):
    """The adaptive planner splits the partition of a hot key in join_per_key."""
    from epifold.operators.joins import join_per_key

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        lines = hot_lines(spark).select("case_id", "seq", "death_date").repartition(8)
        known = linelist.dedup_linelist(lines, "case_id", "seq", ["death_date"]).drop("seq")
        for how in ("inner", "left", "left_semi"):
            joined = join_per_key(lines.drop("death_date"), known, ["case_id"], how)
            assert len(joined.collect()) == N
            assert "skew=true" in plan_of(joined), how
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
