"""Queries that keep state in storage, count as they filter, or run at the grain of the rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from epifold.operators import geo, linelist, ranges
from epifold.operators.arrivals import Rule, Store
from epifold.plans import fixtures as X
from epifold.plans import registers as R
from epifold.plans.primitives import linelist_rows
from epifold.plans.registry import query
from epifold.sources import accounting, files, manifest
from epifold.sources.literals import literal_table
from epifold.sources.storage import scratch_path

# ------------------------------------------------------- tables that follow their input


@query(
    "snk4_current_input",
    "SNK-4",
    sql="""
SELECT case_id, count(*) AS n, min(open_date) AS first_date, max(open_date) AS last_date
FROM r_linelist GROUP BY case_id""",
)
def _(spark, sf_dir):
    source, root = scratch_path(spark, "deliveries"), scratch_path(spark, "current")
    rows = linelist_rows(spark, sf_dir).select("seq", "case_id", "open_date")
    late = F.col("seq") % 2 == 0

    def current():
        read = spark.read.schema(rows.schema).parquet(source)
        dates = [F.min("open_date").alias("first_date"), F.max("open_date").alias("last_date")]
        return manifest.materialise_current(
            lambda: read.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), *dates), root, [read], {"version": 1}
        )

    rows.where(~late).write.parquet(source)
    current()
    rows.where(late).write.mode("append").parquet(source)
    # Written anew, as the input has grown; the second call finds it.
    current()
    return current()


@query(
    "linelist_current",
    "PIPE-43",
    sql="""
SELECT case_id, age, open_date, death_date, first_dose, seq FROM r_linelist
UNION ALL
SELECT case_id, age, open_date, death_date, second_dose AS first_dose, seq FROM r_linelist""",
)
def _(spark, sf_dir):
    one, two, root = (scratch_path(spark, n) for n in ("lines-one", "lines-two", "lines"))
    rows = linelist_rows(spark, sf_dir)
    rows.write.parquet(one)
    early = F.col("seq") % 3 > 0
    rows.where(early).write.parquet(two)
    names = {c: c for c in ("case_id", "age", "open_date", "death_date", "first_dose", "seq")}
    other = {("second_dose" if c == "first_dose" else c): n for c, n in names.items()}

    def ingested():
        a, b = (spark.read.schema(rows.schema).parquet(p) for p in (one, two))
        return linelist.ingest_linelist(a, b, root, names, other, order="seq", current=True)

    ingested()
    rows.where(~early).write.mode("append").parquet(two)
    return ingested()


@query(
    "linelist_deliveries",
    "PIPE-2",
    "PIPE-3",
    sql="""
SELECT f.case_id, f.seq, f.age, f.open_date, d.death_date, f.booster, b.first_dose
FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS k FROM r_linelist) f
LEFT JOIN (SELECT case_id, arg_min(death_date, seq) AS death_date FROM r_linelist
           WHERE death_date IS NOT NULL GROUP BY 1) d USING (case_id)
LEFT JOIN (SELECT case_id, arg_min(first_dose, seq) AS first_dose FROM r_linelist
           WHERE first_dose IS NOT NULL GROUP BY 1) b USING (case_id)
WHERE k = 1""",
)
def _(spark, sf_dir):
    rows = linelist_rows(spark, sf_dir).select("case_id", "seq", "age", "open_date", "death_date", "booster", "first_dose")
    rule = Rule("case_id", "seq", best_of=("death_date", "first_dose"))
    store = Store(spark, scratch_path(spark, "cases-store"), rule, rows.schema, buckets=16)
    # Three deliveries, not in the order of the notifications; one comes twice.
    delivery = F.pmod(F.xxhash64("seq"), F.lit(3))
    for k in (2, 0, 1, 0):
        store.apply(rows.where(delivery == k))
    return store.rows()


# ------------------------------------------------------------------------ row accounts

RULES_SQL = """
SELECT 'read' AS reason, count(*) AS n FROM r_linelist
UNION ALL
SELECT CASE WHEN booster = 'y' THEN 'rejected_unfit' WHEN death_date IS NULL THEN 'rejected_incomplete'
            WHEN open_date < DATE '1996-01-01' THEN 'rejected_early' ELSE 'kept' END, count(*)
FROM r_linelist GROUP BY 1"""


@query("src3_row_accounts", "SRC-3", "FLT-2", "FLT-6", sql=RULES_SQL)
def _(spark, sf_dir):
    path = scratch_path(spark, "ages-counted")
    rows = linelist_rows(spark, sf_dir)
    text = F.when(F.col("booster") == "y", "unknown").otherwise(F.col("age").cast("string"))
    rows.select("seq", text.alias("age"), "open_date", "death_date").write.option("header", True).csv(path)
    schema = T.StructType(
        [
            T.StructField("seq", T.LongType()),
            T.StructField("age", T.IntegerType()),
            T.StructField("open_date", T.DateType()),
            T.StructField("death_date", T.DateType()),
        ]
    )
    read = files.read_csv(spark, path, schema, keep_corrupt=True)
    rules = {
        "unfit": F.col(files.CORRUPT).isNotNull(),
        "incomplete": accounting.incomplete(read, "seq", "age", "open_date", "death_date"),
        "early": F.col("open_date") < F.lit("1996-01-01").cast("date"),
    }
    counts = accounting.write_accounted(read, scratch_path(spark, "ages-kept"), rules)
    # One row per rule.
    return literal_table(spark, [(k, v) for k, v in counts.items() if v], (("reason", "string"), ("n", "bigint")))


# ------------------------------------------------------------- sums and ranks of rows


@query(
    "win1_running_sum_of_rows",
    "WIN-1",
    sql="""
SELECT l_orderkey, l_linenumber, l_returnflag, l_shipdate, l_quantity,
       sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_shipdate) AS running,
       CAST(count(*) OVER (PARTITION BY l_returnflag ORDER BY l_shipdate) AS BIGINT) AS running_n
FROM lineitem""",
)
def _(spark, sf_dir):
    rows = X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate", "l_quantity")
    counted = rows.withColumn("one", F.lit(1).cast("bigint"))
    sums = {"running": "l_quantity", "running_n": "one"}
    return ranges.running_sums_of_rows(counted, ["l_returnflag"], "l_shipdate", sums).drop("one")


@query(
    "win3_running_sum_of_rows_in_period",
    "WIN-3",
    sql="""
SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, o_orderdate, o_custkey,
       CAST(sum(o_custkey) OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate) AS BIGINT) AS running
FROM orders""",
)
def _(spark, sf_dir):
    rows = X.table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), "o_orderdate", "o_custkey")
    return ranges.running_sums_of_rows(rows, ["year"], "o_orderdate", {"running": "o_custkey"})


def _rank_of_rows_sql(key: str) -> str:
    by = f"PARTITION BY {key}" if key else ""
    ties = f"PARTITION BY {key + ', ' if key else ''}price"
    return f"""
SELECT *, CAST(rank() OVER ({by} ORDER BY price DESC) + (count(*) OVER ({ties}) - 1) / 2.0 AS DOUBLE) AS rank
FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, floor(o_totalprice / 50) AS price FROM orders) t"""


def _priced(spark, sf_dir):
    price = F.floor(F.col("o_totalprice") / 50).cast("double").alias("price")
    return X.table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), price)


@query("win5_average_rank_of_rows", "WIN-5", sql=_rank_of_rows_sql(""))
def _(spark, sf_dir):
    return ranges.average_ranks_of_rows(_priced(spark, sf_dir), "price")


@query("win6_average_rank_of_rows_per_year", "WIN-6", sql=_rank_of_rows_sql("year"))
def _(spark, sf_dir):
    return ranges.average_ranks_of_rows(_priced(spark, sf_dir), "price", ["year"])


# --------------------------------------------------------------------------- long rings


@query(
    "src6_long_rings",
    "SRC-6",
    "PIPE-25",
    sql="""
WITH v AS (
  SELECT CASE WHEN o_custkey % 3 > 0 THEN 'LONG' ELSE 'SHORT' END AS region,
         CASE WHEN o_custkey % 3 > 0 THEN 0 ELSE o_custkey END AS ring, o_orderkey AS idx,
         CAST(o_custkey % 101 AS DOUBLE) AS x, CAST(floor(o_totalprice) % 89 AS DOUBLE) AS y
  FROM orders
), e AS (
  SELECT region, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM v
  WINDOW w AS (PARTITION BY region, ring ORDER BY idx)
), s AS (
  SELECT region, sum(x0 * y1 - x1 * y0) AS a2, sum((x0 + x1) * (x0 * y1 - x1 * y0)) AS sx,
         sum((y0 + y1) * (x0 * y1 - x1 * y0)) AS sy
  FROM e WHERE x1 IS NOT NULL GROUP BY 1
)
SELECT region, round(sx / nullif(a2 * 3, 0), 6) AS x, round(sy / nullif(a2 * 3, 0), 6) AS y, round(abs(a2 / 2), 6) AS area
FROM s""",
)
def _(spark, sf_dir):
    # Two thirds of all vertices are one ring.
    long = F.col("o_custkey") % 3 > 0
    vertices = X.table(spark, sf_dir, "orders").select(
        F.when(long, "LONG").otherwise("SHORT").alias("region"),
        F.when(long, F.lit(0)).otherwise(F.col("o_custkey")).alias("ring"),
        F.col("o_orderkey").alias("idx"),
        (F.col("o_custkey") % 101).cast("double").alias("x"),
        (F.floor("o_totalprice") % 89).cast("double").alias("y"),
    )
    return R.rounded(geo.polygon_centroids(vertices, split=True), "x", "y", "area")
