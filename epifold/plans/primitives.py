"""One query per primitive of the survey's part A, on whole tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epifold import dims
from epifold.functions import (
    age_band,
    annotate_zero,
    clamp,
    complement,
    dose_class,
    dose_level,
    first_flag,
    fixed_decimals,
    flag_count,
    half_even,
    month_from_parts,
    month_number,
    month_start,
    padded_cell,
    parse_dmy,
    per_population,
    percent,
    percent_text,
    recode,
    spaced_commas,
    without_code_suffix,
    year_month,
)
from epifold.operators import causes, comorbidity, coverage, geo, linelist, series
from epifold.operators.joins import join_per_key
from epifold.plans import fixtures as X
from epifold.plans import registers as R
from epifold.plans.registry import part, query
from epifold.sources import files, infer, schemas
from epifold.sources.literals import literal_table
from epifold.sources.storage import materialise_once, scratch_path


def linelist_rows(spark, sf_dir):
    return X.view(spark, sf_dir, "r_linelist")


def monthly_openings(spark, sf_dir):
    """Openings by age group and month: the small series several windows run on."""
    rows = linelist_rows(spark, sf_dir).withColumn("age_group", age_band("age"))
    return linelist.monthly_counts(rows, "open_date", ["age_group"])


part(
    "openings",
    f"""
SELECT {R.AGE_CASE} AS age_group, CAST(date_trunc('month', open_date) AS DATE) AS month,
       count(*) AS n
FROM r_linelist GROUP BY 1, 2""",
)

# ------------------------------------------------------------------- sources

TEXT_DATES = "dd/MM/yyyy"


@query(
    "src1_declared_types",
    "SRC-1",
    sql="""
SELECT CAST(case_id AS VARCHAR) AS case_id, CAST(age AS DOUBLE) AS age, open_date, death_date
FROM r_linelist""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "cases")
    source = linelist_rows(spark, sf_dir).select(
        F.col("case_id").cast("string").alias("IDEVENTOCASO"),
        F.col("age").cast("double").alias("EDAD_APERTURA"),
        F.col("open_date").alias("FECHA_APERTURA"),
        F.date_format("death_date", TEXT_DATES).alias("FECHA_FALLECIMIENTO"),
    )
    source.write.option("header", True).csv(path)
    read = files.read_csv(spark, path, schemas.CASES_TEXT_DATES).withColumnsRenamed(
        schemas.CASE_NAMES
    )
    return read.withColumn("death_date", parse_dmy("death_date"))


@query(
    "src1_columns_by_name",
    "SRC-1",
    sql="SELECT case_id, age, open_date FROM r_linelist",
)
def _(spark, sf_dir):
    # More columns than declared, in another order.
    path = scratch_path(spark, "cases-wide")
    rows = linelist_rows(spark, sf_dir)
    rows.select("booster", "open_date", F.lit("x").alias("more"), "age", "death_date", "case_id").write.option(
        "header", True
    ).option("emptyValue", "").csv(path)
    return files.read_csv(spark, path, rows.select("case_id", "age", "open_date").schema)


@query(
    "src2_gzip_csv",
    "SRC-2",
    "SNK-1",
    sql="SELECT seq, case_id, open_date, death_date FROM r_linelist",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "linelist-csv")
    rows = linelist_rows(spark, sf_dir).select("seq", "case_id", "open_date", "death_date")
    files.write_csv_gzip(rows, path)
    return files.read_csv(
        spark, path, rows.schema, partitions=spark.sparkContext.defaultParallelism
    )


@query(
    "src2_inferred_types",
    "SRC-2",
    sql="""
SELECT o_orderkey, CAST(o_custkey AS INT) AS o_custkey, o_orderstatus, o_totalprice,
       CAST(o_orderdate AS DATE) AS o_orderdate, lpad(CAST(o_custkey % 100 AS VARCHAR), 3, '0') AS code,
       CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END AS closed,
       CASE WHEN o_custkey % 2 = 0 THEN CAST(o_orderkey AS DOUBLE) / 4 END AS quarter,
       o_orderkey * 10000000000 AS wide, CAST(NULL AS VARCHAR) AS nothing
FROM (SELECT CAST(o_orderkey AS INT) AS o_orderkey, * EXCLUDE (o_orderkey) FROM orders) o""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "untyped")
    orders = X.table(spark, sf_dir, "orders")
    untyped = orders.select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_totalprice",
        F.col("o_orderdate").cast("date").alias("o_orderdate"),
        F.lpad((F.col("o_custkey") % 100).cast("string"), 3, "0").alias("code"),
        F.when(F.col("o_orderstatus") != "P", F.when(F.col("o_orderstatus") == "F", "T").otherwise("F")).alias("closed"),
        F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderkey") / F.lit(4.0)).alias("quarter"),
        (F.col("o_orderkey") * 10000000000).alias("wide"),
        F.lit(None).cast("string").alias("nothing"),
    )
    files.write_csv_gzip(untyped, path)
    return infer.read_csv_inferred(spark, path, partitions=spark.sparkContext.defaultParallelism)


@query(
    "src2_type_states",
    "SRC-2",
    sql="""
SELECT k AS part, name, CAST(count(v) AS BIGINT) AS n_known, CAST(count(*) - count(v) AS BIGINT) AS n_missing,
       CASE WHEN count(v) = 0 THEN 'text'
            WHEN bool_and(regexp_full_match(v, '[+-]?(0|[1-9][0-9]*)')) THEN 'integer'
            WHEN bool_and(regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) THEN 'date' ELSE 'text' END AS type
FROM (SELECT k, unnest(['case_id', 'age', 'death_date', 'booster', 'mixed']) AS name,
             unnest([CAST(case_id AS VARCHAR), CAST(age AS VARCHAR), CAST(death_date AS VARCHAR), booster,
                     CASE WHEN k = 2 AND seq % 1000 = 0 THEN '01' ELSE CAST(seq AS VARCHAR) END]) AS v
      FROM (SELECT r.*, k FROM r_linelist r, (VALUES (0), (1), (2)) t(k) WHERE k = 0 OR k = 1 + seq % 2)) u
GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    # States of two halves, and what they merge to for the whole (part 0).
    rows = linelist_rows(spark, sf_dir).withColumn("part", (1 + F.col("seq") % 2).cast("int"))
    mixed = F.when((F.col("part") == 2) & (F.col("seq") % 1000 == 0), "01").otherwise(F.col("seq").cast("string"))
    text = rows.select(
        "part", *[F.col(c).cast("string").alias(c) for c in ("case_id", "age", "death_date", "booster")], mixed.alias("mixed")
    )
    halves = infer.column_states(text, by=["part"])
    whole = infer.merge_states(halves).select(F.lit(0).alias("part"), "*")
    return halves.unionByName(whole).select(
        "part", "name", "n_known", "n_missing", infer.type_name("fits").alias("type")
    )


@query(
    "src3_unfit_lines",
    "SRC-3",
    sql="""
SELECT seq, CASE WHEN booster = 'y' THEN NULL ELSE age END AS age,
       coalesce(booster = 'y', FALSE) AS unfit
FROM r_linelist""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "ages")
    rows = linelist_rows(spark, sf_dir)
    text = F.when(F.col("booster") == "y", "unknown").otherwise(F.col("age").cast("string"))
    rows.select("seq", text.alias("age")).write.option("header", True).csv(path)
    schema = T.StructType(
        [T.StructField("seq", T.LongType()), T.StructField("age", T.IntegerType())]
    )
    read = files.read_csv(spark, path, schema, keep_corrupt=True)
    return read.select("seq", "age", F.col(files.CORRUPT).isNotNull().alias("unfit"))


@query(
    "src5_calendar",
    "SRC-5",
    sql="""
SELECT 'month' AS step, CAST(g AS DATE) AS point
FROM (SELECT min(open_date) AS lo, max(open_date) AS hi FROM r_linelist) b,
     generate_series(date_trunc('month', lo), hi, INTERVAL 1 MONTH) AS t(g)
UNION ALL
SELECT 'day', CAST(g AS DATE)
FROM (SELECT min(open_date) AS lo, max(open_date) AS hi FROM r_linelist) b,
     generate_series(lo, hi, INTERVAL 1 DAY) AS t(g)""",
)
def _(spark, sf_dir):
    bounds = linelist_rows(spark, sf_dir).agg(
        F.min("open_date").alias("lo"), F.max("open_date").alias("hi")
    )

    def steps(name, low):
        points = F.sequence(low, F.col("hi"), F.expr(f"interval 1 {name}"))
        return F.transform(points, lambda p: F.struct(F.lit(name).alias("step"), p.alias("point")))

    return bounds.select(
        F.inline(F.concat(steps("month", month_start("lo")), steps("day", F.col("lo"))))
    )


@query(
    "src6_polygon_vertices",
    "SRC-6",
    "JOIN-9",
    sql="""
SELECT region, round(sum(cx * a) / sum(a), 6) AS x, round(sum(cy * a) / sum(a), 6) AS y,
       round(sum(a), 6) AS area
FROM (SELECT region, ring, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy,
             (max(x) - min(x)) * (max(y) - min(y)) AS a
      FROM r_polygons GROUP BY 1, 2) t
GROUP BY region""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "polygons")
    X.view(spark, sf_dir, "r_polygons").write.parquet(path)
    vertices = spark.read.schema(schemas.POLYGONS).parquet(path)
    return R.rounded(geo.polygon_centroids(vertices), "x", "y", "area")


@query(
    "snk2_report_table",
    "SNK-2",
    sql='SELECT age_group AS "Age group", month AS "Year-Month", n AS "Cases" FROM openings',
)
def _(spark, sf_dir):
    path = scratch_path(spark, "report")
    names = {"age_group": "Age group", "month": "Year-Month", "n": "Cases"}
    files.write_report(monthly_openings(spark, sf_dir), path, names)
    return spark.read.parquet(path)


@query("snk4_materialise_once", "SNK-4", sql="SELECT seq, case_id, open_date FROM r_linelist")
def _(spark, sf_dir):
    path = scratch_path(spark, "once")
    rows = linelist_rows(spark, sf_dir).select("seq", "case_id", "open_date")
    materialise_once(rows, path)
    # The table is there by now, so this frame is not written.
    return materialise_once(rows.where("age < 3"), path)


# --------------------------------------------------------------- projections


@query(
    "prj1_select_columns", "PRJ-1", sql="SELECT o_orderkey, o_orderdate, o_custkey FROM orders"
)
def _(spark, sf_dir):
    return X.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey")


@query(
    "prj2_drop_columns",
    "PRJ-2",
    sql="SELECT seq, case_id, age, open_date, death_date FROM r_linelist",
)
def _(spark, sf_dir):
    return linelist_rows(spark, sf_dir).drop("first_dose", "second_dose", "booster")


@query(
    "prj3_rename_columns",
    "PRJ-3",
    sql="SELECT province AS provincia_nombre, band5 AS edad_quinquenal, n AS cantidad "
    "FROM r_population",
)
def _(spark, sf_dir):
    back = {new: old for old, new in schemas.POPULATION_NAMES.items()}
    return X.view(spark, sf_dir, "r_population").withColumnsRenamed(back)


@query(
    "prj4_rename_one",
    "PRJ-4",
    sql='SELECT region AS "Region", ring, idx, x, y FROM r_polygons',
)
def _(spark, sf_dir):
    return X.view(spark, sf_dir, "r_polygons").withColumnRenamed("region", "Region")


@query(
    "prj5_add_columns",
    "PRJ-5",
    sql="SELECT seq, age, age + 1 AS next_age, age * 12 AS months FROM r_linelist",
)
def _(spark, sf_dir):
    rows = linelist_rows(spark, sf_dir).select("seq", "age")
    return rows.withColumns({"next_age": F.col("age") + 1, "months": F.col("age") * 12})


@query(
    "prj6_value_list",
    "PRJ-6",
    "JOIN-6",
    sql="""
SELECT seq, case_id FROM r_linelist
WHERE case_id IN (SELECT case_id FROM r_linelist WHERE death_date > DATE '1998-01-01')""",
)
def _(spark, sf_dir):
    rows = linelist_rows(spark, sf_dir).select("seq", "case_id", "death_date")
    ids = rows.where(F.col("death_date") > F.lit("1998-01-01").cast("date"))
    ids = ids.select("case_id").distinct()
    return join_per_key(rows, ids, ["case_id"], "left_semi").drop("death_date")


@query(
    "prj7_column_set",
    "PRJ-7",
    sql="""
SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS l_quantity,
       round_even(l_discount * 100, 0) AS l_discount, round_even(l_tax * 100, 0) AS l_tax
FROM lineitem""",
)
def _(spark, sf_dir):
    scale = {"l_quantity": F.col("l_quantity") / 2}
    scale |= {c: F.col(c) * 100 for c in ("l_discount", "l_tax")}
    return X.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", *[half_even(c).alias(name) for name, c in scale.items()]
    )


# ------------------------------------------------------------------- filters


@query(
    "flt1_date_range",
    "FLT-1",
    sql="""
SELECT seq, open_date FROM r_linelist
WHERE open_date >= DATE '1997-01-01' AND open_date <= DATE '1999-12-31'""",
)
def _(spark, sf_dir):
    low, high = (F.lit(d).cast("date") for d in ("1997-01-01", "1999-12-31"))
    return (
        linelist_rows(spark, sf_dir)
        .where((F.col("open_date") >= low) & (F.col("open_date") <= high))
        .select("seq", "open_date")
    )


@query(
    "flt2_not_null",
    "FLT-2",
    sql="SELECT seq, death_date FROM r_linelist WHERE death_date IS NOT NULL",
)
def _(spark, sf_dir):
    rows = linelist_rows(spark, sf_dir).select("seq", "death_date")
    return rows.where(F.col("death_date").isNotNull())


@query(
    "flt3_constant_set",
    "FLT-3",
    sql="SELECT * FROM r_dose_counts WHERE age_band IN ('0-2', '3-4', '5-11', '12-17')",
)
def _(spark, sf_dir):
    rows = X.view(spark, sf_dir, "r_dose_counts")
    return rows.where(F.col("age_band").isin(*dims.DOSE_BANDS))


@query(
    "flt4_calendar_member",
    "FLT-4",
    sql=f"""
SELECT seq, open_date FROM r_linelist
WHERE open_date IN (SELECT point FROM {R.MONTHS_SQL} m)""",
)
def _(spark, sf_dir):
    # A month calendar holds exactly the month starts between its ends.
    d, (low, high) = F.col("open_date"), (F.lit(m).cast("date") for m in X.MONTHS)
    rows = linelist_rows(spark, sf_dir).select("seq", "open_date")
    return rows.where((d == month_start("open_date")) & d.between(low, high))


@query(
    "flt5_disjunction",
    "FLT-5",
    sql="""
SELECT * FROM r_population
WHERE (band5 = '0 a 4' OR band5 = '5 a 9' OR band5 = '10 a 14')
  AND NOT (band5 = '0 a 4' AND province = 'NATION_1')""",
)
def _(spark, sf_dir):
    band, province = F.col("band5"), F.col("province")
    return X.view(spark, sf_dir, "r_population").where(
        ((band == "0 a 4") | (band == "5 a 9") | (band == "10 a 14"))
        & ~((band == "0 a 4") & (province == "NATION_1"))
    )


COMPLETE_SQL = """
SELECT * FROM dose_rows
WHERE province IS NOT NULL AND sex IS NOT NULL AND year IS NOT NULL AND month_es IS NOT NULL
  AND age_band IS NOT NULL AND qty IS NOT NULL AND dose IS NOT NULL AND month IS NOT NULL
  AND age_group IS NOT NULL"""


@query("flt6_complete_rows", "FLT-6", "ROW-3", sql=COMPLETE_SQL)
def _(spark, sf_dir):
    return coverage.dose_rows(X.view(spark, sf_dir, "r_dose_counts"), null_policy="drop")


@query(
    "flt7_group_minimum",
    "FLT-7",
    sql="""
SELECT person_id, dose_name, dose_date, count(*) AS n
FROM (SELECT *, min(dose_date) OVER (PARTITION BY person_id, dose_name) AS first_date
      FROM r_person_dose) t
WHERE dose_date = first_date GROUP BY 1, 2, 3""",
)
def _(spark, sf_dir):
    keys = ["person_id", "dose_name"]
    counts = (
        X.view(spark, sf_dir, "r_person_dose")
        .groupBy(*keys, "dose_date")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    first = counts.withColumn("_first", F.min("dose_date").over(W.partitionBy(*keys)))
    return first.where(F.col("dose_date") == F.col("_first")).drop("_first")


@query(
    "flt8_group_maximum",
    "FLT-8",
    sql="""
SELECT case_id, seq, open_date FROM
  (SELECT *, max(open_date) OVER (PARTITION BY case_id) AS top FROM r_linelist) t
WHERE open_date = top""",
)
def _(spark, sf_dir):
    rows = linelist_rows(spark, sf_dir).select("case_id", "seq", "open_date")
    return series.latest_point(rows, "open_date", ["case_id"])


@query(
    "flt8_global_maximum",
    "FLT-8",
    sql="""
SELECT seq, open_date FROM r_linelist
WHERE open_date = (SELECT max(open_date) FROM r_linelist)""",
)
def _(spark, sf_dir):
    rows = linelist_rows(spark, sf_dir).select("seq", "open_date")
    return series.latest_point(rows, "open_date")


@query("flt9_sentinel", "FLT-9", sql="SELECT * FROM r_person_dose WHERE province <> 'S.I.'")
def _(spark, sf_dir):
    rows = X.view(spark, sf_dir, "r_person_dose")
    return rows.where(F.col("province") != dims.UNKNOWN_PLACE)


@query(
    "upd1_keyed_correction",
    "UPD-1",
    sql="""
SELECT c.case_id, c.age,
       coalesce(o.corrected_date, c.death_date) AS death_date
FROM r_linelist c
LEFT JOIN (SELECT case_id, max(open_date) AS corrected_date FROM r_linelist
           WHERE death_date IS NOT NULL GROUP BY case_id) o ON c.case_id = o.case_id""",
)
def _(spark, sf_dir):
    rows = linelist_rows(spark, sf_dir)
    fixes = (
        rows.where(F.col("death_date").isNotNull())
        .groupBy("case_id")
        .agg(F.max("open_date").alias("death_date"))
    )
    target = rows.select("case_id", "age", "death_date")
    return linelist.apply_overrides(target, fixes, "case_id", "death_date")


@query(
    "upd1_last_correction",
    "UPD-1",
    sql="""
SELECT r.case_id, r.seq, coalesce(c.last, r.death_date) AS death_date FROM r_linelist r LEFT JOIN (
  SELECT case_id, max_by(open_date, seq) AS last FROM r_linelist WHERE case_id % 3 = 0 AND open_date IS NOT NULL GROUP BY case_id
) c ON r.case_id = c.case_id""",
)
def _(spark, sf_dir):
    # Several corrections per case, the last one counts; no row is doubled.
    rows = linelist_rows(spark, sf_dir)
    known = rows.where((F.col("case_id") % 3 == 0) & F.col("open_date").isNotNull())
    fixes = known.select("case_id", F.col("open_date").alias("death_date"), "seq")
    return linelist.apply_overrides(rows, fixes, "case_id", "death_date", order="seq").select("case_id", "seq", "death_date")


@query(
    "upd2_value_replacement",
    "UPD-2",
    sql="""
SELECT person_id, CASE dose_name WHEN 'Adicional' THEN 'Refuerzo' WHEN 'Unica' THEN '1ra'
                       ELSE dose_name END AS dose_name
FROM r_person_dose""",
)
def _(spark, sf_dir):
    return X.view(spark, sf_dir, "r_person_dose").select(
        "person_id", recode("dose_name", dims.DOSE_ALIASES, F.col("dose_name")).alias("dose_name")
    )


@query(
    "upd3_dash_for_missing",
    "UPD-3",
    sql="""
SELECT case_id, coalesce(CAST(max(death_date) AS VARCHAR), '-') AS last_death
FROM r_linelist GROUP BY case_id""",
)
def _(spark, sf_dir):
    return (
        linelist_rows(spark, sf_dir)
        .groupBy("case_id")
        .agg(F.max("death_date").alias("d"))
        .select("case_id", F.coalesce(F.col("d").cast("string"), F.lit("-")).alias("last_death"))
    )


# --------------------------------------------------------------------- joins


@query(
    "join1_inner",
    "JOIN-1",
    sql="""
SELECT o.age_group, o.month, o.n, round(p.population, 6) AS population
FROM openings o JOIN pop_national p ON o.age_group = p.age_group""",
)
def _(spark, sf_dir):
    joined = monthly_openings(spark, sf_dir).join(R.pop_national(spark, sf_dir), "age_group")
    return R.rounded(joined, "population")


@query(
    "join2_left_named_keys",
    "JOIN-2",
    sql="""
SELECT o.age_group, o.month, o.n, v.doses_1
FROM openings o LEFT JOIN national_doses v
  ON o.month = v.month AND o.age_group = v.age_group""",
)
def _(spark, sf_dir):
    doses = R.national_doses(spark, sf_dir).select(
        F.col("age_group").alias("band"), F.col("month").alias("fecha"), "doses_1"
    )
    openings = monthly_openings(spark, sf_dir)
    on = (openings["month"] == doses["fecha"]) & (openings["age_group"] == doses["band"])
    return openings.join(doses, on, "left").drop("band", "fecha")


@query(
    "join3_fact_onto_grid",
    "JOIN-3",
    sql=f"""
SELECT k.age_group, m.point AS month, coalesce(o.n, 0) AS n
FROM (SELECT DISTINCT age_group FROM openings) k CROSS JOIN {R.MONTHS_SQL} m
LEFT JOIN openings o ON o.age_group IS NOT DISTINCT FROM k.age_group AND o.month = m.point""",
)
def _(spark, sf_dir):
    return series.complete_series(
        monthly_openings(spark, sf_dir), ["age_group"], "month", R.months(), ["n"], outside="drop"
    )


@query(
    "join4_left_dimension",
    "JOIN-4",
    sql="""
SELECT c.province, c.age_group, c.dose, c.month, c.n, round(p.population, 6) AS population
FROM province_counts c LEFT JOIN pop_province p
  ON c.province = p.province AND c.age_group = p.age_group""",
)
def _(spark, sf_dir):
    rows = X.view(spark, sf_dir, "r_dose_counts").where(
        F.col("age_band").isin(*dims.DOSE_BANDS)
    )
    counts = coverage.dose_counts(rows, ["province", "age_group", "dose"], null_policy="keep")
    joined = counts.join(R.pop_province(spark, sf_dir), ["province", "age_group"], "left")
    return R.rounded(joined, "population")


@query(
    "join5_regions_left",
    "JOIN-5",
    sql="""
SELECT r.region, r.ring, r.idx, q.n
FROM r_polygons r LEFT JOIN (SELECT province, CAST(sum(n) AS BIGINT) AS n FROM r_population
                             WHERE band5 = '0 a 4' GROUP BY 1) q ON r.region = q.province""",
)
def _(spark, sf_dir):
    people = (
        X.view(spark, sf_dir, "r_population")
        .where(F.col("band5") == "0 a 4")
        .groupBy(F.col("province").alias("region"))
        .agg(F.sum("n").alias("n"))
    )
    vertices = X.view(spark, sf_dir, "r_polygons").select("region", "ring", "idx")
    return join_per_key(vertices, people, ["region"], "left")


@query(
    "join7_domain_product",
    "JOIN-7",
    "AGG-9",
    sql=f"""
SELECT p.province, a.age_group, d.dose, m.point AS month
FROM (SELECT DISTINCT province FROM province_counts) p
CROSS JOIN (SELECT DISTINCT age_group FROM province_counts) a
CROSS JOIN (SELECT DISTINCT dose FROM province_counts) d CROSS JOIN {R.MONTHS_SQL} m""",
)
def _(spark, sf_dir):
    # The observed values of each column in one row, written out again: no join.
    rows = coverage.dose_rows(X.view(spark, sf_dir, "r_dose_counts")).where(F.col("age_band").isin(*dims.DOSE_BANDS))
    domains = ("province", "age_group", "dose")
    grid = rows.agg(*[F.collect_set(c).alias(c) for c in domains])
    for c in domains:
        grid = grid.withColumn(c, F.explode(c))
    return grid.withColumn("month", F.explode(R.months().points()))


@query(
    "join8_completion",
    "JOIN-8",
    sql=f"""
SELECT coalesce(g.age_group, o.age_group) AS age_group, coalesce(g.month, o.month) AS month,
       coalesce(o.n, 0) AS n
FROM (SELECT k.age_group, m.point AS month FROM (SELECT DISTINCT age_group FROM openings) k
      CROSS JOIN {R.series_sql("1996-03-01", "2003-12-01", "MONTH")} m) g
FULL JOIN openings o
  ON g.age_group IS NOT DISTINCT FROM o.age_group AND g.month = o.month""",
)
def _(spark, sf_dir):
    # Months before the calendar survive, months after the data are zero.
    calendar = series.Calendar("1996-03-01", "2003-12-01")
    return series.complete_series(
        monthly_openings(spark, sf_dir), ["age_group"], "month", calendar, ["n"]
    )


# -------------------------------------------------- aggregates and reshaping


@query(
    "agg1_row_count",
    "AGG-1",
    sql="SELECT age, count(*) AS n FROM r_linelist GROUP BY age",
)
def _(spark, sf_dir):
    return linelist_rows(spark, sf_dir).groupBy("age").agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg2_sum",
    "AGG-2",
    sql="""
SELECT province, sex, CAST(sum(qty) AS BIGINT) AS qty,
       CAST(CASE WHEN count(*) = count(known) THEN sum(known) END AS BIGINT) AS strict_qty
FROM (SELECT *, CASE WHEN month_es <> 'S.I.' THEN qty END AS known FROM r_dose_counts) t
GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    known = F.when(F.col("month_es") != "S.I.", F.col("qty"))
    return (
        X.view(spark, sf_dir, "r_dose_counts")
        .groupBy("province", "sex")
        .agg(F.sum("qty").alias("qty"), series.strict_sum(known).alias("strict_qty"))
    )


@query(
    "agg3_mean",
    "AGG-3",
    sql="SELECT cause_name, round(avg(n), 6) AS mean_n FROM r_death_register GROUP BY 1",
)
def _(spark, sf_dir):
    register = X.view(spark, sf_dir, "r_death_register")
    means = register.groupBy("cause_name").agg(F.avg("n").alias("mean_n"))
    return R.rounded(means, "mean_n")


@query(
    "agg4_weighted_sum",
    "AGG-4",
    sql="""
SELECT province, round(CAST(sum(CASE band5 WHEN '10 a 14' THEN n * 0.4 WHEN '0 a 4' THEN n * 0.4
                                WHEN '5 a 9' THEN n * 1.0 END) AS DOUBLE), 6) AS population
FROM r_population GROUP BY province""",
)
def _(spark, sf_dir):
    shares = literal_table(
        spark,
        [(band, fifths) for band, group, fifths in dims.BAND_FIFTHS if group == "3-11"],
        (("band5", "string"), ("fifths", "int")),
    )
    people = X.view(spark, sf_dir, "r_population").join(shares, "band5", "left")
    weighted = F.sum(F.col("n") * F.col("fifths")) / F.lit(5.0)
    return R.rounded(people.groupBy("province").agg(weighted.alias("population")), "population")


@query(
    "agg5_class_columns",
    "AGG-5",
    sql="""
SELECT province, CAST(sum(CASE WHEN dose = '1' THEN qty ELSE 0 END) AS BIGINT) AS d1,
       CAST(sum(CASE WHEN dose = '2' THEN qty ELSE 0 END) AS BIGINT) AS d2,
       CAST(sum(CASE WHEN dose = '3' THEN qty ELSE 0 END) AS BIGINT) AS d3
FROM r_dose_counts GROUP BY province""",
)
def _(spark, sf_dir):
    return (
        X.view(spark, sf_dir, "r_dose_counts")
        .groupBy("province")
        .agg(
            *[
                F.sum(F.when(F.col("dose") == d, F.col("qty")).otherwise(0)).alias(f"d{d}")
                for d in dims.DOSES
            ]
        )
    )


@query(
    "agg6_running_maximum",
    "AGG-6",
    sql="""
SELECT age_group, year, max(running) AS n
FROM (SELECT age_group, CAST(year(month) AS INT) AS year,
             CAST(sum(n) OVER (PARTITION BY age_group, year(month) ORDER BY month
                  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM openings) t
GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    # The largest running sum of counts is their sum.
    return (
        linelist_rows(spark, sf_dir)
        .groupBy(age_band("age").alias("age_group"), F.year("open_date").alias("year"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "agg7_first_full_row",
    "AGG-7",
    sql="""
SELECT o_orderpriority, o_orderkey, o_custkey, o_totalprice
FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn
      FROM orders) t
WHERE rn = 1""",
)
def _(spark, sf_dir):
    # Five keys share all rows; the aggregate reduces them before the shuffle.
    rows = X.table(spark, sf_dir, "orders").select(
        "o_orderpriority", "o_orderkey", "o_custkey", "o_totalprice"
    )
    return linelist.first_record(rows, "o_orderpriority", "o_orderkey")


@query(
    "agg8_distinct_pairs", "AGG-8", sql="SELECT DISTINCT case_id, condition FROM r_long_conditions"
)
def _(spark, sf_dir):
    return X.view(spark, sf_dir, "r_long_conditions").select("case_id", "condition").distinct()


@query(
    "agg9_distinct_domain",
    "AGG-9",
    sql="""
SELECT cause_name, count(DISTINCT year) AS years, count(DISTINCT cause_code) AS codes
FROM r_death_register GROUP BY cause_name""",
)
def _(spark, sf_dir):
    return (
        X.view(spark, sf_dir, "r_death_register")
        .groupBy("cause_name")
        .agg(
            F.count_distinct("year").alias("years"), F.count_distinct("cause_code").alias("codes")
        )
    )


@query(
    "agg10_totals_with_parts",
    "AGG-10",
    sql="""
SELECT month, age_group, n, FALSE AS is_total FROM openings
UNION ALL
SELECT month, NULL, CAST(sum(n) AS BIGINT), TRUE FROM openings GROUP BY month""",
)
def _(spark, sf_dir):
    return series.totals_with_parts(monthly_openings(spark, sf_dir), "month", "age_group")


PIVOT_SQL = "SELECT month, {} FROM openings GROUP BY month"


@query(
    "rsh1_long_to_wide",
    "RSH-1",
    sql=PIVOT_SQL.format(
        ", ".join(f"max(CASE WHEN age_group = '{a}' THEN n END) AS \"{a}\"" for a in dims.AGE_LABELS)
        + ', CAST(NULL AS BIGINT) AS "18+"'
    ),
)
def _(spark, sf_dir):
    # A class that never occurs still becomes a column.
    return (
        monthly_openings(spark, sf_dir)
        .groupBy("month")
        .pivot("age_group", [*dims.AGE_LABELS, "18+"])
        .agg(F.first("n"))
    )


@query(
    "rsh2_wide_with_fill",
    "RSH-2",
    "NUL-2",
    sql="SELECT case_id, "
    + ", ".join(
        f"CAST(sum(CASE WHEN year(open_date) = {y} THEN 1 ELSE 0 END) AS BIGINT) AS \"{y}\""
        for y in X.YEARS
    )
    + " FROM r_linelist GROUP BY case_id",
)
def _(spark, sf_dir):
    # The years are a closed list: counts per year in one aggregate, one shuffle.
    year = F.year("open_date")
    return linelist_rows(spark, sf_dir).groupBy("case_id").agg(*[F.count_if(year == y).alias(str(y)) for y in X.YEARS])


@query(
    "rsh3_two_key_columns",
    "RSH-3",
    sql="SELECT province, "
    + ", ".join(
        f"CAST(sum(CASE WHEN dose = '{d}' AND age_band = '{b}' THEN qty END) AS BIGINT)"
        f' AS "{d}_{b}"'
        for d in dims.DOSES
        for b in dims.DOSE_BANDS
    )
    + " FROM r_dose_counts GROUP BY province",
)
def _(spark, sf_dir):
    names = [f"{d}_{b}" for d in dims.DOSES for b in dims.DOSE_BANDS]
    return (
        X.view(spark, sf_dir, "r_dose_counts")
        .withColumn("cell", F.concat_ws("_", "dose", "age_band"))
        .groupBy("province")
        .pivot("cell", names)
        .agg(F.sum("qty"))
    )


@query(
    "rsh4_two_measures",
    "RSH-4",
    sql="SELECT province, "
    + ", ".join(
        f"count(CASE WHEN dose = '{d}' THEN 1 END) AS \"{d}_rows\", "
        f"CAST(sum(CASE WHEN dose = '{d}' THEN qty END) AS BIGINT) AS \"{d}_qty\""
        for d in dims.DOSES
    )
    + " FROM r_dose_counts GROUP BY province",
)
def _(spark, sf_dir):
    wide = (
        X.view(spark, sf_dir, "r_dose_counts")
        .groupBy("province")
        .pivot("dose", list(dims.DOSES))
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("qty").alias("qty"))
    )
    return wide.fillna(0, subset=[f"{d}_rows" for d in dims.DOSES])


@query(
    "rsh5_wide_to_long",
    "RSH-5",
    sql="""
SELECT case_id, 'f_a' AS flag, f_a AS value FROM r_flags
UNION ALL SELECT case_id, 'f_b', f_b FROM r_flags
UNION ALL SELECT case_id, 'f_c', f_c FROM r_flags
UNION ALL SELECT case_id, 'f_none', f_none FROM r_flags""",
)
def _(spark, sf_dir):
    rows = X.view(spark, sf_dir, "r_flags")
    return rows.unpivot(["case_id"], list(X.FLAGS), "flag", "value")


# ------------------------------------------------------------------- windows

RUNNING = "OVER (PARTITION BY {} ORDER BY month ROWS UNBOUNDED PRECEDING)"


@query(
    "win1_running_sum",
    "WIN-1",
    sql=f"""
SELECT age_group, month, n, CAST(sum(n) {RUNNING.format("age_group")} AS BIGINT) AS cum_n
FROM openings""",
)
def _(spark, sf_dir):
    openings = monthly_openings(spark, sf_dir)
    return series.running_sums(openings, ["age_group"], "month", {"cum_n": "n"})


@query(
    "win2_running_sum_of_class",
    "WIN-2",
    sql=f"""
SELECT age_group, dose, month,
       CAST(CASE WHEN dose = '1' THEN sum(n) {RUNNING.format("age_group, dose")} ELSE 0 END
            AS BIGINT) AS cum_1
FROM national_counts""",
)
def _(spark, sf_dir):
    counts = coverage.dose_counts(X.view(spark, sf_dir, "r_dose_counts"))
    summed = series.running_sums(counts, ["age_group", "dose"], "month", {"cum": "n"})
    only = F.when(F.col("dose") == "1", F.col("cum")).otherwise(F.lit(0))
    return summed.select("age_group", "dose", "month", only.cast("bigint").alias("cum_1"))


@query(
    "win3_running_sum_in_period",
    "WIN-3",
    sql=f"""
SELECT age_group, CAST(year(month) AS INT) AS year, month,
       CAST(sum(n) {RUNNING.format("age_group, year(month)")} AS BIGINT) AS cum_n
FROM openings""",
)
def _(spark, sf_dir):
    openings = monthly_openings(spark, sf_dir).withColumn("year", F.year("month"))
    summed = series.running_sums(openings, ["age_group", "year"], "month", {"cum_n": "n"})
    return summed.drop("n")


@query(
    "win4_group_baseline",
    "WIN-4",
    sql="""
SELECT age_group, month, n, n - min(n) OVER (PARTITION BY age_group) AS over_baseline
FROM openings""",
)
def _(spark, sf_dir):
    base = F.min("n").over(W.partitionBy("age_group"))
    openings = monthly_openings(spark, sf_dir)
    return openings.withColumn("over_baseline", F.col("n") - base)


def group_deaths(spark, sf_dir, keys):
    return (
        X.view(spark, sf_dir, "r_death_register")
        .groupBy(*keys)
        .agg(F.sum("n").alias("deaths"))
    )


def _average_rank_sql(keys: str, source: str) -> str:
    return f"""
SELECT *, CAST(rank() OVER (PARTITION BY {keys} ORDER BY deaths DESC)
       + (count(*) OVER (PARTITION BY {keys}, deaths) - 1) / 2.0 AS DOUBLE) AS rank
FROM ({source}) t"""


@query(
    "win5_average_rank",
    "WIN-5",
    sql=_average_rank_sql(
        "age_group",
        "SELECT age_group, cause_name, CAST(sum(n) AS BIGINT) AS deaths "
        "FROM r_death_register GROUP BY 1, 2",
    ),
)
def _(spark, sf_dir):
    deaths = group_deaths(spark, sf_dir, ["age_group", "cause_name"])
    return deaths.withColumn("rank", series.average_rank("deaths", ["age_group"]))


@query(
    "win6_average_rank_per_year",
    "WIN-6",
    sql=_average_rank_sql(
        "year",
        "SELECT year, cause_code, CAST(sum(n) AS BIGINT) AS deaths "
        "FROM r_death_register GROUP BY 1, 2",
    ),
)
def _(spark, sf_dir):
    deaths = group_deaths(spark, sf_dir, ["year", "cause_code"])
    return deaths.withColumn("rank", series.average_rank("deaths", ["year"]))


@query(
    "win7_first_known",
    "WIN-7",
    sql="""
SELECT seq, case_id, first_value(death_date IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY seq
       ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS death_date
FROM r_linelist""",
)
def _(spark, sf_dir):
    # Reduced per case first and joined back: no task has to hold a whole case.
    rows = linelist_rows(spark, sf_dir).select("seq", "case_id", "death_date")
    known = linelist.dedup_linelist(rows, "case_id", "seq", ["death_date"]).drop("seq")
    return join_per_key(rows.drop("death_date"), known, ["case_id"])


@query(
    "win8_group_size",
    "WIN-8",
    sql="""
SELECT case_id, CASE WHEN count(*) > 1 THEN 'MULTIPLE' ELSE min(condition) END AS condition,
       count(*) AS n_rows
FROM r_long_conditions GROUP BY case_id""",
)
def _(spark, sf_dir):
    values = {c: c for c in ("c_asthma", "c_renal", "c_other", "c_none", dims.MULTIPLE)}
    rows = X.view(spark, sf_dir, "r_long_conditions").withColumn("death_date", F.current_date())
    return comorbidity.condition_from_rows(rows, values, after=None, until=None)


@query(
    "win9_period_text",
    "WIN-9",
    sql="""
SELECT cause_name, CAST(min(year) AS VARCHAR) || '-' || CAST(max(year) AS VARCHAR) AS period
FROM r_death_register GROUP BY cause_name""",
)
def _(spark, sf_dir):
    period = F.concat_ws("-", F.min("year"), F.max("year"))
    register = X.view(spark, sf_dir, "r_death_register")
    return register.groupBy("cause_name").agg(period.alias("period"))


@query(
    "win10_top_with_ties",
    "WIN-10",
    sql="""
SELECT age_group, year, cause_code, cause_name, n
FROM (SELECT *, rank() OVER (PARTITION BY year ORDER BY n DESC) AS rk FROM cause_rows) t
WHERE rk <= 3""",
)
def _(spark, sf_dir):
    return causes.top_causes(R.cause_rows(spark, sf_dir), 3)


# ------------------------------------------------------- sorts and set unions


@query(
    "srt1_ascending",
    "SRT-1",
    sql="SELECT age_group, month, n FROM openings ORDER BY month, age_group NULLS LAST",
)
def _(spark, sf_dir):
    openings = monthly_openings(spark, sf_dir)
    return openings.orderBy("month", F.asc_nulls_last("age_group"))


@query(
    "srt2_descending",
    "SRT-2",
    sql="SELECT age, count(*) AS n FROM r_linelist GROUP BY age ORDER BY n DESC NULLS LAST, age",
)
def _(spark, sf_dir):
    counts = linelist_rows(spark, sf_dir).groupBy("age").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc_nulls_last("n"), "age")


@query(
    "set1_union_all",
    "SET-1",
    sql="""
SELECT case_id, death_date FROM r_flags
UNION ALL SELECT case_id, death_date FROM r_long_conditions""",
)
def _(spark, sf_dir):
    a = X.view(spark, sf_dir, "r_flags").select("death_date", "case_id")
    b = X.view(spark, sf_dir, "r_long_conditions").select("case_id", "death_date")
    return a.unionByName(b)


# ------------------------------------------------------- conditions and nulls


@query(
    "cnd1_banding",
    "CND-1",
    "CND-2",
    sql=f"""
SELECT seq, {R.AGE_CASE} AS closed,
       CASE WHEN age < 3 THEN '0-2' WHEN age < 12 THEN '3-11' ELSE '12-17' END AS catch_all
FROM r_linelist""",
)
def _(spark, sf_dir):
    return linelist_rows(spark, sf_dir).select(
        "seq",
        age_band("age").alias("closed"),
        age_band("age", closed_top=False).alias("catch_all"),
    )


@query(
    "cnd3_precedence",
    "CND-3",
    "CND-4",
    sql="""
SELECT seq, CASE WHEN booster <> '' THEN 3 WHEN second_dose <> '' THEN 2
                 WHEN first_dose <> '' THEN 1 ELSE 0 END AS level,
       CASE WHEN booster <> '' OR second_dose <> '' THEN 'd2plus'
            WHEN first_dose <> '' THEN 'd1' ELSE 'd0' END AS class
FROM r_linelist""",
)
def _(spark, sf_dir):
    level = dose_level("first_dose", "second_dose", "booster")
    rows = linelist_rows(spark, sf_dir)
    return rows.select("seq", level.alias("level"), dose_class(level).alias("class"))


@query(
    "cnd5_label_dictionary",
    "CND-5",
    sql=f"""
SELECT case_id, {R._label_case("condition", X.ROW_LABELS)} AS condition
FROM r_long_conditions""",
)
def _(spark, sf_dir):
    rows = X.view(spark, sf_dir, "r_long_conditions")
    return rows.select("case_id", recode("condition", X.ROW_LABELS).alias("condition"))


@query(
    "cnd6_code_ranges",
    "CND-6",
    sql="""
SELECT r.year, r.cause_code, r.n, coalesce(g.cause_group_short, 'Others') AS cause_group_short
FROM r_death_register r LEFT JOIN code_groups g ON r.cause_code = g.code""",
)
def _(spark, sf_dir):
    rows = X.view(spark, sf_dir, "r_death_register").select("year", "cause_code", "n")
    return causes.cause_group(rows).drop("cause_group")


@query(
    "cnd7_month_numbers",
    "CND-7",
    sql=f"SELECT province, month_es, CAST({R.MONTH_CASE} AS INT) AS month FROM r_dose_counts",
)
def _(spark, sf_dir):
    rows = X.view(spark, sf_dir, "r_dose_counts")
    return rows.select("province", "month_es", month_number("month_es").alias("month"))


@query(
    "cnd8_ordered_labels",
    "CND-8",
    sql="""
SELECT m.label, m.ord, CAST(sum(d.qty) AS BIGINT) AS qty
FROM r_dose_counts d JOIN (VALUES ('1', '1+ doses', 0), ('2', '2+ doses', 1),
                           ('3', '3+ doses', 2)) AS m(dose, label, ord) ON d.dose = m.dose
GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    labels = literal_table(
        spark,
        [(dose, label, i) for i, (dose, label) in enumerate(dims.DOSE_DISPLAY.items())],
        (("dose", "string"), ("label", "string"), ("ord", "int")),
    )
    rows = X.view(spark, sf_dir, "r_dose_counts").join(labels, "dose")
    return rows.groupBy("label", "ord").agg(F.sum("qty").alias("qty")).orderBy("ord")


@query(
    "cnd9_threshold",
    "CND-9",
    sql="""
SELECT CASE WHEN year <= 1998 THEN 'pre-vac' ELSE 'post-vac' END AS phase, cause_name,
       CAST(sum(n) AS BIGINT) AS n
FROM r_death_register GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    phase = F.when(F.col("year") <= 1998, F.lit("pre-vac")).otherwise(F.lit("post-vac"))
    register = X.view(spark, sf_dir, "r_death_register")
    return register.groupBy(phase.alias("phase"), "cause_name").agg(F.sum("n").alias("n"))


@query(
    "nul1_fill_columns",
    "NUL-1",
    "NUL-3",
    sql="""
SELECT case_id, coalesce(condition, 'NOREPORTADO') AS condition,
       coalesce(year(death_date), 0) AS death_year
FROM r_long_conditions""",
)
def _(spark, sf_dir):
    return (
        X.view(spark, sf_dir, "r_long_conditions")
        .fillna({"condition": dims.NONE_REPORTED})
        .select(
            "case_id",
            "condition",
            F.coalesce(F.year("death_date"), F.lit(0)).alias("death_year"),
        )
    )


# --------------------------------------------------- dates, text, mathematics


@query(
    "dat1_parse_text",
    "DAT-1",
    sql="""
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS parsed
FROM orders""",
)
def _(spark, sf_dir):
    text = F.when(
        F.col("o_orderstatus") == "P", F.concat(F.lit("31/02/"), F.year("o_orderdate"))
    ).otherwise(F.date_format("o_orderdate", TEXT_DATES))
    return X.table(spark, sf_dir, "orders").select("o_orderkey", parse_dmy(text).alias("parsed"))


@query(
    "dat2_date_parts",
    "DAT-2",
    "DAT-3",
    "DAT-5",
    sql="""
SELECT seq, strftime(open_date, '%Y-%m') AS year_month,
       CAST(date_trunc('month', open_date) AS DATE) AS month, CAST(year(open_date) AS INT) AS year
FROM r_linelist""",
)
def _(spark, sf_dir):
    return linelist_rows(spark, sf_dir).select(
        "seq",
        year_month("open_date").alias("year_month"),
        month_start("open_date").alias("month"),
        F.year("open_date").alias("year"),
    )


@query("dat4_month_from_parts", "DAT-4", sql="SELECT year, month_es, month FROM dose_rows")
def _(spark, sf_dir):
    rows = X.view(spark, sf_dir, "r_dose_counts")
    month = month_from_parts("year", month_number("month_es"))
    return rows.select("year", "month_es", month.alias("month"))


@query(
    "str1_concatenate",
    "STR-1",
    "STR-2",
    sql="""
SELECT p_partkey, p_type || ':' || p_brand AS joined,
       substr(p_type, 1, 1) || lpad(CAST(p_size AS VARCHAR), 2, '0') AS code
FROM part""",
)
def _(spark, sf_dir):
    code = F.concat(
        F.substring("p_type", 1, 1), F.lpad(F.col("p_size").cast("string"), 2, "0")
    )
    return X.table(spark, sf_dir, "part").select(
        "p_partkey", F.concat("p_type", F.lit(":"), "p_brand").alias("joined"), code.alias("code")
    )


@query(
    "str3_replace",
    "STR-3",
    "STR-4",
    sql="""
SELECT p_partkey, p_name || ', ' || p_type AS spaced, p_name AS stripped
FROM part""",
)
def _(spark, sf_dir):
    label = F.concat("p_name", F.lit(","), "p_type")
    coded = F.concat("p_name", F.lit(" ("), "p_type", F.lit(",x) (y)"))
    return X.table(spark, sf_dir, "part").select(
        "p_partkey",
        spaced_commas(label).alias("spaced"),
        without_code_suffix(coded).alias("stripped"),
    )


@query(
    "str5_lookahead",
    "STR-5",
    sql="""
SELECT o_orderkey, CASE WHEN o_custkey % 100 = 0 THEN ' 0*  '
                        ELSE ' ' || CAST(o_custkey % 100 AS VARCHAR) || ' ' END AS cell
FROM orders""",
)
def _(spark, sf_dir):
    cell = annotate_zero(padded_cell(F.col("o_custkey") % 100))
    return X.table(spark, sf_dir, "orders").select("o_orderkey", cell.alias("cell"))


@query(
    "str6_number_format",
    "STR-6",
    sql="""
SELECT l_orderkey, l_linenumber, printf('%.2f', l_quantity / 8) AS fixed,
       CAST(CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS VARCHAR) || '%' AS pct
FROM lineitem""",
)
def _(spark, sf_dir):
    return X.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        fixed_decimals(F.col("l_quantity") / 8).alias("fixed"),
        percent_text(F.col("l_quantity") / 2).alias("pct"),
    )


@query(
    "mth1_rates",
    "MTH-1",
    "MTH-2",
    "MTH-3",
    "MTH-4",
    "MTH-5",
    sql="""
SELECT l_orderkey, l_linenumber,
       round(100000.0 * l_linenumber / nullif(l_quantity - 5, 0), 6) AS rate,
       round(100.0 * l_linenumber / nullif(l_quantity - 5, 0), 6) AS pct,
       round(100.0 - 100.0 * l_linenumber / nullif(l_quantity - 5, 0), 6) + 0.0 AS rest,
       round(CASE WHEN 100.0 * l_linenumber / nullif(l_quantity - 5, 0) > 100 THEN 100.0
                  WHEN 100.0 * l_linenumber / nullif(l_quantity - 5, 0) < 0 THEN 0.0
                  ELSE 100.0 * l_linenumber / nullif(l_quantity - 5, 0) END, 6) AS limited,
       round_even(l_quantity / 4, 1) AS even, round(l_quantity * 0.4, 6) AS part
FROM lineitem""",
)
def _(spark, sf_dir):
    base = F.col("l_quantity") - 5
    pct = percent("l_linenumber", base)
    rows = X.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        per_population("l_linenumber", base).alias("rate"),
        pct.alias("pct"),
        complement(pct).alias("rest"),
        clamp(pct).alias("limited"),
        half_even(F.col("l_quantity") / 4, 1).alias("even"),
        (F.col("l_quantity") * 2 / 5).alias("part"),
    )
    return R.rounded(rows, "rate", "pct", "rest", "limited", "part")


@query(
    "row1_flags",
    "ROW-1",
    "ROW-2",
    sql="""
SELECT case_id, CAST(f_a AS INT) + CAST(f_b AS INT) + CAST(f_c AS INT) + CAST(f_none AS INT)
           AS n_set,
       CASE WHEN f_a = '1' THEN 'f_a' WHEN f_b = '1' THEN 'f_b' WHEN f_c = '1' THEN 'f_c'
            WHEN f_none = '1' THEN 'f_none' END AS first_set
FROM r_flags""",
)
def _(spark, sf_dir):
    return X.view(spark, sf_dir, "r_flags").select(
        "case_id", flag_count(X.FLAGS).alias("n_set"), first_flag(X.FLAGS).alias("first_set")
    )
