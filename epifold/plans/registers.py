"""The library's operators on the role tables, each with its SQL check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epifold import dims
from epifold.functions import (
    age_band,
    dose_class,
    dose_level,
    dose_status,
    recode,
    spaced_commas,
    without_code_suffix,
)
from epifold.operators import (
    causes,
    comorbidity,
    coverage,
    geo,
    incidence,
    linelist,
    population,
    reports,
    series,
)
from epifold.plans import fixtures as X
from epifold.plans.registry import part, query
from epifold.sources.literals import timeline
from epifold.sources import files
from epifold.sources.storage import cut, scratch_path

AGE_CASE = """CASE WHEN age < 3 THEN '0-2' WHEN age >= 3 AND age < 12 THEN '3-11'
         WHEN age >= 12 AND age < 18 THEN '12-17' END"""
OVERRIDE_CASE = (
    "CASE "
    + " ".join(f"WHEN case_id = {k} THEN DATE '{d}'" for k, d in X.OVERRIDES)
    + " ELSE death_date END"
)


def series_sql(start: str, end: str, step: str) -> str:
    return (
        f"(SELECT CAST(g AS DATE) AS point FROM "
        f"generate_series(DATE '{start}', DATE '{end}', INTERVAL 1 {step}) AS t(g))"
    )


MONTHS_SQL = series_sql(*X.MONTHS, "MONTH")
DAYS_SQL = series_sql(*X.DAYS, "DAY")


def months():
    return series.Calendar(*X.MONTHS, "month")


def days():
    return series.Calendar(*X.DAYS, "day")


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    """Doubles to six places, for comparison with the SQL check."""
    return df.withColumns({c: F.round(c, 6) for c in cols})


# ---------------------------------------------------------------- line list

part(
    "corrected",
    f"SELECT seq, case_id, age, open_date, {OVERRIDE_CASE} AS death_date FROM r_linelist",
)
part(
    "cases",
    f"""
SELECT case_id, seq, age, open_date, death_date, {AGE_CASE} AS age_group
FROM (SELECT case_id, seq, age, open_date,
             first_value(death_date IGNORE NULLS) OVER (
                 PARTITION BY case_id ORDER BY seq
                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS death_date,
             row_number() OVER (PARTITION BY case_id ORDER BY seq) AS rn
      FROM corrected) t
WHERE rn = 1""",
)


def corrected(spark, sf_dir):
    rows = X.view(spark, sf_dir, "r_linelist").select(
        "seq", "case_id", "age", "open_date", "death_date"
    )
    return linelist.apply_overrides(rows, X.OVERRIDES, "case_id", "death_date")


def cases(spark, sf_dir):
    single = linelist.dedup_linelist(
        corrected(spark, sf_dir), "case_id", "seq", best_of=["death_date"]
    )
    return single.withColumn("age_group", age_band("age"))


@query("point_corrections", "PIPE-1", sql="SELECT * FROM corrected")
def _(spark, sf_dir):
    return corrected(spark, sf_dir)


@query(
    "linelist_deduplicated",
    "PIPE-2",
    sql="SELECT case_id, seq, age, open_date, death_date FROM cases",
)
def _(spark, sf_dir):
    return cases(spark, sf_dir).drop("age_group")


@query(
    "linelist_first_records",
    "PIPE-3",
    sql="""
SELECT seq, case_id, age, open_date, death_date, first_dose, second_dose, booster
FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS rn FROM r_linelist) t
WHERE rn = 1""",
)
def _(spark, sf_dir):
    return linelist.first_record(X.view(spark, sf_dir, "r_linelist"), "case_id", "seq")


@query(
    "age_bands",
    "PIPE-4",
    sql=f"""
SELECT seq, age, {AGE_CASE} AS closed_band,
       CASE WHEN age < 3 THEN '0-2' WHEN age > 2 AND age < 12 THEN '3-11' ELSE '12-17' END
           AS open_band
FROM r_linelist""",
)
def _(spark, sf_dir):
    return X.view(spark, sf_dir, "r_linelist").select(
        "seq",
        "age",
        age_band("age").alias("closed_band"),
        age_band("age", closed_top=False).alias("open_band"),
    )


part(
    "monthly_death_counts",
    f"""
SELECT age_group, CAST(date_trunc('month', death_date) AS DATE) AS month, count(*) AS n
FROM cases WHERE death_date IS NOT NULL AND death_date <= DATE '{X.CAP}' GROUP BY 1, 2""",
)
part(
    "monthly_deaths_dense",
    f"""
SELECT coalesce(g.age_group, c.age_group) AS age_group,
       coalesce(g.month, c.month) AS month, coalesce(c.n, 0) AS n
FROM (SELECT k.age_group, p.point AS month
      FROM (SELECT DISTINCT age_group FROM monthly_death_counts) k CROSS JOIN {MONTHS_SQL} p) g
FULL JOIN monthly_death_counts c
  ON g.age_group IS NOT DISTINCT FROM c.age_group AND g.month = c.month""",
)


def monthly_deaths(spark, sf_dir):
    return linelist.monthly_counts(
        cases(spark, sf_dir), "death_date", ["age_group"], X.CAP, months()
    )


def monthly_cases(spark, sf_dir):
    return linelist.monthly_counts(cases(spark, sf_dir), "open_date", ["age_group"], X.CAP)


@query(
    "monthly_cases",
    "PIPE-5",
    sql=f"""
SELECT age_group, CAST(date_trunc('month', open_date) AS DATE) AS month, count(*) AS n
FROM cases WHERE open_date <= DATE '{X.CAP}' GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    return monthly_cases(spark, sf_dir)


@query("monthly_deaths", "PIPE-6", sql="SELECT age_group, month, n FROM monthly_deaths_dense")
def _(spark, sf_dir):
    return monthly_deaths(spark, sf_dir)


@query(
    "monthly_death_totals",
    "PIPE-7",
    sql="SELECT month, CAST(sum(n) AS BIGINT) AS n FROM monthly_deaths_dense GROUP BY month",
)
def _(spark, sf_dir):
    return series.period_totals(monthly_deaths(spark, sf_dir), "month")


LEVEL_CASE = """CASE WHEN booster <> '' THEN 3 WHEN second_dose <> '' THEN 2
            WHEN first_dose <> '' THEN 1 ELSE 0 END"""


@query(
    "dose_status",
    "PIPE-8",
    sql="""
SELECT seq, CASE WHEN booster <> '' THEN 'refuerzo' WHEN second_dose <> '' THEN '2da'
                 WHEN first_dose <> '' THEN '1ra' ELSE '' END AS status,
       CASE WHEN booster <> '' OR second_dose <> '' THEN 'd2plus'
            WHEN first_dose <> '' THEN 'd1' ELSE 'd0' END AS dose_class
FROM r_linelist""",
)
def _(spark, sf_dir):
    level = dose_level("first_dose", "second_dose", "booster")
    return X.view(spark, sf_dir, "r_linelist").select(
        "seq", dose_status(level).alias("status"), dose_class(level).alias("dose_class")
    )


part(
    "deaths",
    f"""
SELECT case_id, {OVERRIDE_CASE} AS death_date, level,
       CASE WHEN age < 3 THEN '0-2' WHEN age < 12 THEN '3-11' ELSE '12-17' END AS age_group
FROM (SELECT *, {LEVEL_CASE} AS level,
             row_number() OVER (PARTITION BY case_id ORDER BY seq) AS rn FROM r_linelist) t
WHERE rn = 1 AND age < 18""",
)


def deaths(spark, sf_dir):
    rows = X.view(spark, sf_dir, "r_linelist").select(
        "case_id",
        "seq",
        "age",
        "death_date",
        dose_level("first_dose", "second_dose", "booster").alias("level"),
    )
    first = linelist.child_records(linelist.first_record(rows, "case_id", "seq"))
    return linelist.apply_overrides(first, X.OVERRIDES, "case_id", "death_date")


@query(
    "daily_cumulative_deaths",
    "PIPE-9",
    sql=f"""
SELECT age_group, date, n,
       CAST(sum(n) OVER (PARTITION BY age_group ORDER BY date NULLS LAST
                         ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_n
FROM (SELECT coalesce(g.age_group, c.age_group) AS age_group,
             coalesce(g.date, c.date) AS date, coalesce(c.n, 0) AS n
      FROM (SELECT k.age_group, p.point AS date
            FROM (SELECT DISTINCT age_group FROM deaths) k CROSS JOIN {DAYS_SQL} p) g
      FULL JOIN (SELECT age_group, death_date AS date, count(*) AS n
                 FROM deaths GROUP BY 1, 2) c
        ON g.age_group = c.age_group AND g.date = c.date) t""",
)
def _(spark, sf_dir):
    return linelist.daily_cumulative(deaths(spark, sf_dir), "death_date", ["age_group"], days())


part(
    "daily_wide",
    f"""
SELECT *,
       CAST(sum(d0) OVER w AS BIGINT) AS cum_0, CAST(sum(d1) OVER w AS BIGINT) AS cum_1,
       CAST(sum(d2plus) OVER w AS BIGINT) AS cum_2
FROM (SELECT coalesce(g.age_group, c.age_group) AS age_group, coalesce(g.date, c.date) AS date,
             coalesce(c.d0, 0) AS d0, coalesce(c.d1, 0) AS d1, coalesce(c.d2plus, 0) AS d2plus
      FROM (SELECT k.age_group, p.point AS date
            FROM (SELECT DISTINCT age_group FROM deaths) k CROSS JOIN {DAYS_SQL} p) g
      FULL JOIN (SELECT age_group, death_date AS date, count(*) FILTER (level = 0) AS d0,
                        count(*) FILTER (level = 1) AS d1, count(*) FILTER (level >= 2) AS d2plus
                 FROM deaths GROUP BY 1, 2) c
        ON g.age_group = c.age_group AND g.date = c.date) t
WINDOW w AS (PARTITION BY age_group ORDER BY date NULLS LAST ROWS UNBOUNDED PRECEDING)""",
)


def daily_wide(spark, sf_dir):
    return linelist.daily_by_status(
        deaths(spark, sf_dir), "death_date", "level", ["age_group"], days()
    )


@query("daily_deaths_by_status", "PIPE-10", sql="SELECT * FROM daily_wide")
def _(spark, sf_dir):
    return daily_wide(spark, sf_dir)


INGEST_NAMES = {
    "case_id": "case_id",
    "age": "age",
    "open_date": "open_date",
    "death_date": "death_date",
    "first_dose": "first_dose",
    "seq": "seq",
}


@query(
    "linelist_ingest",
    "PIPE-43",
    sql="""
SELECT case_id, age, open_date, death_date, first_dose, seq FROM r_linelist
UNION ALL
SELECT case_id, age, open_date, death_date, second_dose AS first_dose, seq FROM r_linelist""",
)
def _(spark, sf_dir):
    rows = X.view(spark, sf_dir, "r_linelist")
    # A second layout: other names, other positions, one column more.
    other = rows.select(
        F.col("second_dose").alias("PRIMERA"),
        F.col("seq").alias("ORDEN"),
        F.col("death_date").alias("FECHA_FALLECIMIENTO"),
        F.col("open_date").alias("FECHA_APERTURA"),
        F.col("age").alias("EDAD_APERTURA"),
        F.col("case_id").alias("IDEVENTOCASO"),
        F.col("booster").alias("REFUERZO"),
    )
    names = {
        "IDEVENTOCASO": "case_id",
        "EDAD_APERTURA": "age",
        "FECHA_APERTURA": "open_date",
        "FECHA_FALLECIMIENTO": "death_date",
        "PRIMERA": "first_dose",
        "ORDEN": "seq",
    }
    path = scratch_path(spark, "linelist")
    return linelist.ingest_linelist(rows, other, path, INGEST_NAMES, names, order="seq")


@query(
    "linelist_arrival",
    "PIPE-43",
    sql="""
SELECT case_id, age, open_date FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS k FROM r_linelist
) WHERE k = 1""",
)
def _(spark, sf_dir):
    # Files of unequal size as they arrive, none with more than a thirtieth of all rows;
    # the later ones are packed; no order is given.
    rows = X.view(spark, sf_dir, "r_linelist").select("seq", "case_id", "age", "open_date")
    until = (rows.agg(F.max("seq")).first()[0] or 0) + 1
    size = F.least(F.lit(63), F.floor(F.sqrt(F.col("seq") / until) * 64)).cast("int")
    dealt = rows.withColumn("_size", size).repartitionById(64, "_size").sortWithinPartitions("seq")
    plain, packed = scratch_path(spark, "arrival-plain"), scratch_path(spark, "arrival-packed")
    early = F.col("_size") < 20
    dealt.where(early).drop("_size").write.option("header", True).csv(plain)
    files.write_csv_gzip(dealt.where(~early).drop("_size"), packed)
    first = files.read_csv(spark, plain, rows.schema, position=True)
    second = files.read_csv(spark, packed, rows.schema, position=True, partitions=8)
    names = {c: c for c in ("case_id", "age", "open_date")}
    lines = linelist.ingest_linelist(first, second, scratch_path(spark, "arrival"), names)
    return linelist.first_record(lines, "case_id").drop("seq")


INTERVALS_SQL = "(VALUES " + ", ".join(
    f"('{e}', '{g}', DATE '{a}', DATE '{b}')" for e, g, a, b in X.INTERVALS
) + ") AS i(event, event_group, start_date, end_date)"


@query(
    "interval_annotation",
    "PIPE-44",
    "SRC-4",
    sql=f"""
SELECT m.month, m.age_group, m.n, i.event, i.event_group
FROM monthly_deaths_dense m JOIN {INTERVALS_SQL}
  ON i.start_date <= last_day(m.month) AND i.end_date >= m.month""",
)
def _(spark, sf_dir):
    return reports.annotate_intervals(
        monthly_deaths(spark, sf_dir), timeline(spark, X.INTERVALS)
    )


# ---------------------------------------------- population, coverage, incidence

part(
    "pop_province",
    """
SELECT province, age_group, sum(CAST(n AS BIGINT) * share) / 5.0 AS population
FROM r_population JOIN (VALUES ('0 a 4', '0-2', 3), ('0 a 4', '3-11', 2), ('5 a 9', '3-11', 5),
     ('10 a 14', '3-11', 2), ('10 a 14', '12-17', 3), ('15 a 19', '12-17', 3))
     AS w(band, age_group, share) ON band5 = w.band
GROUP BY 1, 2""",
)
part(
    "pop_national",
    "SELECT age_group, sum(population) AS population FROM pop_province GROUP BY 1",
)


def pop_province(spark, sf_dir):
    return population.apportion(X.view(spark, sf_dir, "r_population"))


def pop_national(spark, sf_dir):
    return population.apportion(X.view(spark, sf_dir, "r_population"), keys=())


@query(
    "population_by_province",
    "PIPE-11",
    sql="SELECT province, age_group, round(population, 6) AS population FROM pop_province",
)
def _(spark, sf_dir):
    return rounded(pop_province(spark, sf_dir), "population")


@query(
    "population_national",
    "PIPE-12",
    sql="""
SELECT province, age_group, round(population, 6) AS population, FALSE AS is_national
FROM pop_province
UNION ALL
SELECT NULL, age_group, round(population, 6), TRUE FROM pop_national""",
)
def _(spark, sf_dir):
    pop = X.view(spark, sf_dir, "r_population")
    return rounded(population.population_with_national(pop), "population")


MONTH_CASE = (
    "CASE month_es " + " ".join(f"WHEN '{m}' THEN {i}" for m, i in dims.MONTHS_ES.items()) + " END"
)
part(
    "dose_rows",
    f"""
SELECT *, make_date(CAST(year AS BIGINT), CAST({MONTH_CASE} AS BIGINT), CAST(1 AS BIGINT)) AS month,
       CASE age_band WHEN '0-2' THEN '0-2' WHEN '3-4' THEN '3-11' WHEN '5-11' THEN '3-11'
            WHEN '12-17' THEN '12-17' END AS age_group
FROM r_dose_counts""",
)
part(
    "national_counts",
    """
SELECT age_group, dose, month, CAST(sum(qty) AS BIGINT) AS n FROM dose_rows
WHERE province IS NOT NULL AND sex IS NOT NULL AND year IS NOT NULL AND month IS NOT NULL
  AND age_band IS NOT NULL AND qty IS NOT NULL AND dose IS NOT NULL AND age_group IS NOT NULL
GROUP BY 1, 2, 3""",
)
part(
    "national_doses",
    f"""
SELECT age_group, month,
       CAST(sum(CASE WHEN dose = '1' THEN cum ELSE 0 END) AS BIGINT) AS doses_1,
       CAST(sum(CASE WHEN dose = '2' THEN cum ELSE 0 END) AS BIGINT) AS doses_2,
       CAST(sum(CASE WHEN dose = '3' THEN cum ELSE 0 END) AS BIGINT) AS doses_3
FROM (SELECT age_group, dose, month,
             sum(n) OVER (PARTITION BY age_group, dose ORDER BY month
                          ROWS UNBOUNDED PRECEDING) AS cum
      FROM (SELECT coalesce(g.age_group, c.age_group) AS age_group,
                   coalesce(g.dose, c.dose) AS dose, coalesce(g.month, c.month) AS month,
                   coalesce(c.n, 0) AS n
            FROM (SELECT a.age_group, d.dose, p.point AS month
                  FROM (SELECT DISTINCT age_group FROM national_counts) a
                  CROSS JOIN (SELECT DISTINCT dose FROM national_counts) d
                  CROSS JOIN {MONTHS_SQL} p) g
            FULL JOIN national_counts c
              ON g.age_group = c.age_group AND g.dose = c.dose AND g.month = c.month) f
      WHERE month < DATE '{X.DOSES_BEFORE}') t
GROUP BY 1, 2""",
)


def national_doses(spark, sf_dir):
    return coverage.cumulative_doses_wide(
        X.view(spark, sf_dir, "r_dose_counts"), months(), X.DOSES_BEFORE
    )


@query("dose_counts_national", "PIPE-13", sql="SELECT * FROM national_counts")
def _(spark, sf_dir):
    return coverage.dose_counts(X.view(spark, sf_dir, "r_dose_counts"))


@query("cumulative_doses_national", "PIPE-14", sql="SELECT * FROM national_doses")
def _(spark, sf_dir):
    return national_doses(spark, sf_dir)


part(
    "exposure",
    """
SELECT d.*, p.population, v.doses_1, v.doses_2, v.doses_3
FROM daily_wide d JOIN pop_national p ON d.age_group = p.age_group
LEFT JOIN national_doses v ON d.date = v.month AND d.age_group = v.age_group""",
)


def exposure(spark, sf_dir):
    return incidence.join_exposure(
        daily_wide(spark, sf_dir), pop_national(spark, sf_dir), national_doses(spark, sf_dir)
    )


@query(
    "death_exposure",
    "PIPE-15",
    sql="SELECT * EXCLUDE (population), round(population, 6) AS population FROM exposure",
)
def _(spark, sf_dir):
    return rounded(exposure(spark, sf_dir), "population")


part(
    "incidence_rates",
    f"""
SELECT age_group, date,
       CASE WHEN doses_1 IS NULL THEN NULL
            WHEN doses_1 > 0 THEN 100000.0 * (cum_0 - b0) / nullif(population - doses_1, 0)
            ELSE 100000.0 * d0 / nullif(population, 0) END AS inc0_cum,
       CASE WHEN doses_2 IS NULL THEN NULL
            WHEN doses_2 > 0
            THEN 100000.0 * (cum_0 + cum_1 - b0 - b1) / nullif(population - doses_2, 0)
            ELSE 100000.0 * d0 / nullif(population, 0) END AS inc0b_cum,
       CASE WHEN doses_1 IS NULL THEN NULL
            WHEN doses_1 > 0 THEN 100000.0 * (cum_1 + cum_2 - b1 - b2) / doses_1
            ELSE 0.0 END AS inc1_cum,
       CASE WHEN doses_1 IS NULL THEN NULL
            WHEN doses_1 > 0 THEN 100000.0 * (cum_1 - b1) / doses_1 ELSE 0.0 END AS inc1e_cum,
       CASE WHEN doses_2 > 0 THEN 100000.0 * (cum_2 - b2) / doses_2 ELSE 0.0 END AS inc2_cum
FROM (SELECT *, min(cum_0) OVER w AS b0, min(cum_1) OVER w AS b1, min(cum_2) OVER w AS b2
      FROM exposure
      WHERE date >= DATE '{X.BASELINE[0]}' AND date < DATE '{X.BASELINE[1]}'
        AND day(date) = 1
      WINDOW w AS (PARTITION BY age_group)) t""",
)
RATES = list(dims.INCIDENCE_LABELS)


def rates(spark, sf_dir):
    return incidence.cumulative_incidence(exposure(spark, sf_dir), *X.BASELINE)


@query(
    "cumulative_incidence",
    "PIPE-16",
    sql="SELECT age_group, date, "
    + ", ".join(f"round({r}, 6) + 0.0 AS {r}" for r in RATES)
    + " FROM incidence_rates",
)
def _(spark, sf_dir):
    return rounded(rates(spark, sf_dir).select("age_group", "date", *RATES), *RATES)


part(
    "incidence_rows",
    " UNION ALL ".join(
        f"""
SELECT age_group || ' years old' AS age_label, date, '{label}' AS dose_label, {rate} AS incidence
FROM incidence_rates
WHERE date BETWEEN DATE '{X.REPORT_YEAR[0]}' AND DATE '{X.REPORT_YEAR[1]}'"""
        for rate, label in dims.INCIDENCE_LABELS.items()
    ),
)


@query(
    "incidence_long",
    "PIPE-17",
    sql="""
SELECT age_label, date, dose_label, round(incidence, 6) + 0.0 AS incidence FROM incidence_rows
WHERE NOT (age_label = '0-2 years old' AND dose_label IN ('1+ doses', '2+ doses'))""",
)
def _(spark, sf_dir):
    return rounded(incidence.incidence_long(rates(spark, sf_dir), *X.REPORT_YEAR), "incidence")


@query(
    "latest_incidence",
    "PIPE-18",
    sql="""
SELECT age_label, date, dose_label, round(incidence, 6) + 0.0 AS incidence FROM incidence_rows
WHERE date = (SELECT max(date) FROM incidence_rows WHERE date <= DATE '1999-11-30')
  AND dose_label IN ('0 dose', '1+ doses', '2+ doses', '3+ doses')""",
)
def _(spark, sf_dir):
    # Report-sized and read twice, for the maximum and for the rows at it.
    long = cut(incidence.incidence_long(rates(spark, sf_dir), *X.REPORT_YEAR, empty=()))
    latest = series.latest_point(long, "date", until="1999-11-30")
    return rounded(
        latest.where(F.col("dose_label").isin(*dims.LABELLED_INCIDENCE)), "incidence"
    )


part(
    "coverage_rows",
    """
SELECT v.age_group, v.month, p.population, k.dose_label,
       CASE k.dose_label WHEN '0 dose' THEN 100.0 - 100.0 * v.doses_1 / p.population
            WHEN '1+ doses' THEN 100.0 * v.doses_1 / p.population
            WHEN '2+ doses' THEN 100.0 * v.doses_2 / p.population
            ELSE 100.0 * v.doses_3 / p.population END AS pct
FROM national_doses v JOIN pop_national p ON v.age_group = p.age_group
CROSS JOIN (VALUES ('0 dose'), ('1+ doses'), ('2+ doses'), ('3+ doses')) AS k(dose_label)""",
)


def coverage_rows(spark, sf_dir):
    return coverage.coverage_long(national_doses(spark, sf_dir), pop_national(spark, sf_dir))


@query(
    "coverage_long",
    "PIPE-19",
    sql="""
SELECT age_group, month, round(population, 6) AS population, dose_label, round(pct, 6) AS pct
FROM coverage_rows""",
)
def _(spark, sf_dir):
    return rounded(coverage_rows(spark, sf_dir), "population", "pct")


@query(
    "latest_coverage",
    "PIPE-18",
    sql="""
SELECT age_group, month, dose_label, round(pct, 6) AS pct
FROM (SELECT *, max(month) OVER (PARTITION BY age_group, dose_label) AS top FROM coverage_rows) t
WHERE month = top""",
)
def _(spark, sf_dir):
    rows = cut(coverage_rows(spark, sf_dir))
    latest = series.latest_point(rows, "month", ["age_group", "dose_label"])
    return rounded(latest.drop("population"), "pct")


@query(
    "coverage_report",
    "PIPE-20",
    sql="SELECT age_group, "
    + ", ".join(
        f"max(CASE WHEN dose_label = '{k}' "
        f"THEN CAST(CAST(round_even(pct, 0) AS BIGINT) AS VARCHAR) || '%' END) AS \"{k}\""
        for k in ("0 dose", "1+ doses", "2+ doses", "3+ doses")
    )
    + f""", round_even(max(population), 0) AS population
FROM coverage_rows WHERE month = DATE '{X.SNAPSHOT}' GROUP BY age_group""",
)
def _(spark, sf_dir):
    return coverage.coverage_report(coverage_rows(spark, sf_dir), X.SNAPSHOT)


def _earliest_sql(drop_group: bool) -> str:
    undated = "AND NOT undated" if drop_group else ""
    return f"""
SELECT age_group, dose_name, dose_date, province, count(*) AS n
FROM (SELECT *, min(dose_date) OVER w AS first_date, bool_or(dose_date IS NULL) OVER w AS undated
      FROM (SELECT person_id, province, age_group, dose_date,
                   CASE dose_name WHEN 'Adicional' THEN 'Refuerzo' WHEN 'Unica' THEN '1ra'
                        ELSE dose_name END AS dose_name
            FROM r_person_dose WHERE province <> 'S.I.') s
      WINDOW w AS (PARTITION BY person_id, dose_name)) t
WHERE dose_date = first_date {undated}
GROUP BY 1, 2, 3, 4"""


@query("earliest_doses", "PIPE-21", sql=_earliest_sql(True))
def _(spark, sf_dir):
    return coverage.earliest_doses(X.view(spark, sf_dir, "r_person_dose"))


@query("earliest_doses_dated", "PIPE-21", sql=_earliest_sql(False))
def _(spark, sf_dir):
    return coverage.earliest_doses(X.view(spark, sf_dir, "r_person_dose"), null_policy="ignore")


part(
    "province_counts",
    """
SELECT province, age_group, dose, month, CAST(sum(qty) AS BIGINT) AS n FROM dose_rows
WHERE age_band IN ('0-2', '3-4', '5-11', '12-17') GROUP BY 1, 2, 3, 4""",
)
part(
    "province_rows",
    f"""
SELECT g.province, g.month, g.age_group,
       CASE g.dose WHEN '1' THEN '1ra' WHEN '2' THEN '2da' ELSE '3ra o más' END AS dose_name,
       coalesce(c.n, 0) AS n,
       CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY g.province, g.age_group, g.dose
            ORDER BY g.month ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_n, q.population
FROM (SELECT p.province, a.age_group, d.dose, m.point AS month
      FROM (SELECT DISTINCT province FROM province_counts) p
      CROSS JOIN (SELECT DISTINCT age_group FROM province_counts) a
      CROSS JOIN (SELECT DISTINCT dose FROM province_counts) d CROSS JOIN {MONTHS_SQL} m) g
LEFT JOIN province_counts c ON g.province = c.province AND g.age_group = c.age_group
     AND g.dose = c.dose AND g.month = c.month
LEFT JOIN pop_province q ON g.province = q.province AND g.age_group = q.age_group""",
)


def province_rows(spark, sf_dir):
    return coverage.provincial_coverage(
        X.view(spark, sf_dir, "r_dose_counts"), pop_province(spark, sf_dir), months()
    )


@query(
    "provincial_coverage",
    "PIPE-22",
    sql="""
SELECT province, month, age_group, dose_name, n, cum_n, round(population, 6) AS population,
       round(100.0 * cum_n / nullif(population, 0), 6) AS pct FROM province_rows""",
)
def _(spark, sf_dir):
    return rounded(province_rows(spark, sf_dir), "population", "pct")


@query(
    "provincial_coverage_display",
    "PIPE-23",
    sql="""
SELECT province, month, age_group, dose_label,
       round(CASE WHEN pct > 100 THEN 100.0 WHEN pct < 0 THEN 0.0 ELSE pct END, 6) AS pct
FROM (SELECT province, month, age_group,
             CASE dose_name WHEN '1ra' THEN '1+ doses' WHEN '2da' THEN '2+ doses'
                  ELSE '3+ doses' END AS dose_label, 100.0 * cum_n / population AS pct
      FROM province_rows
      UNION ALL
      SELECT province, month, age_group, '0 dose', 100.0 - 100.0 * cum_n / population
      FROM province_rows WHERE dose_name = '1ra') t""",
)
def _(spark, sf_dir):
    shown = coverage.with_zero_dose(province_rows(spark, sf_dir))
    return rounded(shown.drop("n", "cum_n", "population"), "pct")


REGION_CASE = (
    "CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in X.REGION_NAMES.items())
    + " ELSE {c} END"
)


@query(
    "coverage_snapshot",
    "PIPE-24",
    sql=f"""
SELECT r.region, s.age_group, s.dose_name, s.cum_n, round(s.population, 6) AS population,
       round(100.0 * s.cum_n / s.population, 6) AS pct
FROM (SELECT DISTINCT {REGION_CASE.format(c="region")} AS region FROM r_polygons) r
LEFT JOIN (SELECT *, {REGION_CASE.format(c="province")} AS region FROM province_rows
           WHERE month = DATE '{X.SNAPSHOT}' AND age_group = '3-11' AND dose_name = '2da') s
  ON r.region = s.region""",
)
def _(spark, sf_dir):
    regions = (
        X.view(spark, sf_dir, "r_polygons")
        .select(recode("region", X.REGION_NAMES, F.col("region")).alias("region"))
        .distinct()
    )
    snapshot = coverage.coverage_snapshot(
        province_rows(spark, sf_dir), regions, X.SNAPSHOT, "3-11", "2da", X.REGION_NAMES
    )
    return rounded(snapshot, "population", "pct")


@query(
    "region_label_points",
    "PIPE-25",
    "SRC-6",
    "JOIN-9",
    sql="""
SELECT region,
       round(CASE region WHEN 'NATION_3' THEN -65.0 WHEN 'NATION_5' THEN -55.0
                  ELSE sx / (3 * a2) END, 6) AS x,
       round(CASE region WHEN 'NATION_4' THEN -25.1 WHEN 'NATION_5' THEN -39.0
                  ELSE sy / (3 * a2) END, 6) AS y,
       round(abs(a2 / 2), 6) AS area
FROM (SELECT region, sum(x * ny - nx * y) AS a2, sum((x + nx) * (x * ny - nx * y)) AS sx,
             sum((y + ny) * (x * ny - nx * y)) AS sy
      FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM r_polygons
            WINDOW w AS (PARTITION BY region, ring ORDER BY idx)) v
      WHERE nx IS NOT NULL GROUP BY region) t""",
)
def _(spark, sf_dir):
    points = geo.polygon_centroids(X.view(spark, sf_dir, "r_polygons"), X.LABEL_POINTS)
    return rounded(points, "x", "y", "area")


# -------------------------------------------------- deaths and comorbidities

part(
    "yearly_pairs",
    f"""
SELECT age_group, CAST(year(date) AS INT) AS year, CAST(sum(d0 + d1) AS BIGINT) AS nonvac,
       CAST(sum(d2plus) AS BIGINT) AS vac
FROM daily_wide WHERE date <= DATE '{X.CAP}' GROUP BY 1, 2""",
)
YEARLY_SQL = (
    "SELECT year, "
    + ", ".join(
        f"max(CASE WHEN age_group = '{a}' THEN {m} END) AS \"{a}_{m}\""
        for a in dims.AGE_LABELS
        for m in ("nonvac", "vac")
    )
    + " FROM yearly_pairs GROUP BY year"
)
YEARLY_CELLS = [f"{a}_{m}" for a in dims.AGE_LABELS for m in ("nonvac", "vac")]


@query("yearly_deaths_report", "PIPE-26", sql=YEARLY_SQL)
def _(spark, sf_dir):
    return reports.yearly_deaths_report(daily_wide(spark, sf_dir), X.CAP)


@query(
    "yearly_deaths_annotated",
    "PIPE-27",
    "SNK-3",
    sql="SELECT year, "
    + ", ".join(
        f"regexp_replace(' ' || CAST(\"{c}\" AS VARCHAR) || ' ', ' 0([^0-9]|$)', ' 0* \\1', 'g')"
        f' AS "{c}"'
        for c in YEARLY_CELLS
    )
    + f" FROM ({YEARLY_SQL}) t",
)
def _(spark, sf_dir):
    report = reports.yearly_deaths_report(daily_wide(spark, sf_dir), X.CAP)
    return reports.annotate_zeroes(report, YEARLY_CELLS)


@query(
    "monthly_deaths_report",
    "PIPE-28",
    sql="""
SELECT age_group, strftime(date_trunc('month', date), '%Y-%m') AS year_month,
       CAST(sum(d0 + d1) AS BIGINT) AS nonvac, CAST(sum(d2plus) AS BIGINT) AS vac
FROM daily_wide GROUP BY age_group, date_trunc('month', date)""",
)
def _(spark, sf_dir):
    return reports.monthly_deaths_report(daily_wide(spark, sf_dir))


def _label_case(c: str, labels: dict[str, str]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + " END"


part(
    "flag_cases",
    f"""
SELECT case_id, {_label_case("cls", X.FLAG_LABELS)} AS condition, count(*) AS n_rows
FROM (SELECT case_id,
             CASE WHEN f_a IS NULL OR f_b IS NULL OR f_c IS NULL OR f_none IS NULL THEN NULL
                  WHEN f_a = '0' AND f_b = '0' AND f_c = '0' AND f_none = '0' THEN 'NOREPORTADO'
                  WHEN CAST(f_a AS INT) + CAST(f_b AS INT) + CAST(f_c AS INT) > 1 THEN 'MULTIPLE'
                  WHEN f_a = '1' THEN 'f_a' WHEN f_b = '1' THEN 'f_b' WHEN f_c = '1' THEN 'f_c'
                  ELSE 'f_none' END AS cls
      FROM r_flags
      WHERE case_id IN (SELECT case_id FROM r_flags WHERE death_date > DATE '{X.FLAG_AFTER}')) t
GROUP BY 1, 2""",
)
part(
    "row_cases",
    f"""
SELECT case_id, {_label_case("CASE WHEN n_rows > 1 THEN 'MULTIPLE' ELSE stated END",
                             X.ROW_LABELS)} AS condition, n_rows
FROM (SELECT case_id, min(coalesce(condition, 'NOREPORTADO')) AS stated, count(*) AS n_rows
      FROM r_long_conditions
      WHERE case_id IN (SELECT case_id FROM r_long_conditions
                        WHERE death_date > DATE '{X.ROW_PERIOD[0]}'
                          AND death_date <= DATE '{X.ROW_PERIOD[1]}')
      GROUP BY case_id) t""",
)


def flag_cases(spark, sf_dir):
    return comorbidity.condition_from_flags(
        X.view(spark, sf_dir, "r_flags"), X.FLAGS, X.COUNTED, X.FLAG_LABELS, after=X.FLAG_AFTER
    )


def row_cases(spark, sf_dir):
    return comorbidity.condition_from_rows(
        X.view(spark, sf_dir, "r_long_conditions"),
        X.ROW_LABELS,
        after=X.ROW_PERIOD[0],
        until=X.ROW_PERIOD[1],
    )


@query("conditions_from_flags", "PIPE-29", sql="SELECT * FROM flag_cases")
def _(spark, sf_dir):
    return flag_cases(spark, sf_dir)


@query("conditions_from_rows", "PIPE-30", sql="SELECT * FROM row_cases")
def _(spark, sf_dir):
    return row_cases(spark, sf_dir)


@query(
    "condition_frequency",
    "PIPE-31",
    sql="""
SELECT condition, count(*) AS n
FROM (SELECT case_id, condition FROM flag_cases
      UNION
      SELECT case_id, condition FROM row_cases) t
GROUP BY condition ORDER BY n DESC""",
)
def _(spark, sf_dir):
    return comorbidity.condition_frequency(row_cases(spark, sf_dir), flag_cases(spark, sf_dir))


# ------------------------------------------------------------ causes of death

part(
    "cause_rows",
    f"""
SELECT age_group, year, cause_code, cause_name, CAST(sum(n) AS BIGINT) AS n
FROM r_death_register WHERE age_group = '{X.REGISTER_AGE}' GROUP BY 1, 2, 3, 4""",
)


def cause_rows(spark, sf_dir):
    return causes.cause_counts(X.view(spark, sf_dir, "r_death_register"), X.REGISTER_AGE)


def register(spark, sf_dir):
    rows = X.view(spark, sf_dir, "r_death_register")
    return rows.where(F.col("age_group") == X.REGISTER_AGE)


@query("cause_counts", "PIPE-32", sql="SELECT * FROM cause_rows")
def _(spark, sf_dir):
    return cause_rows(spark, sf_dir)


@query(
    "top_causes",
    "PIPE-33",
    sql="""
SELECT age_group, year, cause_code, cause_name, n
FROM (SELECT *, rank() OVER (PARTITION BY year ORDER BY n DESC) AS rk FROM cause_rows) t
WHERE rk <= 10 ORDER BY year, n DESC""",
)
def _(spark, sf_dir):
    return causes.top_causes(cause_rows(spark, sf_dir))


DISEASE_SQL = "(VALUES " + ", ".join(
    f"('{label}', '{col}', '{value}', {cutoff}, {first}, {last})"
    for label, col, value, cutoff, first, last in X.DISEASES
) + ") AS d(disease, selector, wanted, cutoff, first_year, last_year)"
part(
    "disease_years",
    f"""
SELECT d.disease, d.cutoff, y.year, coalesce(sum(c.n), 0) AS n
FROM {DISEASE_SQL}
JOIN (SELECT CAST(g AS INT) AS year FROM generate_series(1990, 2010) AS t(g)) y
  ON y.year BETWEEN d.first_year AND d.last_year
LEFT JOIN cause_rows c ON c.year = y.year
 AND CASE d.selector WHEN 'cause_name' THEN c.cause_name ELSE c.cause_code END = d.wanted
GROUP BY 1, 2, 3
UNION ALL
SELECT d.disease, d.cutoff, c.year, sum(c.n) AS n
FROM {DISEASE_SQL}
JOIN cause_rows c
  ON CASE d.selector WHEN 'cause_name' THEN c.cause_name ELSE c.cause_code END = d.wanted
 AND c.year NOT BETWEEN d.first_year AND d.last_year
GROUP BY 1, 2, 3""",
)
part(
    "phases",
    """
SELECT disease, CASE WHEN year <= cutoff THEN 'pre-vac' ELSE 'post-vac' END AS phase,
       CAST(min(year) AS VARCHAR) || '-' || CAST(max(year) AS VARCHAR) AS period,
       avg(n) AS mean_deaths
FROM disease_years GROUP BY 1, 2""",
)


def phases(spark, sf_dir):
    return causes.before_after(cause_rows(spark, sf_dir), X.DISEASES)


@query(
    "before_after",
    "PIPE-34",
    sql="SELECT disease, phase, period, round(mean_deaths, 6) AS mean_deaths FROM phases",
)
def _(spark, sf_dir):
    return rounded(phases(spark, sf_dir), "mean_deaths")


@query(
    "before_after_report",
    "PIPE-35",
    sql="""
SELECT disease,
       coalesce(max(CASE WHEN phase = 'pre-vac' THEN period END), '-') AS pre_period,
       coalesce(printf('%.2f', max(CASE WHEN phase = 'pre-vac' THEN mean_deaths END)), '-')
           AS pre_deaths,
       coalesce(max(CASE WHEN phase = 'post-vac' THEN period END), '-') AS post_period,
       coalesce(printf('%.2f', max(CASE WHEN phase = 'post-vac' THEN mean_deaths END)), '-')
           AS post_deaths
FROM phases GROUP BY disease""",
)
def _(spark, sf_dir):
    return causes.before_after_report(phases(spark, sf_dir))


part(
    "code_groups",
    "SELECT r.letter || lpad(CAST(g.i AS VARCHAR), 2, '0') AS code,"
    " r.cause_group, r.cause_group_short FROM (VALUES "
    + ", ".join(
        f"('{letter}', {low}, {high}, '{dims.CAUSE_GROUPS[g][1]}', '{dims.CAUSE_GROUPS[g][0]}')"
        for letter, low, high, g in dims.CAUSE_RANGES
    )
    + ") AS r(letter, low, high, cause_group, cause_group_short)"
    " JOIN (SELECT i FROM generate_series(0, 99) AS t(i)) g ON g.i BETWEEN r.low AND r.high",
)
part(
    "grouped_causes",
    """
SELECT c.*, coalesce(g.cause_group, 'Others') AS cause_group,
       coalesce(g.cause_group_short, 'Others') AS cause_group_short
FROM cause_rows c LEFT JOIN code_groups g ON c.cause_code = g.code""",
)
SUBSET_SQL = ", ".join(f"'{g}'" for g in dims.INFECTIOUS_RESPIRATORY)
RANK_SQL = """rank() OVER (PARTITION BY year ORDER BY deaths DESC)
       + (count(*) OVER (PARTITION BY year, deaths) - 1) / 2.0"""


def _group_years(where: str) -> str:
    return f"""
SELECT year, cause_group, deaths, CAST({RANK_SQL} AS DOUBLE) AS rank
FROM (SELECT year, cause_group, CAST(sum(n) AS BIGINT) AS deaths FROM grouped_causes
      WHERE {where} GROUP BY 1, 2) t"""


part("ranked_all", _group_years("cause_group <> 'Others'"))
part("ranked_subset", _group_years(f"cause_group IN ({SUBSET_SQL})"))


@query(
    "cause_groups",
    "PIPE-36",
    sql="""
SELECT age_group, year, cause_code, n, cause_group, cause_group_short,
       CASE WHEN cause_code = 'U07' THEN 'COVID-19' ELSE cause_name END AS cause_name
FROM grouped_causes""",
)
def _(spark, sf_dir):
    return causes.cause_group(causes.named_cause(cause_rows(spark, sf_dir)))


@query(
    "cause_ranking",
    "PIPE-37",
    sql=f"SELECT rank, cause_group, deaths FROM ranked_all WHERE year = {X.RANK_YEAR}",
)
def _(spark, sf_dir):
    return causes.rank_causes(register(spark, sf_dir), X.RANK_YEAR)


@query(
    "cause_ranking_subset",
    "PIPE-38",
    sql=f"SELECT rank, cause_group, deaths FROM ranked_subset WHERE year = {X.RANK_YEAR}",
)
def _(spark, sf_dir):
    return causes.rank_causes(
        register(spark, sf_dir), X.RANK_YEAR, dims.INFECTIOUS_RESPIRATORY
    )


@query(
    "rank_series",
    "PIPE-39",
    "LIM-1",
    sql=f"""
SELECT year, cause_group, deaths, rank FROM ranked_all
WHERE year >= {X.RANK_SINCE} AND rank <= 10""",
)
def _(spark, sf_dir):
    return causes.rank_series(register(spark, sf_dir), since=X.RANK_SINCE, top=10)


@query(
    "rank_series_subset",
    "PIPE-40",
    sql=f"""
SELECT year, deaths, rank, replace(named, ',', ', ') AS label,
       regexp_replace(named, '\\s\\(.*', '') AS label_short
FROM (SELECT *, CASE WHEN cause_group = '{dims.INFECTIOUS_LONG}'
                     THEN '{dims.INFECTIOUS_SHORTENED}' ELSE cause_group END AS named
      FROM ranked_subset) t""",
)
def _(spark, sf_dir):
    ranked = causes.rank_series(register(spark, sf_dir), dims.INFECTIOUS_RESPIRATORY)
    return causes.with_display_labels(
        ranked, replacements=dims.INFECTIOUS_REPLACEMENT
    ).drop("cause_group")


@query(
    "clean_labels",
    "PIPE-41",
    sql="""
SELECT DISTINCT cause_group, replace(cause_group, ',', ', ') AS label,
       regexp_replace(cause_group, '\\s\\(.*', '') AS label_short
FROM grouped_causes""",
)
def _(spark, sf_dir):
    groups = causes.cause_group(register(spark, sf_dir)).select("cause_group").distinct()
    return groups.withColumns(
        {
            "label": spaced_commas("cause_group"),
            "label_short": without_code_suffix("cause_group"),
        }
    )


def _matrix_sql(source: str, named: str) -> str:
    cells = ", ".join(
        f"CAST(coalesce(sum(CASE WHEN year = {y} THEN deaths END), 0) AS BIGINT) AS \"{y}\""
        for y in X.YEARS
    )
    return f"SELECT replace({named}, ',', ', ') AS label, {cells} FROM {source} GROUP BY 1"


@query("cause_year_matrix", "PIPE-42", sql=_matrix_sql("ranked_all", "cause_group"))
def _(spark, sf_dir):
    return causes.cause_year_matrix(register(spark, sf_dir), X.YEARS)


@query(
    "cause_year_matrix_subset",
    "PIPE-42",
    sql=_matrix_sql(
        "ranked_subset",
        f"CASE WHEN cause_group = '{dims.INFECTIOUS_LONG}' "
        f"THEN '{dims.INFECTIOUS_SHORTENED}' ELSE cause_group END",
    ),
)
def _(spark, sf_dir):
    return causes.cause_year_matrix(
        register(spark, sf_dir), X.YEARS, dims.INFECTIOUS_RESPIRATORY
    )
