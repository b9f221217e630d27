"""Hand-sized frames for each rule that differs from a plain reading."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from epifold import dims, functions as fn
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
from epifold.sources.literals import BROADCAST_ROWS, cause_dimension, literal_table, timeline


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


D = date(2021, 5, 4)


def test_best_date_deduplication(spark):
    df = spark.createDataFrame(
        [(1, 1, None), (1, 2, D), (2, 3, None), (1, 4, date(2020, 1, 1))],
        "case_id int, seq int, death_date date",
    )
    best = linelist.dedup_linelist(df, "case_id", "seq", ["death_date"])
    assert rows(best) == [(1, 1, D), (2, 3, None)]
    first = linelist.first_record(df, "case_id", "seq")
    assert rows(first) == [(1, 1, None), (2, 3, None)]


def test_overrides_keep_other_rows(spark):
    df = spark.createDataFrame(
        [("3616406", D), ("5", None), (None, D)], "case_id string, death_date date"
    )
    out = linelist.apply_overrides(df, dims.DEATH_DATE_FIXES, "case_id", "death_date")
    assert rows(out) == sorted(
        [("3616406", date(2022, 10, 19)), ("5", None), (None, D)], key=str
    )


def test_age_bands(spark):
    df = spark.createDataFrame([(2.9,), (3.0,), (11.5,), (12.0,), (18.0,), (None,)], "age double")
    closed = [r[0] for r in df.select(fn.age_band("age")).collect()]
    assert closed == ["0-2", "3-11", "3-11", "12-17", None, None]
    top = [r[0] for r in df.select(fn.age_band("age", closed_top=False)).collect()]
    assert top == ["0-2", "3-11", "3-11", "12-17", "12-17", None]


def test_dose_status_precedence(spark):
    df = spark.createDataFrame(
        [("y", "y", "y"), ("y", "y", ""), ("y", None, None), ("", None, ""), (None, "y", None)],
        "a string, b string, c string",
    )
    level = fn.dose_level("a", "b", "c")
    got = [tuple(r) for r in df.select(fn.dose_status(level), fn.dose_class(level)).collect()]
    assert got == [
        ("refuerzo", "d2plus"), ("2da", "d2plus"), ("1ra", "d1"), ("", "d0"), ("2da", "d2plus"),
    ]


def test_completion_keeps_outside_and_null_rows(spark):
    df = spark.createDataFrame(
        [
            ("a", date(2019, 12, 1), 5),
            ("a", date(2020, 2, 1), 7),
            ("b", None, 3),
            (None, date(2020, 4, 1), 1),
        ],
        "k string, month date, n int",
    )
    calendar = series.Calendar("2020-01-01", "2020-03-01")
    jan, feb, mar = (date(2020, m, 1) for m in (1, 2, 3))
    got = rows(series.complete_series(df, ["k"], "month", calendar, ["n"]))
    assert got == sorted(
        [
            ("a", date(2019, 12, 1), 5), ("a", jan, 0), ("a", feb, 7), ("a", mar, 0),
            ("b", jan, 0), ("b", feb, 0), ("b", mar, 0), ("b", None, 3),
            (None, jan, 0), (None, feb, 0), (None, mar, 0), (None, date(2020, 4, 1), 1),
        ],
        key=str,
    )
    inside = series.complete_series(df, ["k"], "month", calendar, ["n"], outside="drop")
    assert inside.count() == 9


def test_calendar_steps(spark):
    month, day = series.Calendar("2020-01-01", "2020-03-01"), series.Calendar("x", "x", "day")
    mid = F.lit("2020-02-15").cast("date")
    start = F.lit("2020-02-01").cast("date")
    assert one(spark, month.after(mid)) == one(spark, month.after(start)) == date(2020, 3, 1)
    assert one(spark, month.before(mid)) == date(2020, 2, 1)
    assert one(spark, month.before(start)) == date(2020, 1, 1)
    assert one(spark, day.after(start)) == date(2020, 2, 2)
    assert one(spark, day.before(start)) == date(2020, 1, 31)
    assert one(spark, F.size(month.points())) == 3
    days = series.Calendar("2020-01-01", "2022-12-31", "day")
    assert one(spark, F.size(days.points())) == 1096


def test_completion_by_day_around_the_calendar(spark):
    df = spark.createDataFrame(
        [("a", date(2019, 1, 1), 1), ("a", date(2020, 1, 3), 2), ("a", date(2021, 1, 1), 3),
         ("b", date(2018, 5, 5), 4), ("c", date(2030, 5, 5), 5)],
        "k string, d date, n int",
    )
    calendar = series.Calendar("2020-01-01", "2020-01-05", "day")
    got = rows(series.complete_series(df, ["k"], "d", calendar, ["n"]))
    extra = {"a": [(date(2019, 1, 1), 1), (date(2021, 1, 1), 3)],
             "b": [(date(2018, 5, 5), 4)], "c": [(date(2030, 5, 5), 5)]}
    wanted = [
        (k, date(2020, 1, d), 2 if (k, d) == ("a", 3) else 0) for k in "abc" for d in range(1, 6)
    ] + [(k, d, n) for k, more in extra.items() for d, n in more]
    assert got == sorted(wanted, key=str)


def test_running_sum_puts_undated_last(spark):
    df = spark.createDataFrame(
        [("a", None, 4), ("a", date(2020, 1, 2), 2), ("a", date(2020, 1, 1), 1)],
        "k string, d date, n int",
    )
    got = {r["d"]: r["c"] for r in series.running_sums(df, ["k"], "d", {"c": "n"}).collect()}
    assert got == {date(2020, 1, 1): 1, date(2020, 1, 2): 3, None: 7}


def test_average_rank_and_top_with_ties(spark):
    df = spark.createDataFrame(
        [("y", 5), ("y", 3), ("y", 3), ("y", 1), ("y", None)], "y string, deaths int"
    )
    ranked = df.withColumn("rank", series.average_rank("deaths", ["y"]))
    assert sorted((r["deaths"] or 0, r["rank"]) for r in ranked.collect()) == [
        (0, None), (1, 4.0), (3, 2.5), (3, 2.5), (5, 1.0),
    ]
    counts = spark.createDataFrame(
        [(2000, "a", 3), (2000, "b", 2), (2000, "c", 2), (2000, "d", 1), (2000, "e", None)],
        "year int, cause_name string, n int",
    )
    assert causes.top_causes(counts, 2).count() == 3


def test_strict_sum(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 3)], "k string, n int")
    assert rows(df.groupBy("k").agg(series.strict_sum("n"))) == [("a", None), ("b", 5)]


def test_half_even_and_text(spark):
    values = [one(spark, fn.half_even(F.lit(v))) for v in (0.5, 1.5, 2.5)]
    assert values == [0.0, 2.0, 2.0]
    assert one(spark, fn.fixed_decimals(F.lit(0.125))) == "0.12"
    assert one(spark, fn.fixed_decimals(F.lit(3.0))) == "3.00"
    assert one(spark, fn.percent_text(F.lit(62.5))) == "62%"
    assert [
        one(spark, fn.annotate_zero(F.lit(v))) for v in (" 0 ", " 10 ", " 05")
    ] == [" 0*  ", " 10 ", " 05"]
    assert one(spark, fn.spaced_commas(F.lit("I11,I13"))) == "I11, I13"
    assert one(spark, fn.without_code_suffix(F.lit("Heart (I00,I09) (x)"))) == "Heart"


def test_rates_and_clamp(spark):
    assert one(spark, fn.per_population(F.lit(3), F.lit(0))) is None
    assert one(spark, fn.percent(F.lit(1), F.lit(4))) == 25.0
    clamped = [one(spark, fn.clamp(F.lit(v).cast("double"))) for v in (None, -3.0, 140.0, 7.0)]
    assert clamped == [None, 0.0, 100.0, 7.0]


def test_dates(spark):
    assert one(spark, fn.parse_dmy(F.lit("04/05/2021"))) == D
    assert one(spark, fn.parse_dmy(F.lit("31/02/2021"))) is None
    assert one(spark, fn.month_number(F.lit("Septiembre"))) == 9
    assert one(spark, fn.month_number(F.lit("S.I."))) is None
    assert one(spark, fn.month_from_parts(F.lit(2021), F.lit(None).cast("int"))) is None


def test_apportionment(spark):
    pop = spark.createDataFrame(
        [("p", b, 100) for b in ("0 a 4", "5 a 9", "10 a 14", "15 a 19", "20 a 24")],
        "province string, band5 string, n int",
    )
    wanted = [("0-2", 60.0), ("12-17", 120.0), ("3-11", 180.0)]
    assert rows(population.apportion(pop, keys=())) == wanted
    assert [r[1:] for r in rows(population.apportion(pop))] == wanted
    shares = {}
    for band, _, fifths in dims.BAND_FIFTHS:
        shares[band] = shares.get(band, 0) + fifths
    assert shares == {"0 a 4": 5, "5 a 9": 5, "10 a 14": 5, "15 a 19": 3}


def test_dose_rows_null_policy(spark):
    df = spark.createDataFrame(
        [
            ("p", None, 2021, "Enero", "3-4", 5, "1"),
            ("p", "F", 2021, "S.I.", "3-4", 5, "1"),
            ("p", "F", 2021, "Mayo", "18+", 5, "1"),
            ("p", "F", 2021, "Mayo", "5-11", 5, "1"),
        ],
        "province string, sex string, year int, month_es string, age_band string, qty int, dose string",
    )
    assert coverage.dose_rows(df, "drop").count() == 1
    assert coverage.dose_rows(df, "keep").count() == 4


def test_earliest_dose_ties_and_null_policy(spark):
    df = spark.createDataFrame(
        [
            (1, "1ra", "P1", "0-2", D), (1, "Unica", "P1", "0-2", D),
            (1, "1ra", "P1", "0-2", date(2021, 6, 1)),
            (2, "2da", "P1", "0-2", None), (2, "2da", "P1", "0-2", D),
            (3, "1ra", "S.I.", "0-2", D), (4, "1ra", None, "0-2", D),
        ],
        "person_id int, dose_name string, province string, age_group string, dose_date date",
    )
    assert rows(coverage.earliest_doses(df)) == [("0-2", "1ra", D, "P1", 2)]
    assert rows(coverage.earliest_doses(df, null_policy="ignore")) == [
        ("0-2", "1ra", D, "P1", 2), ("0-2", "2da", D, "P1", 1),
    ]


def exposure(spark, records):
    return spark.createDataFrame(
        records,
        "age_group string, date date, d0 long, d1 long, d2plus long, cum_0 long, cum_1 long,"
        " cum_2 long, population double, doses_1 long, doses_2 long, doses_3 long",
    )


def test_incidence_guards(spark):
    df = exposure(
        spark,
        [
            ("a", date(2021, 12, 1), 1, 0, 0, 10, 2, 1, 1000.0, 0, 0, 0),
            ("a", date(2022, 1, 1), 0, 0, 0, 14, 3, 1, 1000.0, 200, 100, 0),
            ("a", date(2022, 2, 1), 0, 0, 0, 15, 5, 2, 1000.0, 1000, 100, 0),
            ("a", date(2022, 2, 2), 0, 0, 0, 15, 5, 2, 1000.0, 1000, 100, 0),
            ("a", date(2022, 3, 1), 2, 0, 0, 17, 5, 2, 1000.0, None, None, None),
        ],
    )
    got = {
        r["date"]: r
        for r in incidence.cumulative_incidence(df, "2021-12-01", "2023-01-01").collect()
    }
    assert len(got) == 4
    base, jan, feb, mar = (
        got[d] for d in (date(2021, 12, 1), date(2022, 1, 1), date(2022, 2, 1), date(2022, 3, 1))
    )
    # No doses given yet: deaths of the day over the population.
    assert (base["inc0_cum"], base["inc1_cum"], base["inc2_cum"]) == (100.0, 0.0, 0.0)
    assert jan["inc0_cum"] == pytest.approx(1e5 * 4 / 800)
    assert jan["inc0b_cum"] == pytest.approx(1e5 * 5 / 900)
    assert jan["inc1e_cum"] == pytest.approx(1e5 * 1 / 200)
    assert feb["inc1_cum"] == pytest.approx(1e5 * 4 / 1000)
    assert feb["inc2_cum"] == pytest.approx(1e5 * 1 / 100)
    # Everybody has a dose: nobody is left to divide by.
    assert feb["inc0_cum"] is None
    # Unknown doses: unknown rates, but no deaths after two doses.
    assert (mar["inc0_cum"], mar["inc1e_cum"], mar["inc2_cum"]) == (None, None, 0.0)


def test_latest_point(spark):
    df = spark.createDataFrame(
        [("a", date(2020, 1, 1), 1), ("a", date(2020, 2, 1), 2), ("a", date(2020, 2, 1), 3),
         (None, date(2020, 1, 1), 4)],
        "k string, d date, n int",
    )
    assert sorted(r["n"] for r in series.latest_point(df, "d").collect()) == [2, 3]
    assert sorted(r["n"] for r in series.latest_point(df, "d", ["k"]).collect()) == [2, 3, 4]
    early = series.latest_point(df, "d", until="2020-01-15")
    assert sorted(r["n"] for r in early.collect()) == [1, 4]


def test_coverage_report_rounds_to_even(spark):
    cumulative = spark.createDataFrame(
        [("0-2", date(2022, 12, 1), 5, 25, 35)],
        "age_group string, month date, doses_1 long, doses_2 long, doses_3 long",
    )
    pop = spark.createDataFrame([("0-2", 1000.5)], "age_group string, population double")
    pop = pop.withColumn("population", F.lit(1000.0))
    long = coverage.coverage_long(cumulative, pop)
    assert rows(long.groupBy("dose_label").count()) == sorted(
        [(k, 1) for k in ("0 dose", "1+ doses", "2+ doses", "3+ doses")]
    )
    report = coverage.coverage_report(long, "2022-12-01")
    assert report.columns == [
        "age_group", "0 dose", "1+ doses", "2+ doses", "3+ doses", "population",
    ]
    # 99.5, 0.5, 2.5 and 3.5 percent
    assert rows(report) == [("0-2", "100%", "0%", "2%", "4%", 1000.0)]


def test_zero_dose_before_and_after_clamp(spark):
    df = spark.createDataFrame(
        [("P", "1ra", 140.0), ("P", "2da", 60.0), ("Q", "1ra", None)],
        "province string, dose_name string, pct double",
    )
    raw = rows(coverage.with_zero_dose(df, clamped=False))
    assert ("P", "0 dose", -40.0) in raw and ("P", "1+ doses", 140.0) in raw
    shown = rows(coverage.with_zero_dose(df))
    assert ("P", "0 dose", 0.0) in shown and ("P", "1+ doses", 100.0) in shown
    assert ("Q", "0 dose", None) in shown and len(shown) == 5


def test_comorbidity_from_flags(spark):
    df = spark.createDataFrame(
        [
            (1, "0", "0", "0", D), (2, "1", "0", "1", D), (3, "1", "1", "0", D),
            (4, "0", "0", "1", D), (5, "1", None, "0", D), (6, "1", "0", "0", date(2019, 1, 1)),
            (7, "x", "0", "0", D), (8, "0", "1", "0", date(2019, 1, 1)), (8, "0", "0", "0", D),
        ],
        "case_id int, OTRA string, TBC string, SIN_COMORB string, death_date date",
    )
    got = comorbidity.condition_from_flags(df, ["OTRA", "TBC", "SIN_COMORB"], ["OTRA", "TBC"])
    assert rows(got) == [
        (1, "None reported", 1), (2, "Other", 1), (3, "Multiple comorbidities", 1),
        (4, "No comorbidities", 1), (5, None, 1), (7, "None reported", 1),
        (8, "None reported", 1), (8, "Tuberculosis", 1),
    ]


def test_comorbidity_from_rows(spark):
    df = spark.createDataFrame(
        [
            (1, None, D), (2, "Tuberculosis", D), (2, "Tuberculosis", date(2019, 1, 1)),
            (3, "unheard of", D), (4, "Tuberculosis", date(2023, 1, 1)), (5, "Prematuridad", D),
        ],
        "case_id int, condition string, death_date date",
    )
    assert rows(comorbidity.condition_from_rows(df)) == [
        (1, "None reported", 1), (2, "Multiple comorbidities", 2), (3, None, 1),
        (5, "Preterm birth", 1),
    ]
    distinct = rows(comorbidity.condition_from_rows(df, distinct_values=True))
    assert (2, "Tuberculosis", 2) in distinct


def test_condition_frequency_counts_pairs_once(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "case_id int, condition string")
    b = spark.createDataFrame([(1, "x"), (1, "y")], "case_id int, condition string")
    got = [tuple(r) for r in comorbidity.condition_frequency(a, b).collect()]
    assert got == [("x", 2), ("y", 1), (None, 1)]


def test_cause_dimension(spark):
    codes = cause_dimension(spark)
    assert codes.count() == 1072
    assert codes.select("cause_code").distinct().count() == 1072
    assert codes.select("cause_group").distinct().count() == 20
    df = spark.createDataFrame(
        [(c,) for c in ("G90", "J67", "J70", "A54", "A00", "B05", "U07", None)], "cause_code string"
    )
    got = {r["cause_code"]: r["cause_group_short"] for r in causes.cause_group(df).collect()}
    assert got == {
        "G90": "Diseases of the nervous system",
        "J67": "Accidents and/or Lung diseases due to external agents",
        "J70": "Accidents and/or Lung diseases due to external agents",
        "A54": "Infections with a predominantly sexual mode of transmission",
        "A00": "Intestinal infectious diseases",
        "B05": "Others",
        "U07": "COVID-19",
        None: "Others",
    }


def test_before_after_fills_years(spark):
    counts = spark.createDataFrame(
        [(2005, "B15", "Hepatitis aguda tipo A", 4), (2004, "B15", "Hepatitis aguda tipo A", 2),
         (2007, "B15", "Hepatitis aguda tipo A", 8), (2021, "U07", "any", 6)],
        "year int, cause_code string, cause_name string, n long",
    )
    got = {(r[0], r[1]): (r[2], r[3]) for r in causes.before_after(counts).collect()}
    assert got[("Hepatitis A", "pre-vac")] == ("2004-2006", 2.0)
    assert got[("Hepatitis A", "post-vac")] == ("2007-2022", 0.5)
    assert got[("Covid", "pre-vac")] == ("2020-2022", 2.0)
    assert got[("Varicella", "post-vac")] == ("2016-2022", 0.0)
    report = {r["disease"]: tuple(r)[1:] for r in causes.before_after_report(
        causes.before_after(counts)).collect()}
    assert report["Covid"] == ("2020-2022", "2.00", "-", "-")
    assert report["Hepatitis A"] == ("2004-2006", "2.00", "2007-2022", "0.50")


def test_report_matches_published_shape(spark):
    """Yearly table from daily counts that hold the published totals."""
    golden = {
        2020: ((49, 0), (22, 0), (29, 0)),
        2021: ((51, 0), (46, 0), (69, 0)),
        2022: ((47, 0), (25, 9), (27, 9)),
    }
    records = [
        (age, date(year, 7, 1), non - 1, 1, vac)
        for year, cells in golden.items()
        for age, (non, vac) in zip(dims.AGE_LABELS, cells)
    ]
    daily = spark.createDataFrame(
        records, "age_group string, date date, d0 long, d1 long, d2plus long"
    )
    report = reports.yearly_deaths_report(daily)
    assert report.columns == ["year"] + [
        f"{a}_{m}" for a in dims.AGE_LABELS for m in ("nonvac", "vac")
    ]
    got = {r["year"]: tuple(r)[1:] for r in report.collect()}
    assert got == {y: tuple(v for cell in cells for v in cell) for y, cells in golden.items()}
    starred = reports.annotate_zeroes(report, report.columns[1:]).where("year = 2020").first()
    assert tuple(starred)[1:3] == (" 49 ", " 0*  ")


def test_interval_edges(spark):
    monthly = spark.createDataFrame(
        [(date(2020, m, 1), m) for m in range(1, 6)], "month date, n int"
    )
    intervals = timeline(
        spark,
        [("x", "g", "2020-02-29", "2020-04-01"), ("y", "g", "2020-03-10", "2020-03-12"),
         ("z", "g", "2021-01-01", "2021-02-01")],
    )
    got = [(r["month"].month, r["event"]) for r in
           reports.annotate_intervals(monthly, intervals).collect()]
    assert sorted(got) == [(2, "x"), (3, "x"), (3, "y"), (4, "x")]
    assert timeline(spark).count() == 22


def test_centroids(spark):
    square = [(0, 0.0, 0.0), (1, 4.0, 0.0), (2, 4.0, 2.0), (3, 0.0, 2.0), (4, 0.0, 0.0)]
    # A hole, wound the other way round, in the right half.
    hole = [(0, 2.0, 0.0), (1, 2.0, 2.0), (2, 4.0, 2.0), (3, 4.0, 0.0), (4, 2.0, 0.0)]
    df = spark.createDataFrame(
        [("full", 1, *v) for v in square]
        + [("half", 1, *v) for v in square]
        + [("half", 2, *v) for v in hole],
        "region string, ring int, idx int, x double, y double",
    )
    assert rows(geo.polygon_centroids(df)) == [("full", 2.0, 1.0, 8.0), ("half", 1.0, 1.0, 4.0)]
    moved = geo.polygon_centroids(df, [("full", None, -9.0)])
    assert rows(moved)[0] == ("full", 2.0, -9.0, 8.0)
    gaps = geo.polygon_centroids(df.withColumn("idx", F.col("idx") * 10))
    assert rows(gaps) == [("full", 2.0, 1.0, 8.0), ("half", 1.0, 1.0, 4.0)]
    by_place = geo.polygon_centroids(df, moved=[(1.0, 1.0, 5.0, 6.0)])
    assert rows(by_place) == [("full", 2.0, 1.0, 8.0), ("half", 5.0, 6.0, 4.0)]


def test_unknown_doses_are_refused_and_unknown_counts_add_nothing(spark):
    columns = "province string, sex string, year int, month_es string, age_band string, qty int, dose string"
    given = spark.createDataFrame([("A", "F", 2021, "Mayo", "0-2", 5, "4")], columns)
    people = spark.createDataFrame([("A", "0-2", 10.0)], "province string, age_group string, population double")
    months = series.Calendar("2021-01-01", "2021-12-01")
    with pytest.raises(Exception, match="unknown dose 4"):
        coverage.provincial_coverage(given, people, months).collect()
    empty = spark.createDataFrame([("A", "F", 2021, "Mayo", "0-2", None, "1")], columns)
    assert [r["n"] for r in coverage.dose_counts(empty, null_policy="keep").collect()] == [0]


def test_literal_table_hint_follows_its_length(spark):
    def plan(n):
        small = literal_table(spark, [(i,) for i in range(n)], (("id", "bigint"),))
        return spark.range(10).join(small, "id")._jdf.queryExecution().toString()

    assert "strategy=broadcast" in plan(3)
    assert "strategy=broadcast" not in plan(BROADCAST_ROWS + 1)


def test_cause_matrix_and_display_labels(spark):
    df = spark.createDataFrame(
        [("01", 2000, "B60", 2), ("01", 2001, "J12", 3), ("01", 2001, "Z99", 9)],
        "age_group string, year int, cause_code string, n long",
    )
    full = causes.cause_year_matrix(df, [2000, 2001, 2002])
    assert full.columns == ["label", "2000", "2001", "2002"]
    got = {r["label"]: tuple(r)[1:] for r in full.collect()}
    assert got["Influenza and pneumonia (J09-J18)"] == (0, 3, 0)
    assert len(got) == 2
    subset = causes.cause_year_matrix(df, [2000, 2001], dims.INFECTIOUS_RESPIRATORY)
    labels = {r["label"] for r in subset.collect()}
    assert dims.INFECTIOUS_SHORTENED in labels
    shown = causes.with_display_labels(causes.cause_group(df)).where("cause_code = 'B60'").first()
    assert shown["label_short"].endswith("and their sequelae")
    assert "A00, A05" in shown["label"]
