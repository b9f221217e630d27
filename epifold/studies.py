"""The register analyses end to end: from source tables to report tables.

Inputs are DataFrames with the columns of ``epifold.sources.schemas``. Each
function returns its tables by name; :func:`write_tables` stores them. ``folder``
is a path all executors can reach. Large tables are read once: case tables are
written to the folder, anew whenever their source tables change, report-sized frames that several tables need are
checkpointed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epifold import dims
from epifold.functions import age_band, dose_level, parse_dmy, recode, year_month
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
from epifold.sources import files, schemas
from epifold.sources.literals import timeline
from epifold.sources.manifest import materialise_current
from epifold.sources.storage import cut

CASE_COLUMNS = {c: schemas.CASE_NAMES[c] for c in schemas.CASES.names}
DEATH_COLUMNS = {
    **CASE_COLUMNS,
    **{c: schemas.CASE_NAMES[c] for c in ("PRIMERA", "SEGUNDA", "REFUERZO")},
}
#: Columns that a matrix by year may have.
MOST_YEARS = 500
PROVINCE_NAMES = {long: short for short, long in dims.REGION_NAMES.items()}
REPORT_NAMES = {
    "monthly_cases": {"age_group": "Age group", "year_month": "Year-Month", "n": "Cases"},
    "coverage_at_snapshot": {
        "age_group": "Age Group (years)",
        "0 dose": "0 dose",
        "1+ doses": "1+ doses",
        "2+ doses": "2+ doses",
        "3+ doses": "3+ doses",
        "population": "Population",
    },
    "monthly_deaths_by_status": {
        "age_group": "Age group",
        "year_month": "Year-Month",
        "nonvac": "Non vaccinated deaths",
        "vac": "Vaccinated deaths",
    },
    "yearly_deaths": {
        "year": "Year",
        **{
            f"{age}_{kind}": f"{dims.AGE_DISPLAY[age]}: {shown}"
            for age in dims.AGE_LABELS
            for kind, shown in (("nonvac", "Non Vaccinated Deaths"), ("vac", "Vaccinated Deaths"))
        },
    },
    **{
        name: {"rank": "Rank", "cause_group": "Cause group", "deaths": "Deaths"}
        for name in ("ranking", "ranking_infectious")
    },
    "comorbidities": {"condition": "Comorbidity", "n": "Count"},
    "before_after": {
        "disease": "Disease",
        "pre_period": "Pre-vaccine period",
        "pre_deaths": "Annual pre-vaccine deaths",
        "post_period": "Post-vaccine period",
        "post_deaths": "Annual post-vaccine deaths",
    },
}


def _dated(text_dates: DataFrame) -> DataFrame:
    return text_dates.withColumn("FECHA_FALLECIMIENTO", parse_dmy("FECHA_FALLECIMIENTO"))


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("age_group", recode("age_group", dims.AGE_DISPLAY, F.col("age_group")))


def case_curves(
    text_dates: DataFrame, dates: DataFrame, folder: str, order: str | None = None
) -> dict[str, DataFrame]:
    """Monthly cases and deaths by age group with the intervention timeline.

    The two case lists are united and written once, corrected, and reduced to
    one row per case with its first known death date. Rows arrive in the order
    of the column ``order`` of both lists, else as they lie in their files.
    """
    spark = text_dates.sparkSession
    lines = linelist.ingest_linelist(
        _dated(text_dates),
        dates,
        f"{folder}/case-lines",
        {**CASE_COLUMNS, **({order: order} if order else {})},
        order=order,
        current=True,
    )
    fixed = linelist.apply_overrides(lines, dims.DEATH_DATE_FIXES, "case_id", "death_date")
    single = linelist.dedup_linelist(fixed, "case_id", "seq", best_of=["death_date"])
    cases = materialise_current(
        lambda: single.withColumn("age_group", age_band("age")).drop("seq"),
        f"{folder}/cases",
        [lines],
        {"fixes": [list(map(str, f)) for f in dims.DEATH_DATE_FIXES]},
    )
    monthly_cases = linelist.monthly_counts(cases, "open_date", until=dims.DATE_CAP)
    monthly_deaths = linelist.monthly_counts(
        cases, "death_date", until=dims.DATE_CAP, calendar=series.Calendar(*dims.DEATH_MONTHS)
    )
    return {
        "monthly_cases": monthly_cases.withColumn("year_month", year_month("month")),
        "monthly_case_totals": series.period_totals(monthly_cases, "month"),
        "monthly_deaths": monthly_deaths,
        "monthly_death_totals": series.period_totals(monthly_deaths, "month"),
        "monthly_deaths_annotated": reports.annotate_intervals(monthly_deaths, timeline(spark)),
    }


def _apportioned(people: DataFrame, names: Mapping[str, str]) -> DataFrame:
    rows = people.withColumnsRenamed(schemas.POPULATION_NAMES)
    return rows.withColumn("province", recode("province", names, F.col("province")))


def coverage_and_incidence(
    deaths_with_flags: DataFrame,
    deaths_with_condition: DataFrame,
    people: DataFrame,
    doses: DataFrame,
    folder: str,
    order: str | None = None,
) -> dict[str, DataFrame]:
    """Coverage, incidence by dose status, deaths by status and comorbidities.

    ``order`` is that of :func:`case_curves`.
    """
    with_flags = _dated(deaths_with_flags)
    lines = linelist.ingest_linelist(
        with_flags,
        deaths_with_condition,
        f"{folder}/death-lines",
        {**DEATH_COLUMNS, **({order: order} if order else {})},
        order=order,
    )
    leveled = lines.select(
        "case_id",
        "seq",
        "age",
        "death_date",
        dose_level("first_dose", "second_dose", "booster").alias("level"),
    )
    first = linelist.child_records(linelist.first_record(leveled, "case_id"))
    deaths = linelist.apply_overrides(first, dims.DEATH_DATE_FIXES, "case_id", "death_date")
    days = series.Calendar(*dims.DEATH_DAYS, "day")
    daily = cut(linelist.daily_by_status(deaths, "death_date", "level", ["age_group"], days))
    national = cut(population.apportion(_apportioned(people, {}), keys=()))
    months = series.Calendar(*dims.DOSE_MONTHS)
    given = cut(
        coverage.cumulative_doses_wide(
            doses.withColumnsRenamed(schemas.DOSE_COUNT_NAMES), months, dims.INCIDENCE_WINDOW[1]
        )
    )
    shares = coverage.coverage_long(given, national)
    rates = cut(
        incidence.cumulative_incidence(
            incidence.join_exposure(daily, national, given), *dims.INCIDENCE_WINDOW
        )
    )
    all_rates = incidence.incidence_long(rates, *dims.INCIDENCE_YEAR, empty=())
    yearly = reports.yearly_deaths_report(daily)
    flags = list(schemas.CONDITION_FLAGS)
    counted = [f for f in flags if f != "SIN_COMORB"]
    conditions = comorbidity.condition_frequency(
        comorbidity.condition_from_rows(
            deaths_with_condition.withColumnsRenamed(schemas.CASE_NAMES)
        ),
        comorbidity.condition_from_flags(
            with_flags.withColumnsRenamed(schemas.CASE_NAMES), flags, counted
        ),
    )
    return {
        "daily_cumulative_deaths": daily,
        "coverage": _shown(shares),
        "latest_coverage": _shown(
            series.latest_point(cut(shares), "month", ["age_group", "dose_label"])
        ),
        "coverage_at_snapshot": _shown(coverage.coverage_report(shares, dims.SNAPSHOT)),
        "incidence": incidence.incidence_long(rates, *dims.INCIDENCE_YEAR),
        "latest_incidence": series.latest_point(all_rates, "date", until=dims.SNAPSHOT).where(
            F.col("dose_label").isin(*dims.LABELLED_INCIDENCE)
        ),
        "yearly_deaths": yearly,
        "yearly_deaths_annotated": reports.annotate_zeroes(yearly, yearly.columns[1:]),
        "monthly_deaths_by_status": _shown(reports.monthly_deaths_report(daily)),
        "comorbidities": conditions,
    }


def provincial_coverage(
    people: DataFrame,
    doses: DataFrame,
    regions: DataFrame | None = None,
    province_names: Mapping[str, str] = PROVINCE_NAMES,
) -> dict[str, DataFrame]:
    """Coverage curves by province and the state at the end of the period.

    ``province_names`` maps population labels to the dose table's; ``regions``
    (a ``region`` per row) adds a snapshot for each age group.
    """
    pop = population.apportion(_apportioned(people, province_names))
    curves = cut(
        coverage.provincial_coverage(
            doses.withColumnsRenamed(schemas.DOSE_COUNT_NAMES),
            pop,
            series.Calendar(*dims.DOSE_MONTHS),
        )
    )
    tables = {"curves": coverage.with_zero_dose(curves)}
    if regions is not None:
        for age in dims.AGE_LABELS:
            tables[f"snapshot_{age}"] = coverage.coverage_snapshot(
                curves, regions, dims.SNAPSHOT, age, dims.DOSE_NAMES["2"]
            )
    return tables


def person_doses(ledger: DataFrame, path: str) -> DataFrame:
    """Counts of each person's earliest doses, stored until the ledger changes."""

    def counted() -> DataFrame:
        return coverage.earliest_doses(ledger.withColumnsRenamed(schemas.PERSON_DOSE_NAMES))

    return materialise_current(counted, path, [ledger], by="auto")


def label_points(vertices: DataFrame) -> DataFrame:
    """Points for the map's labels, one per region, some of them moved by hand."""
    return geo.polygon_centroids(vertices, dims.LABEL_POINTS)


def _years(counts: DataFrame) -> list[int]:
    """The years that occur; they become columns, so there may not be very many."""
    found = counts.where("year is not null").select("year").distinct().limit(MOST_YEARS + 1)
    years = sorted(r.year for r in found.collect())
    if len(years) > MOST_YEARS:
        raise ValueError(f"more than {MOST_YEARS} years; name those wanted")
    return years


def cause_tables(
    register: DataFrame, years: tuple[int, int] | None = None
) -> dict[str, DataFrame]:
    """Leading causes, before/after comparison, ranks and the yearly matrices.

    The matrices have a column for every year of the register unless ``years``
    names the first and last one. Single causes by year are a small table that every other one is built on;
    the register itself is read once for it.
    """
    rows = register.withColumnsRenamed(schemas.DEATH_REGISTER_NAMES)
    counts = cut(causes.cause_counts(rows))
    subset = dims.INFECTIOUS_RESPIRATORY
    span = list(range(years[0], years[1] + 1)) if years else _years(counts)
    # The ranking is that of the last year; a register without years has none.
    last = span[-1] if span else dims.RANK_CHART_SINCE
    since = dims.RANK_CHART_SINCE
    return {
        "leading_causes": causes.top_causes(counts),
        "before_after": causes.before_after_report(causes.before_after(counts)),
        "cause_groups": causes.cause_group(causes.named_cause(counts)),
        "ranking": causes.rank_causes(counts, last),
        "ranking_infectious": causes.rank_causes(counts, last, subset),
        "rank_series": causes.with_display_labels(
            causes.rank_series(counts, since=since, top=10)
        ),
        "rank_series_infectious": causes.with_display_labels(
            causes.rank_series(counts, subset, since=since, top=10),
            replacements=dims.INFECTIOUS_REPLACEMENT,
        ),
        "deaths_by_group": causes.cause_year_matrix(counts, span),
        "deaths_by_group_infectious": causes.cause_year_matrix(counts, span, subset),
    }


def write_tables(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Store every table under its name, report tables with their display names."""
    for name, table in tables.items():
        files.write_report(table, f"{folder}/{name}", REPORT_NAMES.get(name))
