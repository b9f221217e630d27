"""Dose counts and vaccination coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epifold import dims
from epifold.functions import (
    clamp,
    complement,
    half_even,
    month_from_parts,
    month_number,
    percent,
    percent_text,
    recode,
)
from epifold.operators.joins import join_per_key
from epifold.operators.series import Calendar, complete_series, running_sums


def dose_rows(df: DataFrame, null_policy: str = "keep") -> DataFrame:
    """Add ``month`` and ``age_group`` to pre-aggregated dose counts.

    Reads ``year, month_es, age_band``. An unknown month name gives a NULL
    month, a band outside the study a NULL group. ``null_policy="drop"`` then
    leaves out every row with a NULL in any column, as the national figures do;
    the provincial ones keep rows with, say, an unknown sex.
    """
    rows = df.withColumns(
        {
            "month": month_from_parts("year", month_number("month_es")),
            "age_group": recode("age_band", dims.DOSE_BANDS),
        }
    )
    if null_policy == "keep":
        return rows
    # One condition per column, so that those on source columns reach the scan.
    return rows.where(reduce(and_, [F.col(c).isNotNull() for c in rows.columns]))


def dose_counts(
    df: DataFrame, keys: Sequence[str] = ("age_group", "dose"), null_policy: str = "drop"
) -> DataFrame:
    """Doses per key and month as ``n``; unknown counts add nothing."""
    total = F.coalesce(F.sum("qty"), F.lit(0)).cast("bigint")
    return dose_rows(df, null_policy).groupBy(*keys, "month").agg(total.alias("n"))


def _doses(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("qty"))), F.lit(0)).cast("bigint")


def cumulative_doses_wide(
    df: DataFrame,
    calendar: Calendar,
    before: str,
    doses: Sequence[str] = dims.DOSES,
    null_policy: str = "drop",
) -> DataFrame:
    """National running dose totals, one ``doses_<dose>`` column per dose.

    One row per observed age group and month of the calendar, up to but without
    ``before``. Doses are columns of the first aggregate, so the grid over age
    and month is complete for each of them.
    """
    counts = (
        dose_rows(df, null_policy)
        .groupBy("age_group", "month")
        .agg(*[_doses(F.col("dose") == d).alias(f"n_{d}") for d in doses])
    )
    measures = [f"n_{d}" for d in doses]
    dense = complete_series(counts, ["age_group"], "month", calendar, measures)
    dense = dense.where(F.col("month") < F.lit(before).cast("date"))
    summed = running_sums(
        dense, ["age_group"], "month", {f"doses_{d}": f"n_{d}" for d in doses}
    )
    return summed.select("age_group", "month", *[f"doses_{d}" for d in doses])


def coverage_long(
    cumulative: DataFrame, population: DataFrame, doses: Mapping[str, str] = dims.DOSE_DISPLAY
) -> DataFrame:
    """Coverage percentages, one row per age group, month and dose label.

    The share without any dose is the complement of the first dose's. All
    labels are written out of the same row, without a union.
    """
    pcts = {label: percent(f"doses_{d}", "population") for d, label in doses.items()}
    first = next(iter(doses.values()))
    pcts = {dims.ZERO_DOSE: complement(pcts[first]), **pcts}
    return cumulative.join(population.select("age_group", "population"), "age_group").select(
        "age_group",
        "month",
        "population",
        F.inline(
            F.array(
                *[F.struct(F.lit(k).alias("dose_label"), v.alias("pct")) for k, v in pcts.items()]
            )
        ),
    )


def coverage_report(
    coverage: DataFrame,
    at: str,
    labels: Sequence[str] = (dims.ZERO_DOSE, *dims.DOSE_DISPLAY.values()),
) -> DataFrame:
    """Coverage at one month: age group, a percentage text per label, population."""
    wide = (
        coverage.where(F.col("month") == F.lit(at).cast("date"))
        .groupBy("age_group", "population")
        .pivot("dose_label", list(labels))
        .agg(F.first("pct"))
    )
    return wide.select(
        "age_group",
        *[percent_text(F.col(f"`{label}`")).alias(label) for label in labels],
        half_even("population").alias("population"),
    )


def provincial_coverage(
    df: DataFrame,
    population: DataFrame,
    calendar: Calendar,
    ages: Sequence[str] = dims.AGE_LABELS,
    doses: Mapping[str, str] = dims.DOSE_NAMES,
) -> DataFrame:
    """Running dose totals and coverage on a dense province grid.

    One row per observed province, age group, dose and month of the calendar.
    Age and dose are closed lists and become columns of the first aggregate,
    picked by a cell number that is looked up once per row;
    the calendar is filled per province, so the grid needs no join. Rows outside
    the calendar or without a known month do not count. A dose that is not in
    ``doses`` is an error.
    """
    pairs = [(a, d) for a in ages for d in doses]
    cells = {f"n{i}": pair for i, pair in enumerate(pairs)}
    row = recode("age_group", {a: i * len(doses) for i, a in enumerate(ages)})
    unknown = F.raise_error(F.concat(F.lit("unknown dose "), F.col("dose"))).cast("int")
    place = recode("dose", {d: i for i, d in enumerate(doses)})
    cell = row + F.when(F.col("dose").isNull() | F.col("dose").isin(*doses), place).otherwise(unknown)
    counts = (
        dose_rows(df)
        .where(F.col("age_band").isin(*dims.DOSE_BANDS))
        .select("province", "month", "qty", cell.alias("_cell"))
        .groupBy("province", "month")
        .agg(*[_doses(F.col("_cell") == i).alias(c) for i, c in enumerate(cells)])
    )
    dense = complete_series(counts, ["province"], "month", calendar, list(cells), outside="drop")
    summed = running_sums(dense, ["province"], "month", {f"cum_{c}": c for c in cells})
    long = summed.select(
        "province",
        "month",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("age_group"),
                        F.lit(doses[d]).alias("dose_name"),
                        F.col(c).alias("n"),
                        F.col(f"cum_{c}").alias("cum_n"),
                    )
                    for c, (a, d) in cells.items()
                ]
            )
        ),
    )
    pop = population.select("province", "age_group", "population")
    joined = join_per_key(long, pop, ["province", "age_group"], "left")
    return joined.withColumn("pct", percent("cum_n", "population"))


def with_zero_dose(
    df: DataFrame,
    dose: str = "dose_name",
    first: str = dims.DOSE_NAMES["1"],
    labels: Mapping[str, str] | None = None,
    clamped: bool = True,
) -> DataFrame:
    """Label doses for display and add a "0 dose" series, limited to [0, 100].

    Counts can pass a population that is held constant, so shares are limited
    for display; the snapshot by region uses them as they are.
    """
    labels = labels or {dims.DOSE_NAMES[d]: shown for d, shown in dims.DOSE_DISPLAY.items()}
    shown = recode(dose, labels, F.col(dose))
    own = F.struct(shown.alias("dose_label"), F.col("pct").alias("pct"))
    zero = F.struct(F.lit(dims.ZERO_DOSE).alias("dose_label"), complement("pct").alias("pct"))
    rest = [c for c in df.columns if c not in (dose, "pct")]
    out = df.select(
        *rest,
        F.inline(F.when(F.col(dose) == first, F.array(own, zero)).otherwise(F.array(own))),
    )
    return out.withColumn("pct", clamp("pct")) if clamped else out


def coverage_snapshot(
    df: DataFrame,
    regions: DataFrame,
    at: str,
    age_group: str,
    dose_name: str,
    names: Mapping[str, str] = dims.REGION_NAMES,
) -> DataFrame:
    """Coverage of one age group and dose at one month for every region.

    ``regions`` has a ``region`` label per row; regions without figures stay.
    """
    figures = df.where(
        (F.col("month") == F.lit(at).cast("date"))
        & (F.col("age_group") == age_group)
        & (F.col("dose_name") == dose_name)
    ).select(
        recode("province", names, F.col("province")).alias("region"),
        "age_group",
        "dose_name",
        "cum_n",
        "population",
        "pct",
    )
    return join_per_key(regions, figures, ["region"], "left")


def earliest_doses(
    df: DataFrame,
    null_policy: str = "drop_group",
    aliases: Mapping[str, str] = dims.DOSE_ALIASES,
    unknown: str = dims.UNKNOWN_PLACE,
) -> DataFrame:
    """Doses by age group, dose, date and province, each person's dose once.

    Of the records of one person and dose those at the earliest date count, all
    of them if several share it. ``null_policy="drop_group"`` drops a person's
    dose as soon as one of its dates is unknown, ``"ignore"`` only the records
    without a date. Earliest date and unknown dates are an aggregate that merges
    before the shuffle, joined back to the records; a person with very many
    records or dates makes no task of their own.
    """
    rows = (
        df.where(F.col("province") != unknown)
        .withColumn("dose_name", recode("dose_name", aliases, F.col("dose_name")))
        .select("person_id", "dose_name", "dose_date", "age_group", "province")
    )
    first = rows.groupBy("person_id", "dose_name").agg(
        F.min("dose_date").alias("dose_date"), F.max(F.col("dose_date").isNull()).alias("_undated")
    )
    if null_policy == "drop_group":
        first = first.where(~F.col("_undated"))
    dated = first.where(F.col("dose_date").isNotNull()).drop("_undated")
    kept = join_per_key(rows.where(F.col("dose_date").isNotNull()), dated, ["person_id", "dose_name", "dose_date"], "left_semi")
    return kept.groupBy("age_group", "dose_name", "dose_date", "province").agg(F.count(F.lit(1)).alias("n"))
