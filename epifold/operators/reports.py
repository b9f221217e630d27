"""Report tables of deaths and annotated monthly series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epifold import dims
from epifold.functions import annotate_zero, month_start, padded_cell, year_month


def deaths_by_period(
    daily: DataFrame, period: str = "year", cap: str | None = None
) -> DataFrame:
    """Deaths per age group and period, ``nonvac`` and ``vac``.

    ``daily`` comes from ``daily_by_status``. People with a single dose count
    as not vaccinated. Counts are not negative, so the last running sum of a
    period is its plain sum.
    """
    if cap is not None:
        daily = daily.where(F.col("date") <= F.lit(cap).cast("date"))
    at = F.year("date") if period == "year" else month_start("date")
    return daily.groupBy("age_group", at.alias(period)).agg(
        F.sum(F.col("d0") + F.col("d1")).alias("nonvac"), F.sum("d2plus").alias("vac")
    )


def yearly_deaths_report(
    daily: DataFrame, cap: str = dims.DATE_CAP, ages: Sequence[str] = dims.AGE_LABELS
) -> DataFrame:
    """Deaths by year, a pair of columns ``<age>_nonvac, <age>_vac`` per age group."""
    return (
        deaths_by_period(daily, "year", cap)
        .groupBy("year")
        .pivot("age_group", list(ages))
        .agg(F.first("nonvac").alias("nonvac"), F.first("vac").alias("vac"))
    )


def monthly_deaths_report(daily: DataFrame) -> DataFrame:
    """Deaths by age group and month text; no upper bound on the date."""
    return deaths_by_period(daily, "month").select(
        "age_group", year_month("month").alias("year_month"), "nonvac", "vac"
    )


def annotate_zeroes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The named columns as padded text cells with every zero starred."""
    return df.withColumns({c: annotate_zero(padded_cell(c)) for c in cols})


def annotate_intervals(
    monthly: DataFrame, intervals: DataFrame, month: str = "month"
) -> DataFrame:
    """One row per month of the series and interval active in that month.

    Intervals are written out to the months they touch, which turns the overlap
    into a join on equal months.
    """
    touched = intervals.select(
        "event",
        "event_group",
        F.explode(
            F.sequence(month_start("start"), month_start("end"), F.expr("interval 1 month"))
        ).alias(month),
    )
    return monthly.join(touched, month)
