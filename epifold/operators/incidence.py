"""Cumulative incidence of deaths by dose status."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epifold import dims
from epifold.functions import guarded, month_start, per_population, recode


def join_exposure(deaths: DataFrame, population: DataFrame, doses: DataFrame) -> DataFrame:
    """Daily deaths with the population and running dose totals of their group.

    Dose totals are dated at month starts, so only those days carry them. All
    three inputs are at calendar grain by now; no hint is given, and the
    adaptive planner turns the joins into broadcasts from their actual size.
    """
    totals = doses.withColumnRenamed("month", "date")
    return deaths.join(population.select("age_group", "population"), "age_group").join(
        totals, ["date", "age_group"], "left"
    )


def cumulative_incidence(
    df: DataFrame, since: str, until: str, per: float = 100_000.0
) -> DataFrame:
    """Five incidence rates per age group at the month starts in [since, until).

    Running deaths count from their value at the first such day. Notes:

    * where no doses are known to have been given, the rates of people without
      doses fall back to the deaths of that single day over the population;
    * deaths run through the first of a month, doses through its end, because
      monthly totals carry the month's first day;
    * ``inc1e_cum`` divides deaths after exactly one dose by people with at
      least one;
    * a population at or under the doses given yields NULL or negative rates.
    """
    d = F.col("date")
    window = df.where(
        (d >= F.lit(since).cast("date"))
        & (d < F.lit(until).cast("date"))
        & (d == month_start("date"))
    )
    w = W.partitionBy("age_group")
    window = window.withColumns({f"_b{i}": F.min(f"cum_{i}").over(w) for i in range(3)})
    s0, s1, s2 = (F.col(f"cum_{i}") - F.col(f"_b{i}") for i in range(3))
    pop, one, two = F.col("population"), F.col("doses_1"), F.col("doses_2")
    daily, zero = per_population("d0", pop, per), F.lit(0.0)
    return window.withColumns(
        {
            "inc0_cum": guarded(one > 0, per_population(s0, pop - one, per), daily),
            "inc0b_cum": guarded(two > 0, per_population(s0 + s1, pop - two, per), daily),
            "inc1_cum": guarded(one > 0, per_population(s1 + s2, one, per), zero),
            "inc1e_cum": guarded(one > 0, per_population(s1, one, per), zero),
            "inc2_cum": F.when(two > 0, per_population(s2, two, per)).otherwise(zero),
        }
    ).drop("_b0", "_b1", "_b2")


def incidence_long(
    df: DataFrame,
    since: str,
    until: str,
    labels: Mapping[str, str] = dims.INCIDENCE_LABELS,
    empty: Sequence[tuple[str, str]] = dims.EMPTY_INCIDENCE,
) -> DataFrame:
    """Rates of [since, until] as rows ``age_label, date, dose_label, incidence``.

    ``empty`` names the (age, dose) series that have no events by construction;
    pass ``()`` to keep them.
    """
    long = (
        df.where(F.col("date").between(F.lit(since).cast("date"), F.lit(until).cast("date")))
        .withColumn("age_label", recode("age_group", dims.AGE_DISPLAY))
        .unpivot(["age_label", "date"], list(labels), "_rate", "incidence")
        .select("age_label", "date", recode("_rate", labels).alias("dose_label"), "incidence")
    )
    for age, dose in empty:
        cell = (F.col("age_label") == age) & (F.col("dose_label") == dose)
        long = long.where(~F.coalesce(cell, F.lit(False)))
    return long
