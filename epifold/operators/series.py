"""Regular time series: calendars, gap filling, running sums, ranks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epifold.operators.joins import join_per_key


@dataclass(frozen=True)
class Calendar:
    """Dates from ``start`` to ``end`` (ISO text, both included) by day or month.

    A monthly calendar starts on the first of a month.
    """

    start: str
    end: str
    step: str = "month"

    def __post_init__(self) -> None:
        if self.step not in ("day", "month"):
            raise ValueError(f"unknown step {self.step}")
        if self.step == "month" and not self.start.endswith("-01"):
            raise ValueError("a monthly calendar starts on the first of a month")

    @property
    def first(self) -> Column:
        return F.lit(self.start).cast("date")

    @property
    def last(self) -> Column:
        return F.lit(self.end).cast("date")

    def after(self, d: Column) -> Column:
        """First point of the unbounded calendar after a date."""
        return F.date_add(d, 1) if self.step == "day" else F.add_months(F.trunc(d, "MM"), 1)

    def before(self, d: Column) -> Column:
        """Last point of the unbounded calendar before a date."""
        return F.date_sub(d, 1) if self.step == "day" else F.trunc(F.date_sub(d, 1), "MM")

    def span(self, low: Column, high: Column) -> Column:
        """Points from ``low`` to ``high``, both points; none if they are out of order."""
        points = F.sequence(low, high, F.expr(f"interval 1 {self.step}"))
        return F.when(low <= high, points).otherwise(F.array().cast("array<date>"))

    def points(self) -> Column:
        """Array of all points."""
        return F.sequence(self.first, self.last, F.expr(f"interval 1 {self.step}"))


def complete_series(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    calendar: Calendar,
    measures: Sequence[str],
    outside: str = "keep",
) -> DataFrame:
    """Give every observed key a row per calendar point, zero where it has none.

    ``df`` has one row per key and ``at``; NULL is a key, and a row with a NULL
    ``at`` is kept as it is. Rows that lie outside the calendar survive too,
    unless ``outside="drop"``. Every row writes out the empty points since the
    row before it, and the last one also those after it: one window over the
    aggregated series, no join and no second read of the input.
    """
    w = W.partitionBy(*keys).orderBy(F.col(at).asc_nulls_last())
    kinds = dict(df.dtypes)
    marked = df.select(
        *keys,
        at,
        *measures,
        F.lag(at).over(w).alias("_before"),
        F.lead(F.lit(True)).over(w).isNull().alias("_last"),
    )

    def row(point, values):
        return F.struct(point.alias(at), *[v.alias(m) for m, v in zip(measures, values)])

    # greatest and least skip NULL: no row before, or no date of its own.
    gap = calendar.span(
        F.greatest(calendar.first, calendar.after(F.col("_before"))),
        F.least(calendar.last, calendar.before(F.col(at))),
    )
    tail = F.when(
        F.col("_last") & F.col(at).isNotNull(),
        calendar.span(F.greatest(calendar.first, calendar.after(F.col(at))), calendar.last),
    ).otherwise(F.array().cast("array<date>"))
    own = F.array(row(F.col(at), [F.col(m) for m in measures]))
    zeros = F.transform(
        F.concat(gap, tail), lambda p: row(p, [F.lit(0).cast(kinds[m]) for m in measures])
    )
    out = marked.select(*keys, F.inline(F.concat(own, zeros)))
    if outside == "drop":
        out = out.where(F.col(at).between(calendar.first, calendar.last))
    return out


def running_sums(
    df: DataFrame, keys: Sequence[str], at: str, sums: Mapping[str, str]
) -> DataFrame:
    """Add running sums, ``{new column: measure}``, per key in order of ``at``.

    For series at calendar grain; a NULL ``at`` comes last.
    """
    w = (
        W.partitionBy(*keys)
        .orderBy(F.col(at).asc_nulls_last())
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return df.withColumns({new: F.sum(measure).over(w) for new, measure in sums.items()})


def average_rank(value: str, keys: Sequence[str]) -> Column:
    """Rank by descending value, ties sharing the mean of their ranks.

    NULL values get no rank. For aggregated frames: a key's rows meet in one
    window partition.
    """
    order = W.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last())
    ties = F.count(F.lit(1)).over(W.partitionBy(*keys, value))
    return F.when(F.col(value).isNotNull(), F.rank().over(order) + (ties - 1) / F.lit(2.0))


def latest_point(
    df: DataFrame, at: str, keys: Sequence[str] = (), until: str | None = None
) -> DataFrame:
    """Rows at the latest date, overall or per key, ties kept.

    The maximum is an aggregate joined back on key and date, so that one long
    series does not end up in one task.
    """
    if until is not None:
        df = df.where(F.col(at) <= F.lit(until).cast("date"))
    top = df.groupBy(*keys).agg(F.max(at).alias(at))
    if not keys:
        # An aggregate without keys is one row.
        return df.join(F.broadcast(top), at, "left_semi")
    return join_per_key(df.where(F.col(at).isNotNull()), top, [*keys, at], "left_semi")


def period_totals(df: DataFrame, period: str, measure: str = "n") -> DataFrame:
    """Total of the measure per period over all sub-groups."""
    return df.groupBy(period).agg(F.sum(measure).alias(measure))


def totals_with_parts(
    df: DataFrame, period: str, part: str, measure: str = "n"
) -> DataFrame:
    """Totals per period together with their parts, in one pass.

    ``is_total`` tells the total row from the part whose own key is NULL.
    """
    return (
        df.rollup(period, part)
        .agg(F.sum(measure).alias(measure), F.grouping_id().alias("_level"))
        .where(F.col("_level") < 3)
        .select(period, part, measure, (F.col("_level") == 1).alias("is_total"))
    )


def strict_sum(c: Column | str) -> Column:
    """Sum that is NULL as soon as one value is NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.count(F.when(c.isNull(), 1)) == 0, F.sum(c))
