"""Comorbidity classes and their frequency."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epifold import dims
from epifold.functions import flag_count, flag_set, recode


def _in_period(date: str, after: str | None, until: str | None) -> Column:
    ok = F.col(date).isNotNull()
    if after is not None:
        ok = ok & (F.col(date) > F.lit(after).cast("date"))
    if until is not None:
        ok = ok & (F.col(date) <= F.lit(until).cast("date"))
    return F.coalesce(ok, F.lit(False))


def flag_class(flags: Sequence[str], counted: Sequence[str]) -> Column:
    """Class of one row of text flags, as a number for :func:`class_names`.

    No flag set: none reported. More than one of the ``counted`` flags: several.
    Else the set flag, counted ones first. A NULL flag leaves the class NULL.
    """
    names = class_names(flags, counted)
    known = reduce(and_, [F.col(f).isNotNull() for f in flags])
    chosen = F.coalesce(
        *[F.when(flag_set(f), F.lit(i)) for i, f in enumerate(names) if f in flags],
        F.lit(names.index(dims.NONE_REPORTED)),
    )
    several = F.when(flag_count(counted) > 1, F.lit(names.index(dims.MULTIPLE)))
    return F.when(known, F.coalesce(several, chosen))


def class_names(flags: Sequence[str], counted: Sequence[str]) -> list[str]:
    """Names of the classes by number."""
    rest = [f for f in flags if f not in counted]
    return [*counted, *rest, dims.NONE_REPORTED, dims.MULTIPLE]


def condition_from_flags(
    df: DataFrame,
    flags: Sequence[str],
    counted: Sequence[str],
    labels: Mapping[str, str] = dims.FLAG_CONDITIONS,
    key: str = "case_id",
    date: str = "death_date",
    after: str | None = dims.CONDITION_PERIOD[0],
    until: str | None = None,
) -> DataFrame:
    """Condition classes of each key as ``condition, n_rows``.

    All rows of a key count as soon as one of them lies in the period. Rows are
    first reduced to one per key and class, of which there are as many as
    flags; only those meet in the window that looks for the period.
    """
    classes = df.groupBy(key, flag_class(flags, counted).alias("_class")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(_in_period(date, after, until)).alias("_hit")
    )
    kept = classes.withColumn("_hit", F.max("_hit").over(W.partitionBy(key))).where("_hit")
    shown = {
        i: labels[name] for i, name in enumerate(class_names(flags, counted)) if name in labels
    }
    return (
        kept.withColumn("condition", recode("_class", shown))
        .groupBy(key, "condition")
        .agg(F.sum("n_rows").alias("n_rows"))
    )


def condition_from_rows(
    df: DataFrame,
    labels: Mapping[str, str] = dims.ROW_CONDITIONS,
    key: str = "case_id",
    col: str = "condition",
    date: str = "death_date",
    after: str | None = dims.CONDITION_PERIOD[0],
    until: str | None = dims.CONDITION_PERIOD[1],
    distinct_values: bool = False,
) -> DataFrame:
    """Condition class of each key listed in one or more rows.

    A key with more than one row has several conditions, the same one repeated
    included; ``distinct_values`` counts different ones only. A NULL means none
    reported. All rows of a key count as soon as one lies in the period. A
    single aggregate: no join with the list of keys, no window over rows.
    """
    stated = F.coalesce(F.col(col), F.lit(dims.NONE_REPORTED))
    known = list(labels)
    # The position in the dictionary stands for the value: a number keeps the
    # aggregation buffer at a fixed width, so the aggregate can hash.
    position = recode(stated, {value: i for i, value in enumerate(known)})
    several = F.col("n_rows") > 1
    extra = []
    if distinct_values:
        several = F.col("_low") != F.col("_high")
        extra = [F.min(stated).alias("_low"), F.max(stated).alias("_high")]
    cases = df.groupBy(key).agg(
        F.max(position).alias("_position"),
        F.count(F.lit(1)).alias("n_rows"),
        F.max(_in_period(date, after, until)).alias("_hit"),
        *extra,
    )
    single = recode("_position", {i: labels[value] for i, value in enumerate(known)})
    multiple = F.lit(labels.get(dims.MULTIPLE)).cast("string")
    return cases.where("_hit").select(
        key, F.when(several, multiple).otherwise(single).alias("condition"), "n_rows"
    )


def condition_frequency(a: DataFrame, b: DataFrame, key: str = "case_id") -> DataFrame:
    """Cases per class over both sources, each (key, class) once, most frequent first."""
    pairs = a.select(key, "condition").unionByName(b.select(key, "condition")).distinct()
    return (
        pairs.groupBy("condition")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc_nulls_last("condition"))
    )
