"""Line lists: ingest, corrections, de-duplication and event curves."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epifold import dims
from epifold.functions import age_band, dose_class, month_start
from epifold.operators.joins import join_per_key
from epifold.operators.series import Calendar, complete_series, running_sums
from epifold.sources.files import POSITION
from epifold.sources.literals import literal_table
from epifold.sources.manifest import materialise_current
from epifold.sources.storage import materialise_once


#: Bits of a row's number in its partition.
ROW_BITS = 33


def _union(a: DataFrame, b: DataFrame, names_a: Mapping, names_b: Mapping, more: Sequence[str]) -> DataFrame:
    def pick(df, names, source):
        own = [F.col(c).alias(n) for c, n in names.items()]
        return df.select(*own, *more, F.lit(source).alias("_source"))

    return pick(a, names_a, 0).unionByName(pick(b, names_b, 1))


def _arrival(rows: DataFrame) -> DataFrame:
    """Number rows by source, file, part of the file and row in the part.

    Parts are ranked in one small table, a row per part read; the rows inside a
    part are numbered by the read itself.
    """
    part = ["_source", "_file", "_block"]
    ranks = rows.select(*part).distinct().withColumn("_rank", F.row_number().over(W.orderBy(*part)).cast("bigint"))
    row = F.col("_row").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    numbered = rows.join(ranks, part).withColumn("seq", F.shiftleft("_rank", ROW_BITS) + row)
    return numbered.drop(*part, "_row", "_rank")


def ingest_linelist(
    a: DataFrame,
    b: DataFrame,
    path: str,
    names_a: Mapping[str, str],
    names_b: Mapping[str, str] | None = None,
    order: str | None = None,
    current: bool = False,
) -> DataFrame:
    """Union two differently laid out line lists and write the result once.

    ``names_*`` map source columns to common names. ``seq`` records arrival:
    the common column named by ``order``, else the position that
    ``files.read_csv(position=True)`` gives: first source first, then by file
    name and place in the file. Frames with neither are refused. It is fixed by
    the write, and later reads of the table see the same values. With
    ``current`` a table written from other rows, or under other names, is not
    taken for this one: it is written anew.
    """
    names_b = names_b or names_a

    def stored(build: Callable[[], DataFrame]) -> DataFrame:
        if not current:
            return materialise_once(build(), path)
        chosen = {"a": dict(names_a), "b": dict(names_b), "order": order}
        return materialise_current(build, path, [a, b], chosen, by="auto")

    if order is not None:
        return stored(lambda: _union(a, b, names_a, names_b, ()).drop("_source").withColumnRenamed(order, "seq"))
    if not all(c in df.columns for df in (a, b) for c in POSITION):
        raise ValueError("the order of arrival is not known: name a column or read with position=True")
    return stored(lambda: _arrival(_union(a, b, names_a, names_b, POSITION)))


def apply_overrides(
    df: DataFrame,
    overrides: DataFrame | Sequence[tuple],
    key: str,
    col: str,
    order: str | None = None,
) -> DataFrame:
    """Overwrite one field for the listed keys; every row stays one row.

    A list of pairs becomes a literal table, broadcast because its length is
    known; of several pairs for a key the last one counts. A DataFrame
    ``(key, col)`` is joined as the planner sees fit from its size; of several
    rows for a key the one with the largest ``order`` counts, and without
    ``order`` they are an error.
    """
    kinds = dict(df.dtypes)
    if isinstance(overrides, DataFrame):
        known = overrides.where(F.col(key).isNotNull())
        if order is not None:
            chosen = F.max_by(col, order)
        else:
            double = F.concat(F.lit("several corrections for "), F.col(key).cast("string"))
            chosen = F.when(F.count(F.lit(1)) > 1, F.raise_error(double).cast(kinds[col])).otherwise(F.first(col))
        fixes = known.groupBy(key).agg(chosen.alias("_override"))
        joined = join_per_key(df, fixes, [key], "left")
    else:
        key_kind = "string" if kinds[key] == "string" else "bigint"
        if key_kind == "bigint":
            overrides = [(int(k), v) for k, v in overrides]
        fixes = literal_table(
            df.sparkSession, list(dict(overrides).items()), ((key, key_kind), ("_override", kinds[col]))
        )
        joined = df.join(fixes, key, "left")
    return joined.withColumn(col, F.coalesce("_override", col)).select(*df.columns)


def first_record(df: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """First row of every key as it is.

    ``order`` is unique within a key. An aggregate rather than a window: rows of
    a key are reduced before the shuffle, so a key with very many rows costs no
    more than any other.
    """
    return dedup_linelist(df, key, order, best_of=())


def dedup_linelist(
    df: DataFrame, key: str, order: str = "seq", best_of: Sequence[str] = ()
) -> DataFrame:
    """One row per key: the first row, with the first known value of ``best_of``.

    Fields in ``best_of`` come from the earliest row that has them; they are
    NULL only when no row of the key has one.
    """

    def pick(c):
        by = F.when(F.col(c).isNotNull(), F.col(order)) if c in best_of else F.col(order)
        return F.min_by(c, by).alias(c)

    others = [c for c in df.columns if c not in (key, order)]
    picked = df.groupBy(key).agg(F.min(order).alias(order), *[pick(c) for c in others])
    return picked.select(*df.columns)


def child_records(df: DataFrame, age: str = "age", limit: int = dims.AGE_LIMITS[-1]) -> DataFrame:
    """Rows under the age limit with their band; the last band needs no upper bound."""
    return df.where(F.col(age) < limit).withColumn("age_group", age_band(age, closed_top=False))


def monthly_counts(
    df: DataFrame,
    date: str,
    keys: Sequence[str] = ("age_group",),
    until: str | None = None,
    calendar: Calendar | None = None,
) -> DataFrame:
    """Rows per key and month as ``month, n``; a NULL key is a group.

    Rows without a date or after ``until`` are left out. With a
    ``calendar`` every key gets all its months, zero where nothing happened.
    """
    keys = list(keys)
    dated = df.where(F.col(date).isNotNull())
    if until is not None:
        dated = dated.where(F.col(date) <= F.lit(until).cast("date"))
    counts = dated.groupBy(*keys, month_start(date).alias("month")).agg(
        F.count(F.lit(1)).alias("n")
    )
    if calendar is None:
        return counts
    return complete_series(counts, keys, "month", calendar, ["n"])


def daily_cumulative(
    df: DataFrame, date: str, keys: Sequence[str], calendar: Calendar
) -> DataFrame:
    """Gap-free daily counts per key with their running sum."""
    keys = list(keys)
    counts = df.groupBy(*keys, F.col(date).alias("date")).agg(F.count(F.lit(1)).alias("n"))
    dense = complete_series(counts, keys, "date", calendar, ["n"])
    return running_sums(dense, keys, "date", {"cum_n": "n"})


def daily_by_status(
    df: DataFrame,
    date: str,
    level: str,
    keys: Sequence[str],
    calendar: Calendar,
) -> DataFrame:
    """Gap-free daily counts by dose class, wide, with three running sums.

    ``level`` is a dose level as of :func:`epifold.functions.dose_level`. The
    classes are columns of the first aggregate, so one shuffle of the counts
    serves the calendar and the running sums.
    """
    keys = list(keys)
    status = dose_class(level)
    counts = df.groupBy(*keys, F.col(date).alias("date")).agg(
        *[F.count(F.when(status == c, 1)).alias(c) for c in dims.DOSE_CLASSES]
    )
    dense = complete_series(counts, keys, "date", calendar, dims.DOSE_CLASSES)
    cums = {f"cum_{i}": c for i, c in enumerate(dims.DOSE_CLASSES)}
    return running_sums(dense, keys, "date", cums)
