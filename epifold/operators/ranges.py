"""Prefix sums and ranks at the grain of the rows.

One long series must not be one task. Values are first reduced to one row per key
and point. These rows are dealt to ranges of key and point of about equal size,
which cut a long series where needed. Sums per key and range are small; their
running sums are what a key carries into each of its ranges, where they join the
rows as one row more. Every window then covers one range or one row per range.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epifold.operators.joins import join_per_key
from epifold.sources.storage import cut


def prefix_sums(
    cells: DataFrame,
    keys: Sequence[str],
    at: str,
    sums: Mapping[str, str],
    descending: bool = False,
    ranges: int | None = None,
    fix: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add running sums, ``{new column: measure}``, per key in order of ``at``.

    ``cells`` has one row per key and ``at``. NULL is a key and the last point. A
    running sum is NULL until the first known value. ``fix`` stores the rows with
    their ranges, by default as a checkpoint.
    """
    keys = list(keys)
    ranges = ranges or int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    point = F.col(at).desc_nulls_last() if descending else F.col(at).asc_nulls_last()
    dealt = cells.repartitionByRange(ranges, *keys, point).withColumn("_range", F.spark_partition_id())
    # Stored, as the bounds of ranges are drawn anew with every run.
    dealt = (fix or cut)(dealt.withColumn("_carry", F.lit(False)))
    of_range = dealt.groupBy(*keys, "_range").agg(*[F.sum(m).alias(m) for m in sums.values()])
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = of_range.select(*keys, "_range", *[F.sum(m).over(before).alias(m) for m in sums.values()])
    carried = carried.withColumn("_carry", F.lit(True))
    inside = W.partitionBy(*keys, "_range").orderBy(F.desc("_carry"), point).rowsBetween(W.unboundedPreceding, W.currentRow)
    both = dealt.unionByName(carried, allowMissingColumns=True)
    added = both.withColumns({new: F.sum(m).over(inside) for new, m in sums.items()})
    return added.where(~F.col("_carry")).select(*cells.columns, *sums)


def running_sums_of_rows(
    df: DataFrame, keys: Sequence[str], at: str, sums: Mapping[str, str], ranges: int | None = None
) -> DataFrame:
    """Add running sums per key in order of ``at`` to every row; rows at one point share theirs.

    ``at`` and the keys may hold NULL; a NULL ``at`` comes last. Rows of one key
    and point are reduced before the shuffle, so neither a key nor a point with
    most of the rows is a task of its own.
    """
    keys = list(keys)
    cells = df.groupBy(*keys, at).agg(*[F.sum(m).alias(f"_sum_{i}") for i, m in enumerate(sums.values())])
    added = prefix_sums(cells, keys, at, {new: f"_sum_{i}" for i, new in enumerate(sums)}, ranges=ranges)
    return join_per_key(df, added.select(*keys, at, *sums), [*keys, at], "left")


def average_ranks_of_rows(
    df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "rank", ranges: int | None = None
) -> DataFrame:
    """Add the rank by descending value per key, ties sharing the mean of theirs; NULL has no rank.

    A rank follows from how many rows have a value at least as high, so equal
    values are one row of the prefix sums and no tie lies in two ranges.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_ties"))
    added = prefix_sums(counts, keys, value, {"_until": "_ties"}, descending=True, ranges=ranges)
    rank = F.col("_until") - (F.col("_ties") - 1) / F.lit(2.0)
    return join_per_key(df, added.select(*keys, value, rank.alias(name)), [*keys, value], "left")
