"""Population of study age bands from five-year bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epifold import dims
from epifold.operators.series import strict_sum
from epifold.sources.literals import literal_table


def _weighted(pop: DataFrame, band: str, n: str, parts) -> DataFrame:
    shares = literal_table(
        pop.sparkSession, parts, ((band, "string"), ("age_group", "string"), ("_share", "int"))
    )
    return pop.join(shares, band).withColumn("_n", F.col(n).cast("bigint") * F.col("_share"))


def apportion(
    pop: DataFrame,
    keys: Sequence[str] = ("province",),
    band: str = "band5",
    n: str = "n",
    parts=dims.BAND_FIFTHS,
    whole: int = 5,
) -> DataFrame:
    """Population per key and study band as ``population``.

    ``parts`` lists (source band, study band, share of ``whole``). Shares are
    summed as integers and divided once. Bands that no part names are left out,
    and an unknown count makes its sums unknown. ``keys=()`` is the national
    figure, from the same single pass.
    """
    return (
        _weighted(pop, band, n, parts)
        .groupBy(*keys, "age_group")
        .agg((strict_sum("_n") / F.lit(float(whole))).alias("population"))
    )


def population_with_national(
    pop: DataFrame,
    key: str = "province",
    band: str = "band5",
    n: str = "n",
    parts=dims.BAND_FIFTHS,
    whole: int = 5,
) -> DataFrame:
    """Provincial and national population in one pass; ``is_national`` marks the latter."""
    return (
        _weighted(pop, band, n, parts)
        .rollup("age_group", key)
        .agg(
            (strict_sum("_n") / F.lit(float(whole))).alias("population"),
            F.grouping_id().alias("_level"),
        )
        .where(F.col("_level") < 3)
        .select(key, "age_group", "population", (F.col("_level") == 1).alias("is_national"))
    )
