"""Causes of death: counts, groups, ranks and before/after comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epifold import dims
from epifold.functions import fixed_decimals, recode, spaced_commas, without_code_suffix
from epifold.operators.series import average_rank, strict_sum
from epifold.sources.literals import cause_dimension, literal_table


def cause_counts(df: DataFrame, age: str = dims.REGISTER_CHILD_GROUP) -> DataFrame:
    """Deaths of one age group by year and cause as ``n``."""
    return (
        df.where(F.col("age_group") == age)
        .groupBy("age_group", "year", "cause_code", "cause_name")
        .agg(strict_sum("n").alias("n"))
    )


def top_causes(counts: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` leading causes of every year, ties kept.

    Filtering on ``rank()`` lets Spark cut each task's rows to its own leaders
    before the shuffle.
    """
    w = W.partitionBy("year").orderBy(F.col("n").desc())
    return (
        counts.where(F.col("n").isNotNull())
        .withColumn("_rank", F.rank().over(w))
        .where(F.col("_rank") <= n)
        .drop("_rank")
        .orderBy("year", F.desc("n"))
    )


def before_after(
    counts: DataFrame, diseases: Sequence[tuple] = dims.BEFORE_AFTER_DISEASES
) -> DataFrame:
    """Mean annual deaths before and after a vaccine, for all diseases in one pass.

    ``counts`` comes from :func:`cause_counts`; the choice of diseases filters on
    its keys and so reaches the scan. ``diseases`` lists (label, selector column, value, last pre-vaccine year,
    first year, last year). The disease-year grid is literal; its zeros are
    added to the register rows and both are summed together, so a year without
    deaths counts as zero and a year outside the grid still counts.
    """
    wanted = [
        F.when(F.col(column) == value, F.lit(label)) for label, column, value, *_ in diseases
    ]
    selectors = {}
    for _, column, value, *_ in diseases:
        selectors.setdefault(column, []).append(value)
    any_of = None
    for column, values in selectors.items():
        hit = F.col(column).isin(*values)
        any_of = hit if any_of is None else any_of | hit
    facts = counts.where(any_of).select(
        F.explode(F.array_compact(F.array(*wanted))).alias("disease"),
        "year",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )
    grid = literal_table(
        counts.sparkSession,
        [
            (label, year, 0)
            for label, _, _, _, first, last in diseases
            for year in range(first, last + 1)
        ],
        (("disease", "string"), ("year", "int"), ("n", "bigint")),
    )
    yearly = facts.unionByName(grid).groupBy("disease", "year").agg(F.sum("n").alias("n"))
    cutoff = recode("disease", {label: c for label, _, _, c, *_ in diseases})
    return (
        yearly.withColumn(
            "phase", F.when(F.col("year") <= cutoff, F.lit("pre-vac")).otherwise(F.lit("post-vac"))
        )
        .groupBy("disease", "phase")
        .agg(
            F.concat_ws("-", F.min("year"), F.max("year")).alias("period"),
            F.avg("n").alias("mean_deaths"),
        )
    )


def before_after_report(phases: DataFrame) -> DataFrame:
    """One row per disease with both periods; a dash where one is missing."""
    wide = (
        phases.groupBy("disease")
        .pivot("phase", ["pre-vac", "post-vac"])
        .agg(F.first("period").alias("period"), F.first("mean_deaths").alias("mean"))
    )

    def text(c):
        return F.coalesce(c, F.lit("-"))

    return wide.select(
        "disease",
        text(F.col("`pre-vac_period`")).alias("pre_period"),
        text(fixed_decimals(F.col("`pre-vac_mean`"))).alias("pre_deaths"),
        text(F.col("`post-vac_period`")).alias("post_period"),
        text(fixed_decimals(F.col("`post-vac_mean`"))).alias("post_deaths"),
    )


def cause_group(df: DataFrame, code: str = "cause_code") -> DataFrame:
    """Add ``cause_group`` and ``cause_group_short``; unlisted codes are "Others".

    An equi-join with the broadcast code dimension, so that it can run ahead of
    the first aggregate and no shuffle carries single codes.
    """
    codes = cause_dimension(df.sparkSession).withColumnRenamed("cause_code", code)
    return (
        df.join(codes, code, "left")
        .withColumns(
            {
                "cause_group": F.coalesce("cause_group", F.lit(dims.OTHERS)),
                "cause_group_short": F.coalesce("cause_group_short", F.lit(dims.OTHERS)),
            }
        )
        .select(*df.columns, "cause_group", "cause_group_short")
    )


def named_cause(df: DataFrame, code: str = "cause_code", name: str = "cause_name") -> DataFrame:
    """Replace the register's own wording for the pandemic code."""
    return df.withColumn(
        name, F.when(F.col(code) == dims.COVID_CODE, F.lit(dims.COVID_LABEL)).otherwise(F.col(name))
    )


def _group_deaths(df: DataFrame, keys: Sequence[str], subset: Sequence[str] | None) -> DataFrame:
    grouped = cause_group(df)
    if subset is None:
        grouped = grouped.where(F.col("cause_group") != dims.OTHERS)
    else:
        grouped = grouped.where(F.col("cause_group").isin(*subset))
    return grouped.groupBy(*keys).agg(strict_sum("n").alias("deaths"))


def rank_causes(df: DataFrame, year: int, subset: Sequence[str] | None = None) -> DataFrame:
    """Cause groups of one year ranked by deaths, ties sharing their mean rank.

    "Others" never takes part; ``subset`` limits the groups that do.
    """
    deaths = _group_deaths(df.where(F.col("year") == year), ["year", "cause_group"], subset)
    return deaths.withColumn("rank", average_rank("deaths", ["year"])).select(
        "rank", "cause_group", "deaths"
    )


def rank_series(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    since: int | None = None,
    top: int | None = None,
) -> DataFrame:
    """Rank of every cause group in every year.

    ``since`` and ``top`` limit the rows shown, after ranking. At most one row
    per cause group and year reaches the window.
    """
    if since is not None:
        df = df.where(F.col("year") >= since)
    ranked = _group_deaths(df, ["year", "cause_group"], subset).withColumn(
        "rank", average_rank("deaths", ["year"])
    )
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def with_display_labels(
    df: DataFrame,
    col: str = "cause_group",
    replacements: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add ``label`` (blank after commas) and ``label_short`` (no code list).

    ``replacements`` swaps whole labels first, such as
    ``dims.INFECTIOUS_REPLACEMENT``.
    """
    named = recode(col, replacements, F.col(col)) if replacements else F.col(col)
    return df.withColumns(
        {"label": spaced_commas(named), "label_short": without_code_suffix(named)}
    )


def cause_year_matrix(
    df: DataFrame, years: Sequence[int], subset: Sequence[str] | None = None
) -> DataFrame:
    """Deaths by cause group (rows) and year (columns), zero-filled."""
    grouped = _group_deaths(
        df.where(F.col("year").isin(*years)), ["cause_group", "year"], subset
    )
    shown = with_display_labels(
        grouped, replacements=dims.INFECTIOUS_REPLACEMENT if subset else None
    )
    names = [str(y) for y in years]
    return (
        shown.groupBy("label")
        .pivot("year", list(years))
        .agg(F.first("deaths"))
        .fillna(0, subset=names)
    )
