"""Region label points from polygon vertices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epifold.sources.literals import literal_table
from epifold.sources.storage import cut


def ring_edges(vertices: DataFrame) -> DataFrame:
    """``region, x0, y0, x1, y1`` for each two vertices that follow each other in a ring."""
    ring = W.partitionBy("region", "ring").orderBy("idx")
    edges = vertices.select(
        "region",
        F.col("x").alias("x0"),
        F.col("y").alias("y0"),
        F.lead("x").over(ring).alias("x1"),
        F.lead("y").over(ring).alias("y1"),
    )
    return edges.where(F.col("x1").isNotNull())


def split_ring_edges(vertices: DataFrame, parts: int | None = None) -> DataFrame:
    """The edges of :func:`ring_edges` for rings too long for one task.

    Vertices are dealt to ranges of region, ring and index, which may cut a ring
    anywhere. Edges inside a range come from a window over it. Of every ring and
    range the first and last vertex are kept, and the edges between ranges join
    the last one with the first one of the ring's next range.
    """
    spark = vertices.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = vertices.repartitionByRange(parts, "region", "ring", "idx").withColumn("_part", F.spark_partition_id())
    # Fixed by a checkpoint, as the bounds of ranges are drawn anew with every run.
    ranged = cut(ranged.select("region", "ring", "_part", "idx", "x", "y"))
    inside = W.partitionBy("region", "ring", "_part").orderBy("idx")
    edges = ranged.select(
        "region", F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(inside).alias("x1"), F.lead("y").over(inside).alias("y1")
    )
    point = F.struct("x", "y")
    ends = ranged.groupBy("region", "ring", "_part").agg(F.min_by(point, "idx").alias("_first"), F.max_by(point, "idx").alias("_last"))
    # A row per ring and range it lies in.
    beside = W.partitionBy("region", "ring").orderBy("_part")
    crossing = ends.withColumn("_next", F.lead("_first").over(beside)).select(
        "region", F.col("_last.x").alias("x0"), F.col("_last.y").alias("y0"), F.col("_next.x").alias("x1"), F.col("_next.y").alias("y1")
    )
    return edges.unionByName(crossing).where(F.col("x1").isNotNull())


def polygon_centroids(
    vertices: DataFrame,
    overrides: Sequence[tuple[str, float | None, float | None]] = (),
    moved: Sequence[tuple[float, float, float, float]] = (),
    digits: int = 2,
    split: bool = False,
) -> DataFrame:
    """Area centroid per region as ``region, x, y, area``.

    ``vertices`` has one row per vertex: ``region, ring, idx, x, y``, with
    closed rings in the order of ``idx``, which may have gaps, and holes wound
    the other way round. ``overrides`` lists (region, x, y), NULL leaving a
    coordinate as it is; ``moved`` lists (x, y, new x, new y) for points that
    are at (x, y) when rounded to ``digits``.

    A ring is sorted in one task, which spills; with ``split`` a ring is cut
    where needed. Edges are summed with partial aggregation.
    """
    edges = split_ring_edges(vertices) if split else ring_edges(vertices)
    cross = F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")
    sums = edges.groupBy("region").agg(
        F.sum(cross).alias("a2"),
        F.sum((F.col("x0") + F.col("x1")) * cross).alias("sx"),
        F.sum((F.col("y0") + F.col("y1")) * cross).alias("sy"),
    )
    points = sums.select(
        "region",
        F.try_divide("sx", F.col("a2") * 3).alias("x"),
        F.try_divide("sy", F.col("a2") * 3).alias("y"),
        F.abs(F.col("a2") / 2).alias("area"),
    )
    if moved:
        at = F.array(F.round("x", digits), F.round("y", digits))
        for x, y, new_x, new_y in moved:
            here = at == F.array(F.lit(float(x)), F.lit(float(y)))
            points = points.withColumns(
                {c: F.when(here, F.lit(float(v))).otherwise(F.col(c)) for c, v in (("x", new_x), ("y", new_y))}
            )
    if not overrides:
        return points
    fixes = literal_table(
        vertices.sparkSession, overrides, (("region", "string"), ("_x", "double"), ("_y", "double"))
    )
    return points.join(fixes, "region", "left").select(
        "region", F.coalesce("_x", "x").alias("x"), F.coalesce("_y", "y").alias("y"), "area"
    )
