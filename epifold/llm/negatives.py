"""Hard negatives: rows of another label whose inner product lies in a window below a positive's.

Rows are dealt by hash to shards; each shard packs an R-tree (``rtree``). The
anchors, in slices, ask every shard twice: for the best rows of their own label,
and then, with a window for each positive, for the best rows of other labels.
Each shard answers with its own first rows, which are merged by rank.

A row takes part if it has an id, a label and a vector without NULL, non-finite
or very large (``LARGEST`` or more) components. Where ``vec_id`` is divisible by
7 the label moves on by one, modulo 10. Components become floor(256 * x).

Defined results: exact repeats of a row count once; rows with one ``vec_id`` and
another label or vector are different rows. Empty vectors score 0. Vectors of
different lengths do not meet. Anchors without a positive, or positives without
a negative, give no row. A positive with a negative score has an empty window.
Other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epifold.llm.rtree import ANY, Tree
from epifold.sources.storage import Scratch

SCALE = 256
LARGEST = 2.0**16
ANCHOR_STEP = 100
POSITIVES = 5
NEGATIVES = 10
#: Bounds of a negative's score as hundredths of the positive's.
WINDOW = (30, 90)
SHARDS = 8
#: Bytes of vectors in a shard, as longs.
SHARD_BYTES = 16 << 20
#: Anchors that ask a shard together.
SLICE = 256


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, q, mark): distinct rows that take part; the mark tells rows with one id apart."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    known = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(good, F.lit(False)))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("v", lambda c: F.floor(c * SCALE).cast("long"))
    out = known.select("vec_id", moved.alias("label"), whole.alias("q")).distinct()
    return out.withColumn("mark", F.xxhash64("label", "q"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def indexed(rows: DataFrame, shards: int) -> DataFrame:
    """(part, tree): one row per vector length and shard."""

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        one = {c: table.column(c).combine_chunks() for c in ("vec_id", "mark", "label", "q")}
        tree = Tree(_matrix(one["q"]), *(one[c].to_numpy() for c in ("vec_id", "mark", "label")))
        return pa.table({"part": table.column("part")[:1], "tree": pa.array([tree.dump()], pa.binary())})

    shard = F.pmod(F.xxhash64("vec_id", "mark"), F.lit(shards))
    placed = rows.withColumn("part", F.concat_ws("/", F.size("q"), shard))
    return placed.groupBy("part").applyInArrow(build, "part string, tree binary")


def _asked(anchors: DataFrame, index: DataFrame, shards: int, slices: int, ask, schema: str) -> DataFrame:
    """What ``ask(tree, anchor row)`` yields for every anchor and shard of its vector length."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.concat_ws("/", F.size("q"), s))
    slice_ = F.pmod(F.xxhash64("anchor_id", "anchor_mark", F.lit(1)), F.lit(slices))
    queries = anchors.withColumn("slice", slice_).withColumn("part", F.explode(parts))
    copies = index.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            tree = Tree.load(right.column("tree")[0].as_py())
            left = left.combine_chunks()
            vectors = _matrix(left.column("q").combine_chunks())
            for anchor, vector in zip(left.drop_columns(["q", "part", "slice"]).to_pylist(), vectors):
                rows += ask(tree, vector, anchor)
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})

    return queries.groupBy("part", "slice").cogroup(copies.groupBy("part", "slice")).applyInArrow(run, schema)


def _first(found: DataFrame, group: list[str], score: str, id_: str, mark: str, take: int) -> DataFrame:
    """The first rows of each group, with their rank."""
    order = Window.partitionBy(*group).orderBy(F.desc(score), id_, mark)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= take)


def _positives(tree: Tree, vector: np.ndarray, anchor: dict) -> list[tuple]:
    me = anchor["anchor_id"], anchor["anchor_mark"]
    (best,) = tree.best(vector, anchor["label"], True, [ANY], POSITIVES, skip=me)
    return [(*me, i, m, s) for s, i, m in best]


def _negatives(tree: Tree, vector: np.ndarray, anchor: dict) -> list[tuple]:
    me = anchor["anchor_id"], anchor["anchor_mark"]
    low, high = WINDOW
    # Bounds in whole numbers: the smallest and the largest score that fit.
    windows = {p["positive_score"]: (-(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in anchor["positives"]}
    windows = {s: w for s, w in windows.items() if w[0] <= w[1]}
    if not windows:
        return []
    best = dict(zip(windows, tree.best(vector, anchor["label"], False, list(windows.values()), NEGATIVES)))
    return [
        (*me, p["positive_id"], p["positive_mark"], p["positive_score"], i, m, s)
        for p in anchor["positives"]
        for s, i, m in best.get(p["positive_score"], ())
    ]


ANCHOR = "anchor_id long, anchor_mark long"
POSITIVE = f"{ANCHOR}, positive_id long, positive_mark long, positive_score long"
RESULT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def hard_negatives(vectors: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) per anchor, positive and negative."""
    with Scratch(vectors.sparkSession, "negatives") as scratch:
        rows = scratch.store(usable(vectors), "rows")
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("q")).alias("entries")).first()
        shards = max(shards, -(-8 * (size.entries or 0) // SHARD_BYTES))
        index = scratch.store(indexed(rows, shards), "index")
        chosen = rows.where(F.col("vec_id") % ANCHOR_STEP == 0)
        anchors = chosen.select(F.col("vec_id").alias("anchor_id"), F.col("mark").alias("anchor_mark"), "label", "q")
        slices = max(1, -(-anchors.count() // SLICE))
        key = ["anchor_id", "anchor_mark"]
        found = _asked(anchors, index, shards, slices, _positives, POSITIVE)
        best = _first(found, key, "positive_score", "positive_id", "positive_mark", POSITIVES)
        listed = best.groupBy(*key).agg(F.collect_list(F.struct("positive_id", "positive_mark", "positive_score")).alias("positives"))
        asking = scratch.store(anchors.join(listed, key), "asking")
        found = _asked(asking, index, shards, slices, _negatives, f"{POSITIVE}, negative_id long, negative_mark long, negative_score long")
        pair = [*key, "positive_id", "positive_mark", "positive_score"]
        return scratch.keep(_first(found, pair, "negative_score", "negative_id", "negative_mark", NEGATIVES).select(*RESULT))
