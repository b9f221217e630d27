"""Near-duplicate vectors: a navigable graph per shard, every shard asked by every vector.

Equal vectors are one class. Classes are dealt to shards by hash; each shard
builds a graph and widens its beam until an audit against brute force on a
sample of its members finds at least ``RECALL`` of their links. All classes are
then sent, in slices, to every shard, which travels in small pieces ahead of
them, so that no row grows with the input. A candidate counts if its cosine,
computed anew in double precision, reaches the threshold. A slice answers with
the number of linked vectors of each query and with a spanning forest of the
links found, so that a large cluster costs its members, not its pairs.

Defined results: a vector that is NULL, empty, zero or has a NULL or non-finite
component links with nothing, and so do rows without ``vec_id`` (component NULL).
Vectors of different lengths do not link. Repeated rows are linked copies; rows
with one ``vec_id`` share a component. Other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from epifold.llm import words
from epifold.llm.graph import components, forest
from epifold.llm.hnsw import Graph
from epifold.sources.storage import Scratch

SHARDS = 8
#: Classes per shard beyond which there are more shards.
SHARD_SIZE = 50_000
#: Bytes of a shard's vectors as doubles, beyond which there are more shards.
SHARD_BYTES = 1 << 26
#: Queries of a slice at least, if there are so many, and at most.
SLICE, LONG_SLICE = 16_384, 131_072
#: Pairs of a shard and a slice that are enough to keep all cores busy.
GROUPS = 64
#: Bytes of a row that holds a piece of a shard: readers and Arrow take thousands of rows at once.
PIECE = 1 << 12
#: Queries that search together, pairs that are compared together, and links held before a forest is made of them.
ASKED, COMPARED, HELD = 2048, 1 << 14, 1 << 18
SAMPLE = 512
RECALL = 0.995
#: Single-precision cosines may be off by less than this.
SLACK = 1e-4


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _single(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double and single precision; scaled first, so that nothing overflows."""
    vectors = vectors.astype(np.float64)
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    return unit, unit.astype(np.float32)


def _indexed(classes: DataFrame, least: float) -> DataFrame:
    """(part, place, content): shards, one for each vector length and number, cut into rows of ``PIECE`` bytes."""

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("rep")
        vectors = _matrix(table.column("v").combine_chunks())
        graph = Graph(_single(vectors)[1])
        graph.audit(least, SAMPLE, RECALL)
        out = io.BytesIO()
        members, sizes = table.column("rep").to_numpy(), table.column("n").to_numpy()
        np.savez(out, members=members, sizes=sizes, vectors=vectors, graph=np.frombuffer(graph.dump(), np.uint8))
        whole = out.getvalue()
        pieces = [whole[i : i + PIECE] for i in range(0, len(whole), PIECE)]
        part = pa.repeat(table.column("part")[0], len(pieces))
        return pa.table({"part": part, "place": pa.array(range(len(pieces)), pa.int32()), "content": pa.array(pieces, pa.binary())})

    schema = "part string, place int, content binary"
    return classes.select("part", "rep", "n", "v").groupBy("part").applyInArrow(build, schema)


def _loaded(pieces: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
    """Members, sizes, unit vectors in double precision and graph of a shard."""
    stored = np.load(io.BytesIO(b"".join(x.as_py() for batch in pieces for x in batch.column("content"))))
    unit, single = _single(stored["vectors"])
    return stored["members"], stored["sizes"], unit, Graph.load(stored["graph"].tobytes(), single)


def _asked(queries: DataFrame, index: DataFrame, threshold: float, groups: int) -> DataFrame:
    """(node, other, n): counts of linked vectors (other NULL) and links of a spanning forest (n NULL).

    A slice of queries passes by its shard in batches, so neither a shard nor
    a slice is ever a row, and a longer slice takes no more memory.
    """

    def rows(node: np.ndarray, other: np.ndarray | None, n: np.ndarray | None) -> pa.RecordBatch:
        columns = [pa.nulls(len(node), pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (node, other, n)]
        return pa.RecordBatch.from_arrays(columns, ["node", "other", "n"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, shard = [], None
        froms, tos, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for batch in batches:
            known = len(batch) - batch.column("place").null_count
            if known and shard:
                raise RuntimeError("a piece of a shard came after its queries")
            if known:
                pieces.append(batch.slice(0, known))
            if known == len(batch) or not (shard or pieces):
                continue
            if not shard:
                shard, pieces = _loaded(pieces), []
            members, sizes, own, graph = shard
            asking = batch.slice(known)
            for at in range(0, len(asking), ASKED):
                some = asking.slice(at, ASKED)
                reps = some.column("rep").to_numpy()
                unit, single = _single(_matrix(some.column("v")))
                total = np.zeros(len(reps), np.int64)
                for q, p in graph.pairs(single, threshold - SLACK):
                    for k in range(0, len(q), COMPARED):
                        a, b = q[k : k + COMPARED], p[k : k + COMPARED]
                        hit = (np.einsum("rd,rd->r", unit[a], own[b]) >= threshold) & (reps[a] != members[b])
                        total += np.bincount(a[hit], sizes[b[hit]], len(reps)).astype(np.int64)
                        # A forest of what was found so far keeps this small.
                        froms.append(reps[a[hit]])
                        tos.append(members[b[hit]])
                        held += int(hit.sum())
                        if held > HELD:
                            x, y = forest(np.concatenate(froms), np.concatenate(tos))
                            froms, tos, held = [x], [y], 0
                yield rows(reps[total > 0], None, total[total > 0])
        node, root = forest(np.concatenate(froms), np.concatenate(tos))
        yield rows(node[node != root], root[node != root], None)

    kind = queries.schema["v"].dataType.simpleString()
    left = queries.select("part", "slice", F.lit(None).cast("int").alias("place"), F.lit(None).cast("binary").alias("content"), "rep", "v")
    right = index.select("part", "slice", "place", "content", F.lit(None).cast("long").alias("rep"), F.lit(None).cast(kind).alias("v"))
    return (
        left.union(right)
        .repartition(4 * groups, "part", "slice")
        .sortWithinPartitions("part", "slice", F.col("place").asc_nulls_last())
        .groupBy("part", "slice")
        .applyInArrow(ask, "node long, other long, n long")
    )


def near_vectors(vectors: DataFrame, threshold: float = 0.95, shards: int = SHARDS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors``."""
    with Scratch(vectors.sparkSession, "vectors") as scratch:
        given = vectors.select("embedding").schema[0].dataType
        # Single precision stays as it is, half as long; cosines are of doubles all the same.
        short = isinstance(getattr(given, "elementType", None), FloatType)
        v = F.col("embedding").cast("array<float>" if short else "array<double>")
        rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        usable = rows.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
        classes = scratch.store(usable.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
        known, numbers = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
        least = max(shards, -(-known // SHARD_SIZE))
        # Long vectors make more shards; what all classes would need is enough for those of one length.
        count = F.greatest(F.lit(least), F.ceil(F.size("v") * F.lit(8 * known / SHARD_BYTES)))
        typical = max(least, -(-8 * numbers // SHARD_BYTES))
        slices = max(1, -(-known // LONG_SLICE), min(-(-known // SLICE), -(-GROUPS // typical)))
        placed = classes.withColumn("part", F.concat_ws("/", F.size("v"), F.pmod(F.xxhash64("rep", "v"), count)))
        index = scratch.store(_indexed(placed, threshold - SLACK), "index")
        parts = F.transform(F.sequence(F.lit(0), count - 1), lambda s: F.concat_ws("/", F.size("v"), s))
        queries = classes.select(
            "rep", "v", F.pmod(F.xxhash64("v", F.lit(1)), F.lit(slices)).alias("slice"), F.explode(parts).alias("part")
        )
        copies = index.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
        answers = scratch.store(_asked(queries, copies, threshold, typical * slices), "answers")
        linked = answers.where("n is not null").groupBy(F.col("node").alias("rep")).agg(F.sum("n").alias("beyond"))
        component = components(answers.where("other is not null"), scratch, "components", "node", "other")
        of_class = (
            classes.join(linked, "rep", "left")
            .join(component.withColumnRenamed("node", "rep"), "rep", "left")
            .select("v", (F.col("n") - 1 + F.coalesce("beyond", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("found"))
        )
        out = rows.withColumn("usable", F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
        good = out.where("usable").join(of_class, "v").select("vec_id", F.col("links").alias("n_links"), F.col("found").alias("component_id"))
        bad = out.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return scratch.keep(good.union(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
