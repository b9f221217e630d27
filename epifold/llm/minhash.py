"""Near-duplicate documents: min-hash signatures joined within a Hamming distance.

A signature has ``POSITIONS`` places of ``BITS`` bits. It is cut into chunks; if
two signatures differ in at most ``DISTANCE`` places, then by the pigeonhole
principle one chunk differs in at most ``ERRORS`` of its places. Every way to
leave out so many places of a chunk is enumerated, and the rest is a key: two
signatures within the distance always share a key. The pairs that share one are
then confirmed on their full shingle sets.

Defined results: a NULL text is empty; an empty set links with nothing; rows with
one ``doc_id`` are one document for the components, each row is returned; a row
without ``doc_id`` links with nothing, has no component and is kept. Other
columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epifold.llm import words
from epifold.llm.graph import components
from epifold.operators.joins import join_per_key
from epifold.sources.storage import Scratch

POSITIONS = 96
CHUNKS = 16
ERRORS = 1
#: All pairs of signatures that differ in at most so many places share a key.
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Longs of the parity sketch: bit b says whether the set has an odd number of
#: items that hash to b. Two sketches differ in at most as many bits as the sets
#: have items that are in one of them only, so it rules out pairs without error.
SKETCH = 16
#: Rounds of comparisons with one row of each key before the rest is listed.
PIVOT_ROUNDS = 3

_rng = np.random.default_rng(97)
FACTORS = _rng.integers(0, 2**32, POSITIONS, dtype=np.uint32) | np.uint32(1)
MASKS = _rng.integers(0, 2**32, POSITIONS, dtype=np.uint32)
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
SHINGLES_AT_ONCE = 1 << 15


def shingles_of(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each row in ascending order, and row offsets."""
    data = words.LOWER[data]
    starts, ends, before = words.words_of(data, offsets)
    hashed = words.hash_spans(data, starts, ends)
    counts = np.diff(before)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = words.offsets_of(runs)
    row = words.owners(bounds)
    first = before[row] + np.arange(len(row)) - bounds[row]
    value = np.full(len(row), size, np.uint64)
    for k in range(size):
        # A shorter row is one shingle of all its words.
        there = first + k < before[row + 1]
        value = np.where(there, words.mix(value * SECOND + hashed[np.minimum(first + k, len(hashed) - 1)]), value)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        value[a:b].sort()
    fresh = np.ones(len(row), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[fresh], words.offsets_of(np.bincount(row[fresh], minlength=len(counts)))


def signatures_of(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Low bits of the smallest value of each of the hash functions, a row per set."""
    out = np.full((len(offsets) - 1, POSITIONS), 0xFFFFFFFF, np.uint32)
    low = (value >> np.uint64(16)).astype(np.uint32)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SHINGLES_AT_ONCE, "right")) - 1)
        part, at = low[offsets[i] : offsets[j]], offsets[i:j] - offsets[i]
        full = np.diff(offsets[i : j + 1]) > 0
        if len(part):
            at = at[full]
            for k in range(POSITIONS):
                out[i:j][full, k] = np.minimum.reduceat((part ^ MASKS[k]) * FACTORS[k], at)
        i = j
    return (out >> np.uint32(4)).astype(np.uint16)


def sketches_of(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The parity sketch of each set, a row of longs per set."""
    bits, rows = SKETCH * 64, len(offsets) - 1
    out = np.empty((rows, SKETCH), np.int64)
    for i in range(0, rows, 256):
        j = min(rows, i + 256)
        row = words.owners(offsets[i : j + 1] - offsets[i])
        place = (value[offsets[i] : offsets[j]] >> np.uint64(20)) & np.uint64(bits - 1)
        count = np.bincount(row * bits + place.astype(np.int64), minlength=(j - i) * bits)
        out[i:j] = np.packbits((count & 1).astype(bool).reshape(j - i, bits), axis=1).view(np.int64)
    return out


def keys_of(signature: np.ndarray) -> np.ndarray:
    """One hashed key for every chunk and choice of left-out places."""
    wide = signature.astype(np.uint64)
    size = POSITIONS // CHUNKS
    out = []
    for chunk in range(CHUNKS):
        for left in combinations(range(size), ERRORS):
            key = np.full(len(wide), chunk * 1000 + sum((p + 1) * 10**i for i, p in enumerate(left)), np.uint64)
            for p in (p for p in range(size) if p not in left):
                key = words.mix(key * SECOND + wide[:, chunk * size + p] + np.uint64(1))
            out.append(key)
    return np.stack(out, axis=1)


SETS = "doc_id long, n_shingles long, digest binary, signature binary, sketch array<long>"


def sets(docs: DataFrame, size: int) -> DataFrame:
    """Per document the set's size, its 128-bit digest, its signature and its sketch."""

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in words.text_blocks(batch, "text"):
                value, bounds = shingles_of(data, offsets, size)
                counts = np.diff(bounds)
                digest = np.zeros((j - i, 2), np.uint64)
                full = counts > 0
                if full.any():
                    at = bounds[:-1][full]
                    digest[full, 0] = np.add.reduceat(words.mix(value + np.uint64(7)), at)
                    digest[full, 1] = np.add.reduceat(words.mix(value * SECOND), at)
                signature = signatures_of(value, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        pa.array(counts),
                        words.binary(digest.view(np.uint8).ravel(), np.arange(j - i + 1) * 16),
                        words.binary(signature.view(np.uint8).ravel(), np.arange(j - i + 1) * 2 * POSITIONS),
                        words.longs(sketches_of(value, bounds).ravel(), np.arange(j - i + 1) * SKETCH),
                    ],
                    ["doc_id", "n_shingles", "digest", "signature", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SETS)


def _keys(classes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            column = batch.column("signature")
            if not len(column):
                continue
            signature = np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, POSITIONS)
            keys = keys_of(signature)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(batch.column("rep").to_numpy(), keys.shape[1])),
                    pa.array(keys.ravel().view(np.int64)),
                ],
                ["rep", "key"],
            )

    return classes.select("rep", "signature").mapInArrow(run, "rep long, key long")


def _possible(x: str, y: str, percent: int) -> Column:
    """Whether sizes and sketches allow the two sets (columns ``n`` and ``sketch``) to be similar."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = reduce(
        Column.__add__, [F.bit_count(F.col(f"{x}.sketch")[i].bitwiseXOR(F.col(f"{y}.sketch")[i])) for i in range(SKETCH)]
    )
    # J >= p/100 means that at most (100 - p) / (100 + p) of all items are in one set only.
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * apart <= (100 - percent) * (n + m))


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs that their sizes and sketches do not rule out."""
    known = F.struct("n", "sketch")
    left = classes.select(F.col("rep").alias("a"), known.alias("x"))
    right = classes.select(F.col("rep").alias("b"), known.alias("y"))
    return pairs.join(left, "a").join(right, "b").where(_possible("x", "y", percent)).select("a", "b")


def _full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i, j, data, offsets in words.text_blocks(batch, "text"):
                value, bounds = shingles_of(data, offsets, size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), words.longs(value.view(np.int64), bounds)], ["rep", "items"]
                )

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = text.join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
    return chosen.mapInArrow(run, "rep long, items array<long>")


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets overlap enough."""
    left = full.select(F.col("rep").alias("a"), F.col("items").alias("x"))
    right = full.select(F.col("rep").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(100 * both >= percent * (F.size("x") + F.size("y") - both))
        .select("a", "b")
    )


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``.

    Documents with equal sets are one class, so thousands of copies are one
    member of the search. In every key the members are first compared with one
    member, then, where they are not yet in one component, with another one
    drawn for the key; what still lies in different components of a key is
    listed pair by pair, so that no pair that shares a key goes untested. Pairs are
    ruled out by sizes and sketches, which is free of error, before full sets are
    compared.
    """
    with Scratch(docs.sparkSession, "minhash") as scratch:
        known = scratch.store(sets(docs, size), "sets")
        usable = known.where("doc_id is not null and n_shingles > 0")
        classes = scratch.store(
            usable.groupBy("digest").agg(
                F.min("doc_id").alias("rep"),
                F.first("signature").alias("signature"),
                F.first("n_shingles").alias("n"),
                F.first("sketch").alias("sketch"),
            ),
            "classes",
        )
        # Aggregates joined back, not windows: a key of very many classes can be split.
        keys = _keys(classes)
        bounds = keys.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
        bounds = scratch.store(bounds.select("key", "low"), "bounds")
        shared = scratch.store(join_per_key(keys, bounds, ["key"]), "keys")
        full = scratch.store(_full_sets(docs, shared.select("rep").distinct(), size), "full")
        own = scratch.store(usable.select("doc_id", "digest").join(classes.select("digest", "rep"), "digest").select("doc_id", "rep"), "own")
        documents = scratch.store(own.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")), "documents")
        # Rows that share a doc_id are one document, whatever their texts.
        several = documents.where("low < high")
        linked = []
        if not several.isEmpty():
            twins = join_per_key(own, several, ["doc_id"]).where("low < rep").select(F.col("low").alias("a"), F.col("rep").alias("b"))
            linked.append(scratch.store(twins.distinct(), "twins"))
        tested = None
        pairs = shared.where("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct()
        for turn in range(PIVOT_ROUNDS + 1):
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = scratch.store(pairs, f"pairs{turn}")
            links = scratch.store(_confirmed(_near(pairs, classes, percent), full, percent), f"links{turn}")
            linked.append(links)
            # Early turns only have to leave out most of what is linked: one round of labels will do. The labels
            # before the list of pairs are final, and those after it the same if it brought no new link.
            if turn < PIVOT_ROUNDS or not links.isEmpty():
                rounds = 1 if turn < PIVOT_ROUNDS - 1 else None
                component = components(reduce(DataFrame.union, linked), scratch, f"components{turn}", rounds=rounds)
            if turn == PIVOT_ROUNDS:
                break
            tested = pairs if tested is None else tested.union(pairs)
            placed = shared.join(component.withColumnRenamed("node", "rep"), "rep", "left").select(
                "key", "rep", F.coalesce("component", "rep").alias("component")
            )
            placed = scratch.store(placed, f"placed{turn}")
            draw = F.struct(F.xxhash64("rep", "key", F.lit(turn)).alias("draw"), "rep", "component")
            of_key = placed.groupBy("key").agg(F.min(draw).alias("pivot"), F.min("component").alias("low"), F.max("component").alias("high"))
            of_key = scratch.store(of_key.where("low < high").select("key", "pivot"), f"pivots{turn}")
            apart = join_per_key(placed, of_key, ["key"])
            if turn < PIVOT_ROUNDS - 1:
                pairs = (
                    apart.where("component <> pivot.component")
                    .select(F.least("rep", "pivot.rep").alias("a"), F.greatest("rep", "pivot.rep").alias("b"))
                    .distinct()
                )
            else:
                sketched = apart.drop("pivot").join(classes.select("rep", F.struct("n", "sketch").alias("x")), "rep")
                other = sketched.select("key", F.col("rep").alias("other"), F.col("component").alias("beside"), F.col("x").alias("y"))
                pairs = (
                    sketched.join(other, "key")
                    .where((F.col("component") < F.col("beside")) & _possible("x", "y", percent))
                    .select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b"))
                    .distinct()
                )
            shared = apart.select("key", "rep")
        # A class is named by its smallest document, so that a component of classes is named by its smallest document too.
        found = documents.join(component.withColumnRenamed("node", "low"), "low", "left").select("doc_id", F.coalesce("component", "low").alias("component"))
        return scratch.keep(
            known.join(found, "doc_id", "left")
            .withColumn("component_id", F.coalesce("component", "doc_id"))
            .select("doc_id", "n_shingles", "component_id", (F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).alias("kept"))
        )
