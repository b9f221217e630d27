"""Token sequences in training order, as shards of records of one length.

A document's tokens are the ids of a sub-word model; each document is encoded
once and its packed ids are kept in the shared folder until the shards are
written. Without a model the bytes of its UTF-8 text are the tokens.

A document's tokens are cut into sequences. Every sequence has a number from 0
on; a keyed Feistel network over a rectangle of at least as many places permutes
the numbers, and a number that lands outside them is sent through again until it
is inside (cycle-walking). The result is the sequence's slot. Slots are dealt by
range to one task per shard, which sorts and writes them, so record k of shard s
is slot s * ROWS + k, and a reader resumes at any slot by its byte offset. On
the way the records of a block that go to one shard travel together, compressed.

A record is the document's id (8 bytes), the sequence's place in the document
and its tokens' number (4 bytes each, all with the highest byte first), the
tokens padded to ``length``, and a line feed. An id takes two bytes, or four in a
model of 65,536 pieces or more, with the lowest byte first. Files are written by Spark's
committer; their part numbers are the shard numbers.

Numbers follow the partitions of the tokens, which are read twice. Without a
model that is the input: give it as a table, not as the result of a shuffle.
Should the partitions differ between the reads, the job stops.

Defined results: an empty or NULL text has no sequence. Rows without ``doc_id``
are written with the id ``NO_ID``. Repeated rows are written each. Other columns
are ignored. An empty table has no shard.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epifold.llm import pieces, words
from epifold.sources.manifest import hadoop
from epifold.sources.storage import Scratch

LENGTH = 512
ROWS = 32_768
KEY = 0x5EED
ROUNDS = 4
NO_ID = -(2**63)
#: Bytes of this value are no token and fill records.
PAD = 0xFF
HEADER = 16
#: Bytes of tokens whose records are dealt together.
BLOCK = 1 << 22
#: Codec and level of what lies on disk between the input and the shards.
CODEC, LEVEL = "zstd", 9


def permute(numbers: np.ndarray, total: int, key: int = KEY) -> np.ndarray:
    """The slots of the numbers below ``total``: a permutation of them."""
    a = max(1, int(np.ceil(np.sqrt(total))))
    b = max(1, -(-total // a))
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] // np.uint64(b), out[todo] % np.uint64(b)
        for k in range(ROUNDS):
            salt = np.uint64((key * 2654435761 + 2 * k + 1) % 2**64)
            left = (left + words.mix(right + salt) % np.uint64(a)) % np.uint64(a)
            right = (right + words.mix(left + salt + np.uint64(1)) % np.uint64(b)) % np.uint64(b)
        out[todo] = left * np.uint64(b) + right
        todo = todo[out[todo] >= total]
    return out.astype(np.int64)


def _source(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text.alias("text"))


def _records(source: DataFrame, bases: DataFrame, total: int, length: int, rows: int, width: int) -> DataFrame:
    """(shard, n, size, load): slots, heads and tokens of the records of a block that go to one shard, ``size`` bytes of tokens.

    ``bases`` is (part, n, first): the sequences of each partition and those before them.
    """
    span = length * width

    def run(batches):
        codec = pa.Codec(CODEC, compression_level=LEVEL)
        number, stop = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if number is None:
                number = batch.column("first")[0].as_py()
                stop = number + batch.column("n")[0].as_py()
            ids = batch.column("doc_id").to_numpy().astype(np.int64)
            for i, j, data, offsets in words.text_blocks(batch, "tokens", BLOCK):
                counts = -(-np.diff(offsets) // span)
                bounds = words.offsets_of(counts)
                row = words.owners(bounds)
                if not len(row):
                    continue
                place = np.arange(len(row)) - bounds[row]
                start = offsets[row] + place * span
                size = np.minimum(offsets[row + 1] - start, span)
                slots = permute(number + np.arange(len(row)), total)
                number += len(row)
                heads = np.empty((len(row), HEADER), np.uint8)
                heads[:, :8] = ids[i:j][row].astype(">i8").view(np.uint8).reshape(-1, 8)
                heads[:, 8:12] = place.astype(">i4").view(np.uint8).reshape(-1, 4)
                heads[:, 12:] = (size // width).astype(">i4").view(np.uint8).reshape(-1, 4)
                inside = np.arange(span) < size[:, None]
                tokens = np.empty((len(row), span), np.uint8)
                tokens[inside] = data
                shard = slots // rows
                # Neighbours in the input stay neighbours, which helps to compress them.
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.append(True, np.diff(shard[order]) != 0))
                groups = np.split(order, cuts[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard[order[cuts]].astype(np.int32)),
                        pa.array([len(g) for g in groups], pa.int64()),
                        pa.array([int(size[g].sum()) for g in groups], pa.int64()),
                        pa.array([codec.compress(slots[g].tobytes() + heads[g].tobytes() + tokens[g][inside[g]].tobytes(), asbytes=True) for g in groups], pa.binary()),
                    ],
                    ["shard", "n", "size", "load"],
                )
        if number != stop:
            raise RuntimeError("the input's partitions changed between its two reads")

    # One row per partition of the input; rows stay in their partitions.
    numbered = source.withColumn("part", F.spark_partition_id()).join(F.broadcast(bases), "part", "left")
    zero = F.lit(0).cast("long")
    known = numbered.select("doc_id", "tokens", F.coalesce("first", zero).alias("first"), F.coalesce("n", zero).alias("n"))
    return known.mapInArrow(run, "shard int, n long, size long, load binary")


def _in_order(loads: DataFrame, span: int, width: int) -> DataFrame:
    """The records of each partition, which is one shard, by slot, their tokens filled up to ``span`` bytes."""
    size = HEADER + span

    def run(batches):
        codec = pa.Codec(CODEC)
        slots, records = [], []
        for batch in batches:
            for n, filled, load in zip(batch.column("n").to_pylist(), batch.column("size").to_pylist(), batch.column("load")):
                raw = codec.decompress(load.as_py(), n * (8 + HEADER) + filled, asbytes=True)
                slots.append(np.frombuffer(raw, np.int64, n))
                out = np.full((n, size), PAD, np.uint8)
                out[:, :HEADER] = np.frombuffer(raw, np.uint8, n * HEADER, 8 * n).reshape(n, HEADER)
                held = out[:, 12:HEADER].copy().view(">i4") * width
                out[:, HEADER:][np.arange(span) < held] = np.frombuffer(raw, np.uint8, offset=n * (8 + HEADER))
                records.append(out)
        if not slots:
            return
        order, records = np.argsort(np.concatenate(slots)), np.concatenate(records)
        for k in range(0, len(order), 4096):
            some = records[order[k : k + 4096]]
            yield pa.RecordBatch.from_arrays(
                [words.binary(some.ravel(), np.arange(len(some) + 1) * size)], ["record"]
            )

    return loads.mapInArrow(run, "record binary")


def write_shards(docs: DataFrame, path: str, length: int = LENGTH, rows: int = ROWS, model: str | None = None) -> int:
    """Write all sequences of the tokens of ``text`` below the path; their number.

    Tokens are the ids of the model file, or bytes if none is given.
    """
    source = _source(docs)
    if model is None:
        return _write(source.withColumnRenamed("text", "tokens"), path, length, rows, 1)
    width = pieces.id_bytes(model)
    with Scratch(docs.sparkSession, "token-ids") as scratch:
        ids = scratch.store(pieces.encode_ids(source, model, width), "ids", CODEC, LEVEL)
        return _write(ids.withColumnRenamed("ids", "tokens"), path, length, rows, width)


def _write(source: DataFrame, path: str, length: int, rows: int, width: int) -> int:
    """Write the sequences of (doc_id, tokens); a token has ``width`` bytes."""
    n = F.sum(F.ceil(F.octet_length("tokens") / (length * width)).cast("long"))
    per = source.groupBy(F.spark_partition_id().alias("part")).agg(n.alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    with Scratch(source.sparkSession, "sequences") as scratch:
        # One row per partition of the input.
        bases = scratch.store(per.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "bases")
        total = bases.agg(F.sum("n")).first()[0] or 0
        shards = -(-total // rows)
        loads = _records(source, bases, total, length, rows, width)
        if shards:
            loads = loads.repartitionById(shards, "shard")
        _in_order(loads, length * width, width).select(F.col("record").cast("string").alias("value")).write.text(path)
    return total


def _files_from(spark: SparkSession, path: str, shard: int) -> list[str]:
    """The files of the shards from this one on, by their part numbers."""
    target, fs = hadoop(spark, path)
    named = [(re.search(r"part-(\d+)-", f.getPath().getName()), f.getPath().toString()) for f in fs.listStatus(target)]
    return [file for part, file in named if part and int(part[1]) >= shard]


def read_shards(spark: SparkSession, path: str, start: int = 0, length: int = LENGTH, rows: int = ROWS, width: int = 1) -> DataFrame:
    """(slot, doc_id, part, n_tokens, tokens) of all slots from ``start`` on, a token in ``width`` bytes.

    Files of shards before the first wanted one are not opened.
    """
    stride = HEADER + length * width + 1
    wanted = [path] if start < rows else _files_from(spark, path, start // rows)
    if not wanted:
        schema = "slot long, doc_id long, part long, n_tokens long, tokens binary"
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load(wanted).select("path", "content")
    shard = F.regexp_extract("path", r"part-(\d+)-", 1).cast("long")
    first = F.greatest(F.lit(0), F.lit(start) - F.col("shard") * rows)
    count = F.floor(F.octet_length("content") / stride)
    files = files.withColumn("shard", shard).where((F.col("shard") + 1) * rows > start)
    at = F.explode(F.when(count > first, F.sequence(first, count - 1)))
    records = files.select("shard", at.alias("at"), "content").select(
        (F.col("shard") * rows + F.col("at")).alias("slot"),
        F.substring("content", (F.col("at") * stride + 1).cast("int"), F.lit(stride - 1)).alias("record"),
    )

    def number(begin: int, size: int) -> Column:
        return F.conv(F.hex(F.substring("record", begin, size)), 16, -10).cast("long")

    doc_id = number(1, 8)
    n = number(13, 4)
    return records.select(
        "slot",
        F.when(doc_id != NO_ID, doc_id).alias("doc_id"),
        number(9, 4).alias("part"),
        n.alias("n_tokens"),
        F.substring("record", F.lit(HEADER + 1), (n * width).cast("int")).alias("tokens"),
    )
