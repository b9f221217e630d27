"""Remove every byte that a long string covers which starts anywhere else too.

1. Each window of ``length`` bytes is named by its smallest hashed string of
   ``gram`` bytes (its anchor). Equal windows have equal anchors, and the windows
   of a text that share an anchor lie in a row: a fragment.
2. Fragments whose anchor occurs once are dropped before any text is moved.
3. Equal fragments, told by digests, are one class; a class of two or more
   repeats as a whole. Where an anchor has several classes, the bytes of one
   fragment of each are cut out and meet in one block, where
   ``bwt.repeated_starts`` finds their repeats.
4. An anchor with very many different classes is not met in one task: its range
   of window offsets is cut in ``CUTS`` parts, each named by the bytes that all
   windows of the part share, until groups are small or windows single.
5. Runs of repeated windows go back to the documents and become spans.

Defined results: a NULL text is empty; rows are judged as they stand, so a text
that occurs twice, under one ``doc_id`` or two, is a repeat of itself; rows with
a NULL ``doc_id`` take part like others. Other columns are ignored, an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epifold.llm import words
from epifold.llm.bwt import repeated_starts
from epifold.sources.storage import Scratch

LENGTH = 400
GRAM = 64
#: Different fragments of one anchor that one block takes.
MANY = 2000
CUTS = 4
BLOCK = 1 << 19
STEP = 1 << 16
#: Codec of the larger tables between.
CODEC = "zstd"
INDEX_BITS = np.uint64(18)
SENTINEL = -(2**63)


def windows_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Runs of windows that share an anchor: row, first window, windows, anchor's place, anchor's hash."""
    n = len(data)
    sizes = np.diff(offsets)
    valid = np.zeros(n + 1, np.int8)
    full = sizes >= length
    valid[offsets[:-1][full]] += 1
    valid[offsets[1:][full] - length + 1] -= 1
    valid = np.cumsum(valid[:n], dtype=np.int8).astype(bool)
    width = length - gram + 1
    parts = []
    for a in range(0, max(0, n - length + 1), STEP):
        m = min(STEP, n - length + 1 - a)
        inside = valid[a : a + m]
        if not inside.any():
            continue
        grams = m + width - 1
        up, down = words.powers(grams + gram)
        total = np.zeros(grams + gram, np.uint64)
        np.cumsum(words.BYTE_CODE[data[a : a + grams + gram - 1]] * up[: grams + gram - 1], out=total[1:])
        hashed = words.mix((total[gram:] - total[:grams]) * down[:grams])
        low = (hashed >> INDEX_BITS << INDEX_BITS) | np.arange(grams, dtype=np.uint64)
        rows = -(-grams // width)
        padded = np.full((rows + 1) * width, np.uint64(2**64 - 1))
        padded[:grams] = low
        cells = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(cells, axis=1).ravel()
        behind = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:m], ahead[width - 1 : width - 1 + m]) & np.uint64((1 << 18) - 1)
        place = least.astype(np.int64)
        begin = inside.copy()
        begin[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
        starts = np.flatnonzero(begin)
        stop = inside.copy()
        stop[:-1] &= (place[1:] != place[:-1]) | ~inside[1:]
        ends = np.flatnonzero(stop) + 1
        at = place[starts]
        parts.append((starts + a, ends - starts, at + a, hashed[at]))
    if not parts:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty
    start, count, place, key = (np.concatenate(x) for x in zip(*parts))
    row = np.searchsorted(offsets, start, "right") - 1
    return row, start - offsets[row], count, place - offsets[row], key.view(np.int64)


def _anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i, j, data, offsets in words.text_blocks(batch, "text"):
                row, start, count, place, key = windows_of(data, offsets, length, gram)
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("k1").slice(i, j - i).take(pick),
                        batch.column("k2").slice(i, j - i).take(pick),
                        pa.array(key),
                        pa.array(start),
                        pa.array(count),
                        pa.array(place),
                    ],
                    ["k1", "k2", "anchor", "start", "count", "place"],
                )

    return texts.mapInArrow(run, "k1 long, k2 long, anchor long, start long, count long, place long")


FRAGMENT = "anchor long, digest binary, k1 long, k2 long, start long, count long, place long"
PIECE = "key long, id binary, piece binary, place long, `from` long, `to` long"


def _hits(batch: pa.RecordBatch, length: int):
    """Bytes of the texts; rows, columns, first bytes and ends of the fragments in their lists of ``hits``."""
    data, offsets = words.column(batch, "text")
    lists = batch.column("hits")
    row = words.owners(np.asarray(lists.offsets) - lists.offsets[0].as_py())
    hits = lists.flatten()
    first = offsets[row] + hits.field("start").to_numpy()
    return data.tobytes(), row, hits, first, first + hits.field("count").to_numpy() + length - 1


def _fragments(texts: DataFrame, length: int) -> DataFrame:
    """The fragments of texts that carry their list of ``hits``, by digest; places count from their starts."""

    def run(batches):
        for batch in batches:
            raw, row, hits, first, last = _hits(batch, length)
            held, pick = memoryview(raw), pa.array(row)
            digests = [hashlib.md5(held[x:y]).digest() for x, y in zip(first.tolist(), last.tolist())]
            start = hits.field("start").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    hits.field("anchor"),
                    pa.array(digests, pa.binary()),
                    batch.column("k1").take(pick),
                    batch.column("k2").take(pick),
                    hits.field("start"),
                    hits.field("count"),
                    pa.array(hits.field("place").to_numpy() - start),
                ],
                ["anchor", "digest", "k1", "k2", "start", "count", "place"],
            )

    return texts.mapInArrow(run, FRAGMENT)


def _pieces(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """The bytes of fragments, cut out of texts that carry their list of ``hits``; any window may still repeat."""

    def run(batches):
        for batch in batches:
            raw, _, hits, first, last = _hits(batch, length)
            for a in range(0, len(first), 2000):
                b = min(len(first), a + 2000)
                pieces = [raw[x:y] for x, y in zip(first[a:b].tolist(), last[a:b].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        hits.field("anchor")[a:b],
                        hits.field("digest")[a:b],
                        pa.array(pieces, pa.binary()),
                        hits.field("place")[a:b],
                        pa.array(np.zeros(b - a, np.int64)),
                        pa.array(np.full(b - a, length - gram + 1, np.int64)),
                    ],
                    ["key", "id", "piece", "place", "from", "to"],
                )

    return texts.mapInArrow(run, PIECE)


def _repeats(groups: DataFrame, length: int) -> DataFrame:
    """Runs of repeated windows of pieces that share a ``key``; a key is never split between blocks."""

    def solve(ids, pieces):
        data = np.frombuffer(b"".join(pieces), np.uint8)
        offsets = words.offsets_of(np.array([len(p) for p in pieces]))
        starts, ends, _ = words.spans_of(repeated_starts(data, offsets, length), offsets)
        row = np.searchsorted(offsets, starts, "right") - 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array([ids[r] for r in row.tolist()], pa.binary()),
                pa.array(starts - offsets[row]),
                pa.array(ends - offsets[row]),
            ],
            ["id", "low", "high"],
        )

    def run(batches):
        ids, pieces, size, last = [], [], 0, None
        for batch in batches:
            for key, id_, piece in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "piece"))):
                if size >= BLOCK and key != last:
                    yield solve(ids, pieces)
                    ids, pieces, size = [], [], 0
                ids.append(id_)
                pieces.append(piece)
                size, last = size + len(piece), key
        if pieces:
            yield solve(ids, pieces)

    ordered = groups.select("key", "id", "piece").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, "id binary, low long, high long")


def _cut(groups: DataFrame, length: int) -> DataFrame:
    """Pieces of pieces, by parts of the range of window offsets.

    ``place`` is the anchor's place in the piece and [``from``, ``to``) the range
    of distances between window and anchor that the group still has. The new
    ``key`` names the bytes that all windows of a part share, ``id`` the piece
    under its key, ``shift`` its first window in the ``parent`` piece.
    """
    names = ("key", "id", "parent", "shift", "piece", "place", "from", "to")
    schema = pa.schema([(c, pa.binary() if c in ("id", "parent", "piece") else pa.int64()) for c in names])

    def number(value):
        return value.to_bytes(8, "little", signed=True)

    def run(batches):
        for batch in batches:
            out = []
            for key, parent, piece, place, low, high in zip(
                *(batch.column(c).to_pylist() for c in ("key", "id", "piece", "place", "from", "to"))
            ):
                width = -(-(high - low) // CUTS)
                for a in range(low, high, width):
                    b = min(high, a + width)
                    # A window at distance d starts at place - d; the piece has those from 0 on.
                    first, stop = max(0, place - b + 1), min(len(piece) - length, place - a) + 1
                    if first >= stop:
                        continue
                    core = piece[place - a : place - b + 1 + length]
                    name = hashlib.blake2b(core, digest_size=8, key=number(key) + number(a)).digest()
                    part = piece[first : stop - 1 + length]
                    id_ = hashlib.blake2b(part, digest_size=16, key=name + number(place - first)).digest()
                    out.append((int.from_bytes(name, "little", signed=True), id_, parent, first, part, place - first, a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*out), schema.types)] if out else [pa.array([], t) for t in schema.types],
                schema=schema,
            )

    return groups.select("key", "id", "piece", "place", "from", "to").mapInArrow(
        run,
        "key long, id binary, parent binary, shift long, piece binary, place long, `from` long, `to` long",
    )


def _spans(texts: DataFrame, length: int) -> DataFrame:
    """Merge runs of window starts into spans of bytes and cut them out."""

    def run(batches):
        for batch in batches:
            data, offsets = words.column(batch, "text")
            lists = batch.column("runs")
            bounds = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            low, high = (lists.flatten().field(c).to_numpy() for c in ("low", "high"))
            removed, spans, hashes, kept_texts = [], [], [], []
            for r in range(batch.num_rows):
                text = data[offsets[r] : offsets[r + 1]]
                change = np.zeros(len(text) + 1, np.int32)
                np.add.at(change, low[bounds[r] : bounds[r + 1]], 1)
                np.add.at(change, high[bounds[r] : bounds[r + 1]] + length - 1, -1)
                gone = np.cumsum(change[:-1]) > 0
                rest = text[~gone].tobytes()
                removed.append(int(gone.sum()))
                spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                hashes.append(hashlib.sha256(rest).hexdigest())
                kept_texts.append(rest.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k1"),
                    batch.column("k2"),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.int64()),
                    pa.array(hashes, pa.string()),
                    pa.array(kept_texts, pa.string()),
                ],
                ["k1", "k2", "n_removed", "n_spans", "kept_sha256", "kept_text"],
            )

    return texts.mapInArrow(
        run, "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with its text filled and the keys of its rows: the id and a hash of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("text", text).withColumns(
        {"k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(SENTINEL)), "k2": F.xxhash64("text")}
    )


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, many: int = MANY) -> DataFrame:
    """(k1, k2, n_removed, n_spans, kept_sha256, kept_text) of the texts that lose something.

    ``kept_text`` is what remains, without the bytes of a character that was cut
    in two. The keys are those of ``_keyed``; equal rows are one row here.
    """
    if not 8 <= gram <= length:
        raise ValueError("gram must be at least 8 and at most the length")
    keyed = _keyed(docs.select("doc_id", "text"))
    with Scratch(docs.sparkSession, "suffix") as scratch:
        long = keyed.where(F.octet_length("text") >= length).select("k1", "k2", "text")
        anchors = scratch.store(_anchors(long, length, gram), "anchors")
        # Stored, so that the join deals both sides anew and a hot anchor can be split.
        repeated = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
        repeated = scratch.store(repeated, "repeated")
        # Rows that are equal in all have their hits twice here, and so find each other.
        hits = (
            anchors.join(repeated, "anchor", "left_semi")
            .groupBy("k1", "k2")
            .agg(F.collect_list(F.struct("anchor", "start", "count", "place")).alias("hits"))
        )
        copies = keyed.select("k1", "k2", "text").join(hits, ["k1", "k2"]).groupBy("k1", "k2")
        found = scratch.store(copies.agg(F.first("text").alias("text"), F.first("hits").alias("hits")), "found", CODEC)
        scratch.drop("anchors")
        fragments = scratch.store(_fragments(found, length), "fragments", CODEC)
        runs = _all_runs(scratch, found.select("k1", "k2", "text"), fragments, length, gram, many)
        spans = (
            fragments.select("k1", "k2", F.col("digest").alias("id"), "start")
            .join(runs, "id")
            .select("k1", "k2", F.struct((F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high")).alias("run"))
            .groupBy("k1", "k2")
            .agg(F.collect_list("run").alias("runs"))
        )
        return scratch.keep(_spans(found.select("k1", "k2", "text").join(spans, ["k1", "k2"]), length))


def _shared(groups: DataFrame) -> DataFrame:
    """(key, n) of the keys with more than one row."""
    return groups.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _all_runs(scratch: Scratch, texts: DataFrame, fragments: DataFrame, length: int, gram: int, many: int) -> DataFrame:
    """(id, low, high): runs of repeated windows of the fragments, by the fragment's digest."""
    # The first values of a class are those of one row.
    classes = scratch.store(
        fragments.groupBy("anchor", "digest").agg(
            F.count(F.lit(1)).alias("weight"), *(F.first(c).alias(c) for c in ("k1", "k2", "start", "count", "place"))
        ),
        "classes",
        CODEC,
    )
    zero = F.lit(0).cast("long")
    found = [classes.where("weight > 1").select(F.col("digest").alias("id"), zero.alias("low"), F.col("count").alias("high"))]
    cuts: list[DataFrame] = []
    sizes = scratch.store(_shared(classes.select(F.col("anchor").alias("key"))), "sizes0")
    # Only of anchors with several classes bytes are moved, once for each class.
    hits = (
        classes.join(sizes.select(F.col("key").alias("anchor")), "anchor", "left_semi")
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("anchor", "digest", "start", "count", "place")).alias("hits"))
    )
    groups = scratch.store(_pieces(texts.join(hits, ["k1", "k2"]), length, gram), "groups0", CODEC)
    while True:
        turn = len(cuts)
        few = groups.join(sizes.where(F.col("n") <= many).select("key"), "key", "left_semi")
        found[-1] = found[-1].union(scratch.store(_repeats(few, length), f"runs{turn}"))
        large = sizes.where(F.col("n") > many).select("key")
        if large.isEmpty():
            break
        cuts.append(scratch.store(_cut(groups.join(large, "key", "left_semi"), length), f"pieces{turn}"))
        groups = scratch.store(
            cuts[-1].groupBy("key", "id").agg(
                F.count(F.lit(1)).alias("weight"), *(F.first(c).alias(c) for c in ("piece", "place", "from", "to"))
            ),
            f"groups{turn + 1}",
        )
        sizes = scratch.store(_shared(groups), f"sizes{turn + 1}")
        windows = F.octet_length("piece").cast("long") - length + 1
        found.append(groups.where("weight > 1").select("id", zero.alias("low"), windows.alias("high")))
    scratch.drop("groups0")
    runs = found.pop()
    while cuts:
        # Runs of a part are runs of the piece that it was cut from.
        back = cuts.pop().select("id", "parent", "shift").join(runs, "id")
        moved = [(F.col(c) + F.col("shift")).alias(c) for c in ("low", "high")]
        runs = found.pop().union(back.select(F.col("parent").alias("id"), *moved))
    return runs


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, many: int = MANY) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of ``docs``."""
    cut = repeats(docs, length, gram, many).drop("kept_text")
    base = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select(
        "k1", "k2", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole")
    )
    zero = F.lit(0).cast("long")
    return base.join(cut, ["k1", "k2"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, many: int = MANY) -> DataFrame:
    """``docs`` with the remaining text in place of ``text``."""
    cut = repeats(docs, length, gram, many).select("k1", "k2", "kept_text")
    own = docs.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)), "doc_id", F.col("text").alias("text"))
    joined = _keyed(own).join(cut, ["k1", "k2"], "left")
    return joined.select(
        *(
            F.coalesce("kept_text", f"_{i}").alias(c) if c == "text" else F.col(f"_{i}").alias(c)
            for i, c in enumerate(docs.columns)
        )
    )
