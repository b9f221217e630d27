"""Quality of texts by histogram gradient-boosted trees over document statistics.

Tasks turn a text into the ``STATISTICS``. Trees are grown level by level: the
values of a statistic are sorted into ``BINS`` bins at the quantiles of the
training rows, the slopes and curvatures of the logistic loss are added up per
node, statistic and bin, and the best cut of the running sums splits a node. A
forest is held as flat arrays in heap order, so that all rows of a block walk
down all trees together.

Bound, as a parameter: at most ``sample`` labelled documents teach, drawn by a
hash of their ids; each gives the trees one row of statistics. All documents are
scored.

Defined results: a NULL text is empty; an empty text is scored by its statistics,
which are all 0. Labels that are NULL, not 0 or 1, or contradict each other do
not teach. Where the judged documents are all of one kind, every score is the
share of label 1; without any, it is 0.5. Of rows with one ``doc_id`` one
teaches; rows with a NULL ``doc_id`` are scored, never learnt from. Repeated rows
are scored alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epifold.llm import quality, words

SAMPLE = 50_000
BINS = 64
DEPTH = 4
TREES = 80
RATE = 0.15
#: Weight of the penalty on leaf values, and least curvature in a child.
PENALTY = 1.0
LEAST = 2.0
#: Rows that walk down the trees together, and bytes whose kinds are counted together.
AT_ONCE = 4096
CHUNK = 1 << 20

KINDS = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "digits": "0123456789",
    "stops": ".?",
    "commas": ",;:",
    "calls": "!",
    "bars": "|",
    "signs": "#*$%&@^~_+=",
    "brackets": "<>()[]{}",
    "slashes": "/\\",
    "quotes": "\"'`",
    "dashes": "-",
    "blanks": " \t\r\x0b\x0c",
    "lines": "\n",
}
KIND = np.full(256, len(KINDS), np.uint8)
for _k, _signs in enumerate(KINDS.values()):
    KIND[[ord(c) for c in _signs]] = _k
#: Bytes of code points beyond ASCII have a kind of their own; what is left over is the last one.
KIND[128:] = len(KINDS) + 1

SHAPE = ("log_bytes", "log_words", "word_length", "longest_word", "symbol_share", "line_share", "repeat_share", "distinct_share", "words_per_line", "capital_words")
STATISTICS = (*SHAPE, *(f"share_{k}" for k in (*KINDS, "others", "beyond_ascii")))


def held_out(doc_id: Column) -> Column:
    """Whether a document's labels are kept for the test."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def statistics_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ``STATISTICS`` of each text, a row per text."""
    rows, kinds = len(offsets) - 1, len(KINDS) + 2
    size = np.diff(offsets)
    kind = KIND[data]
    by_kind = np.zeros(rows * kinds, np.int64)
    for a in range(0, len(data), CHUNK):
        # The bytes that each row has in this chunk.
        inside = np.diff(np.clip(offsets, a, a + CHUNK))
        row = np.repeat(np.arange(rows) * kinds, inside)
        by_kind += np.bincount(row + kind[a : a + CHUNK], minlength=rows * kinds)
    by_kind = by_kind.reshape(rows, kinds)
    n_words, chars, symbols, dup_lines, repeats = quality.counts_of(data, offsets)
    starts, ends, before = words.words_of(data, offsets)
    word_row = words.owners(before)
    _, later = quality._repeated(word_row, words.hash_spans(data, starts, ends))
    distinct = n_words - np.bincount(word_row[later], minlength=rows)
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, word_row, ends - starts)
    capital = np.bincount(word_row[kind[starts] == 0], minlength=rows)
    n_lines = by_kind[:, list(KINDS).index("lines")] + 1
    per_word, per_byte = np.maximum(n_words, 1), np.maximum(size, 1)
    shape = [
        np.log1p(size),
        np.log1p(n_words),
        chars / per_word,
        np.log1p(longest),
        symbols / per_word,
        dup_lines / n_lines,
        repeats / per_word,
        distinct / per_word,
        n_words / n_lines,
        capital / per_word,
    ]
    return np.column_stack([*shape, by_kind / per_byte[:, None]])


@dataclass(frozen=True)
class Forest:
    """Trees as arrays in heap order: node i has the children 2i + 1 and 2i + 2.

    A row goes right where its value is above ``cut``; a node without a split
    sends all rows left. ``leaf`` holds the values of the lowest level.
    """

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row."""
        out = np.empty(len(x))
        trees, inner = self.feature.shape
        base = np.arange(trees) * inner
        for i in range(0, len(x), AT_ONCE):
            part = x[i : i + AT_ONCE]
            at = np.arange(len(part))[:, None]
            node = np.zeros((len(part), trees), np.int64)
            for _ in range(int(np.log2(inner + 1))):
                place = base + node
                node = 2 * node + 1 + (part[at, self.feature.ravel()[place]] > self.cut.ravel()[place])
            total = self.leaf.ravel()[np.arange(trees) * (inner + 1) + node - inner].sum(axis=1) + self.start
            out[i : i + AT_ONCE] = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
        return out


def cuts_of(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Ascending cuts per column at the quantiles of its values; at most ``bins`` - 1."""
    share = np.arange(1, bins) / bins
    return [np.unique(np.quantile(column, share, method="lower")) for column in x.T]


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """A forest fitted to rows ``x`` with labels ``y``, 0 or 1."""
    n, features = x.shape
    cuts = cuts_of(x)
    binned = np.column_stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T)])
    place = binned + np.arange(features) * BINS
    inner, width = 2**depth - 1, features * BINS
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    total = np.full(n, np.log(share / (1 - share)))
    out = Forest(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), float(total[0]) if n else 0.0)
    for tree in range(trees):
        p = 1 / (1 + np.exp(-total))
        slope, curve = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            nodes, first = 2**level, 2**level - 1
            at = (place + (node * width)[:, None]).ravel()
            sums = [
                np.cumsum(np.bincount(at, np.repeat(v, features), nodes * width).reshape(nodes, features, BINS), axis=2)
                for v in (slope, curve)
            ]
            (left, weight), (all_, whole) = sums, [s[:, :, -1:] for s in sums]

            def gain(g, h):
                return g * g / (h + PENALTY)

            better = gain(left, weight) + gain(all_ - left, whole - weight) - gain(all_, whole)
            better[(weight < LEAST) | (whole - weight < LEAST)] = 0.0
            best = better.reshape(nodes, -1).argmax(axis=1)
            real = better.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
            feature, at_bin = np.where(real, best // BINS, 0), np.where(real, best % BINS, BINS)
            out.feature[tree, first : first + nodes] = feature
            out.cut[tree, first : first + nodes] = [cuts[f][b] if r else np.inf for f, b, r in zip(feature, at_bin, real)]
            node = 2 * node + (binned[np.arange(n), feature[node]] > at_bin[node])
        g, h = (np.bincount(node, v, inner + 1) for v in (slope, curve))
        out.leaf[tree] = -rate * g / (h + PENALTY)
        total += out.leaf[tree][node]
    return out


def _statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the list of ``statistics``."""

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in words.text_blocks(batch, "text"):
                x = statistics_of(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in keep), lists], [*keep, "statistics"])

    fields = [*(docs.schema[c] for c in keep), T.StructField("statistics", T.ArrayType(T.DoubleType()))]
    return docs.select(*keep, "text").mapInArrow(run, T.StructType(fields))


def constant(share: float) -> Forest:
    """A forest that gives every row the same score."""
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Forest(np.zeros((1, 1), np.int64), np.full((1, 1), np.inf), np.zeros((1, 2)), float(np.log(share / (1 - share))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, trees: int = TREES) -> Forest:
    """A forest fitted to the drawn documents that have a label."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    judged = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    drawn = judged.where("low = high").select("doc_id", F.col("high").alias("label"), F.xxhash64("doc_id").alias("draw"))
    drawn = drawn.orderBy("draw").limit(sample).select("doc_id", "label")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most ``sample`` ids, whatever the size of the labels.
    known = _statistics(rows.join(F.broadcast(drawn), "doc_id"), ["doc_id", "label"])
    known = known.groupBy("doc_id", "label").agg(F.min("statistics").alias("statistics")).orderBy("doc_id").toArrow()
    y = known.column("label").to_numpy().astype(float)
    if len(y) == 0 or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    x = known.column("statistics").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    return grow(x, y, trees)


def scored(docs: DataFrame, forest: Forest, name: str = "score") -> DataFrame:
    """``docs`` with a score; only the text enters it. A column of that name is replaced."""
    keep = [c for c in docs.columns if c != name]

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in words.text_blocks(batch, "text"):
                value = forest.scores(statistics_of(data, offsets))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in keep), pa.array(value)], [*keep, name])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.DoubleType())])
    return docs.select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(run, schema)
