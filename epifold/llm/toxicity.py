"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents teach the classifier; all other text counts as
unlabelled. With the class prior p, the risk of calling a text clean is
estimated as U - p * P, the mean loss on unlabelled text less the share of the
positives in it. Where this estimate falls below zero the fit has begun to learn
the sample by heart, and the step is taken back.

A text is the set of its hashed words and word beginnings. Which of them count
is decided by the counts of every one of them over all training documents.

Bounds, as parameters: ``positives`` confirmed documents teach at most (drawn by
hash), the ``features`` of the highest gain are kept, and ``sample`` unlabelled documents are expected in the fit (drawn by hash).

Defined results: a NULL or empty text gets the score of a text without any
feature. Without confirmed examples every score is 0. Labels that are NULL or
contradict each other do not confirm. Rows with a NULL ``doc_id`` are scored,
never learnt from. Repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epifold.llm import words

POSITIVES = 50_000
FEATURES = 4096
SAMPLE = 40_000
SUPPORT = 4
PURITY = 0.4
PREFIXES = (4, 5)
TABLE_BITS = 20
#: Features that a task counts together.
AT_ONCE = 1 << 19

IN_TOKEN = np.zeros(256, bool)
IN_TOKEN[128:] = True
for _first, _last in ("09", "az", "AZ"):
    IN_TOKEN[ord(_first) : ord(_last) + 1] = True


def held_out(doc_id: Column) -> Column:
    """Whether a document's labels are kept for the test."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word and word beginning, repeats included."""
    data = words.LOWER[data]
    starts, ends, before = words.spans_of(IN_TOKEN[data], offsets)
    row = words.owners(before)
    found = [words.hash_spans(data, starts, ends)]
    for size in PREFIXES:
        found.append(words.mix(words.hash_spans(data, starts, np.minimum(ends, starts + size)) + np.uint64(size)))
    return np.concatenate([row] * len(found)), np.concatenate(found)


class Lookup:
    """Places of hashes in a small sorted list."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.mask = np.uint64((1 << TABLE_BITS) - 1)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[hashes & self.mask] = True

    def distinct(self, row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and place of each listed hash, once per row."""
        maybe = np.flatnonzero(self.table[value & self.mask])
        row, value = row[maybe], value[maybe]
        place = np.searchsorted(self.hashes, value)
        hit = self.hashes[np.minimum(place, len(self.hashes) - 1)] == value
        both = np.unique(row[hit] * np.int64(len(self.hashes)) + place[hit])
        return both // len(self.hashes), both % len(self.hashes)


def _counted(docs: DataFrame) -> DataFrame:
    """(feature, n, everywhere): in how many positive documents and in how many of all a feature occurs."""

    def counts(seen, positive):
        value, everywhere = np.unique(np.concatenate(seen), return_counts=True)
        known, times = np.unique(np.concatenate(positive), return_counts=True)
        n = np.zeros(len(value), np.int64)
        n[np.searchsorted(value, known)] = times
        return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n), pa.array(everywhere)], ["feature", "n", "everywhere"])

    def run(batches):
        seen, positive, size = [], [], 0
        for batch in batches:
            flags = batch.column("positive").to_numpy(zero_copy_only=False).astype(bool)
            for i, j, data, offsets in words.text_blocks(batch, "text"):
                row, value = features_of(data, offsets)
                order = np.lexsort((value, row))
                row, value = row[order], value[order]
                fresh = np.ones(len(row), bool)
                fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
                seen.append(value[fresh])
                positive.append(value[fresh & flags[i:j][row]])
                size += len(seen[-1])
                if size > AT_ONCE:
                    yield counts(seen, positive)
                    seen, positive, size = [], [], 0
        if seen:
            yield counts(seen, positive)

    found = docs.select("positive", "text").mapInArrow(run, "feature long, n long, everywhere long")
    return found.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("everywhere").alias("everywhere"))


def _listed(docs: DataFrame, hashes: np.ndarray) -> DataFrame:
    """(positive, places) per document."""

    def run(batches):
        lookup = Lookup(hashes)
        for batch in batches:
            for i, j, data, offsets in words.text_blocks(batch, "text"):
                row, place = lookup.distinct(*features_of(data, offsets))
                bounds = words.offsets_of(np.bincount(row, minlength=j - i))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("positive").slice(i, j - i), words.longs(place, bounds)], ["positive", "places"]
                )

    return docs.select("positive", "text").mapInArrow(run, "positive boolean, places array<long>")


def fit(positive: list[list[int]], unlabelled: list[list[int]], size: int, prior: float, steps: int = 800, rate: float = 0.1, sparse: float = 3e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer under the non-negative risk.

    ``sparse`` draws every weight towards zero by a fixed amount, so that words
    which only come with the telling ones are left out.
    """

    def flat(rows):
        lengths = [len(r) for r in rows]
        return np.repeat(np.arange(len(rows)), lengths), np.array([x for r in rows for x in r], np.int64), len(rows)

    parts = [flat(positive), flat(unlabelled)]
    weight, bias = np.zeros(size), 0.0
    moment, square = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        score = [np.bincount(row, weight[col], n) + bias for row, col, n in parts]
        soft = [1 / (1 + np.exp(-s)) for s in score]
        loss_clean = [np.logaddexp(0, s).mean() for s in score]
        # d/ds of the loss of calling a text toxic is soft - 1, of calling it clean soft.
        clean_risk = loss_clean[1] - prior * loss_clean[0]
        if clean_risk >= 0:
            pull = [(prior * (soft[0] - 1) - prior * soft[0]) / parts[0][2], soft[1] / parts[1][2]]
        else:
            pull = [prior * soft[0] / parts[0][2], -soft[1] / parts[1][2]]
        gradient = np.append(sparse * np.tanh(20 * weight), 0.0)
        for (row, col, n), g in zip(parts, pull):
            gradient[:size] += np.bincount(col, g[row], size)
            gradient[size] += g.sum()
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        change = rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weight -= change[:size]
        bias -= change[size]
    return weight, bias


def train(
    docs: DataFrame,
    labels: DataFrame,
    positives: int = POSITIVES,
    features: int = FEATURES,
    sample: int = SAMPLE,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature hashes in ascending order, their weights, and the bias."""
    none = np.zeros(1, np.uint64), np.zeros(1), -np.inf
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    judged = usable.groupBy("doc_id").agg(F.min("toxic").alias("low"), F.max("toxic").alias("high")).where("low = high")
    share = judged.agg(F.avg((F.col("high") == 1).cast("double"))).first()[0]
    if not share:
        return none
    order = F.xxhash64("doc_id")
    toxic = judged.where("high = 1").select("doc_id", order.alias("draw")).orderBy("draw").limit(positives).select("doc_id")
    flagged = (
        docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
        .where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        # At most ``positives`` ids, whatever the size of the labels.
        .join(F.broadcast(toxic.withColumn("positive", F.lit(True))), "doc_id", "left")
        .withColumn("positive", F.coalesce("positive", F.lit(False)))
    )
    confirmed = flagged.where("positive")
    rows, known = flagged.agg(F.count(F.lit(1)), F.count(F.when(F.col("positive"), 1))).first()
    if not known:
        return none
    # The share of toxic texts among those with the feature, for one deviation fewer confirmed ones.
    purity = share * ((F.col("n") - F.sqrt("n")) / known) / (F.col("everywhere") / rows)
    pure = _counted(flagged).where(F.col("n") >= SUPPORT).withColumn("purity", purity).where(F.col("purity") >= PURITY)
    gain = pure.select("feature", (F.col("n") * F.log(F.col("purity") / share)).alias("gain")).where("gain > 0")
    top = gain.orderBy(F.desc("gain"), F.col("feature") < 0, "feature").limit(features).toPandas()
    if not len(top):
        return none
    hashes = np.sort(top["feature"].to_numpy().view(np.uint64))
    modulus = 1 << 30
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(modulus)) < int(min(1.0, sample / rows) * modulus)
    positive = [r.places for r in _listed(confirmed, hashes).toLocalIterator()]
    unlabelled = [r.places for r in _listed(flagged.where(drawn), hashes).toLocalIterator()]
    if not positive or not unlabelled:
        return none
    weight, bias = fit(positive, unlabelled, len(hashes), share)
    return hashes, weight, bias


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], name: str = "score") -> DataFrame:
    """``docs`` with a score; only the text enters it. A column of that name is replaced."""
    hashes, weight, bias = model
    keep = [c for c in docs.columns if c != name]

    def run(batches):
        lookup = Lookup(hashes)
        for batch in batches:
            for i, j, data, offsets in words.text_blocks(batch, "text"):
                row, place = lookup.distinct(*features_of(data, offsets))
                total = np.bincount(row, weight[place], j - i) + bias
                value = np.where(np.isneginf(total), 0.0, 1 / (1 + np.exp(-np.clip(total, -500, 500))))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in keep), pa.array(value)], [*keep, name])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.DoubleType())])
    return docs.select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(run, schema)
