"""Quality rules with thresholds learnt per language and source.

Fixed rules reject texts that are very short or repeat themselves. All others
are judged by four measures in whole numbers. For every language, source and
measure a quantile sketch is kept: the counts of logarithmic buckets with
``STEPS`` linear steps each, so that any value is known to one part in
``STEPS``. Sketches merge by adding counts: a group with fewer than
``SMALL_GROUP`` texts takes the merged sketch of its language, or else of all
texts.

A text is rejected where a measure lies beyond its tail quantile by more than
``REACH`` times the distance from the median to that quantile. The ``tail`` is the
percentage that may be expected to hold sound texts only. Where a group is nearly
constant that distance is taken as what one ``event`` (a symbol, a line, a word of
twenty letters) makes in the group's short texts, those at the tenth percentile
of its lengths: it too is learnt, from a sketch of the lengths.

Defined results: a NULL text has no words and fails the fixed rules. NULL
languages and sources are groups of their own. Rows are judged one by one, so
repeated rows are judged alike. Other columns are ignored, an empty table gives
an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epifold.llm import words
from epifold.sources.storage import cut

# The signs that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
STEPS = 32
SMALL_GROUP = 200
REACH = 6
#: Measure: (numerator, factor, tail, event, whether low values are rejected too).
MEASURES = {
    "word_length": ("word_chars", 100, 90, 20, True),
    "symbol_share": ("n_symbols", 1000, 90, 1, False),
    "line_share": ("n_dup_lines", 1000, 95, 1, False),
    "repeat_share": ("n_repeat_words", 1000, 95, 1, False),
}
#: The sketch of lengths, and the percentages at which sketches are read.
LENGTH = "length"
SHORT = 10
LEVELS = sorted({SHORT, 50} | {p for _, _, tail, _, _ in MEASURES.values() for p in (tail, 100 - tail)})
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _repeated(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items that are equal to another of their row, and those that are not the first such."""
    key = words.mix(value + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    any_, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    any_[order[1:][same]] = any_[order[:-1][same]] = True
    later[order[1:][same]] = True
    return any_, later


def counts_of(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The ``COUNTS`` of each text."""
    rows = len(offsets) - 1

    def per_row(flag):
        total = np.zeros(len(flag) + 1, np.int32)
        np.cumsum(flag, out=total[1:])
        return np.diff(total[offsets])

    separator = words.IS_SEPARATOR[data]
    starts, ends, before = words.spans_of(~separator, offsets)
    n_words = np.diff(before)
    chars = per_row(~separator & ((data & 0xC0) != 0x80))
    symbols = per_row(IS_SYMBOL[data])
    line_start, line_end, line_before = words.spans_of(data != 0x0A, offsets)
    within = np.zeros(len(data) + 1, np.int32)
    np.cumsum(~separator, out=within[1:])
    real = within[line_end] > within[line_start]
    line_row = words.owners(line_before)[real]
    _, later = _repeated(line_row, words.hash_spans(data, line_start[real], line_end[real]))
    dup_lines = np.bincount(line_row[later], minlength=rows)
    hashed = words.hash_spans(data, starts, ends)
    bounds = words.offsets_of(np.maximum(n_words - WINDOW + 1, 0))
    row = words.owners(bounds)
    first = before[row] + np.arange(len(row)) - bounds[row]
    value = np.zeros(len(row), np.uint64)
    for k in range(WINDOW):
        value = words.mix(value * np.uint64(0xC2B2AE3D27D4EB4F) + hashed[first + k])
    twice, _ = _repeated(row, value)
    change = np.zeros(len(starts) + 1, np.int32)
    change[first[twice]] += 1
    np.subtract.at(change, first[twice] + WINDOW, 1)
    covered = np.cumsum(change[:-1]) > 0
    repeat = np.diff(np.concatenate([[0], np.cumsum(covered)])[before])
    return [n_words, chars, symbols, dup_lines, repeat]


def counts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source and the ``COUNTS``) per row."""

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in words.text_blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(i, j - i) for c in ("doc_id", "lang", "source")),
                        *(pa.array(x.astype(np.int64)) for x in counts_of(data, offsets)),
                    ],
                    ["doc_id", "lang", "source", *COUNTS],
                )

    text = docs.select(F.col("doc_id").cast("long"), *(F.col(c).cast("string") for c in ("lang", "source", "text")))
    return text.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def bucket(value: Column) -> Column:
    """The lowest value of the bucket that a whole number from 0 on falls in."""
    width = F.greatest(F.length(F.bin(value)) - F.length(F.bin(F.lit(STEPS))), F.lit(0))
    unit = F.pow(F.lit(2.0), width).cast("long")
    return value - F.pmod(value, unit)


def measure(name: str) -> Column:
    """A measure of a row with the counts, as a whole number."""
    if name == LENGTH:
        return F.col("n_words")
    count, factor, *_ = MEASURES[name]
    return F.floor(factor * F.col(count) / F.greatest("n_words", F.lit(1))).cast("long")


def measures() -> Column:
    """An array of (measure, value) for a row with the counts."""
    return F.array(*(F.struct(F.lit(name).alias("measure"), measure(name).alias("value")) for name in (*MEASURES, LENGTH)))


def sketches(known: DataFrame) -> DataFrame:
    """(lang, source, measure, low, n): bucket counts over the rows that pass the fixed rules.

    Counts are taken before the shuffle, so a language or source that holds
    most rows is no heavier than others.
    """
    value = known.where("not base_failed").select("lang", "source", F.explode(measures()).alias("m"))
    return (
        value.select("lang", "source", "m.measure", bucket(F.col("m.value")).alias("low"))
        .groupBy("lang", "source", "measure", "low")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """Sketches added up over all groups with the same keys."""
    return sketch.groupBy(*keys, "measure", "low").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, measure, size, and q<p> for the ``LEVELS``) from the running counts of a sketch."""
    group = Window.partitionBy(*keys, "measure")
    running = sketch.withColumn("until", F.sum("n").over(group.orderBy("low"))).withColumn("size", F.sum("n").over(group))
    return running.groupBy(*keys, "measure").agg(
        F.first("size").alias("size"),
        *(F.min(F.when(100 * F.col("until") >= p * F.col("size"), F.col("low"))).alias(f"q{p}") for p in LEVELS),
    )


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, and a lower and upper bound per measure) for every group."""
    known = ("size", *(f"q{p}" for p in LEVELS))
    own = quantiles(sketch, "lang", "source")
    language = quantiles(merged(sketch, "lang"), "lang").select("lang", "measure", F.struct(*known).alias("by_lang"))
    # One row per measure.
    everywhere = quantiles(merged(sketch)).select("measure", F.struct(*known).alias("by_all"))
    found = (
        own.withColumnRenamed("lang", "l")
        .join(language, (F.col("l").eqNullSafe(F.col("lang"))) & (own["measure"] == language["measure"]))
        .select("l", "source", own["measure"], F.struct(*known).alias("own"), "by_lang")
        .join(everywhere, "measure")
        .select(
            F.col("l").alias("lang"),
            "source",
            "measure",
            F.when(F.col("own.size") >= SMALL_GROUP, F.col("own"))
            .when(F.col("by_lang.size") >= SMALL_GROUP, F.col("by_lang"))
            .otherwise(F.col("by_all"))
            .alias("q"),
        )
    )
    wide = found.groupBy("lang", "source").agg(*(F.max(F.when(F.col("measure") == m, F.col("q"))).alias(m) for m in (*MEASURES, LENGTH)))
    short = F.greatest(F.col(f"{LENGTH}.q{SHORT}"), F.lit(1))
    bounds = []
    for name, (_, factor, tail, event, both) in MEASURES.items():
        least = F.floor(F.lit(factor * event) / short).cast("long")
        high, middle, low = (F.col(f"{name}.q{p}") for p in (tail, 50, 100 - tail))
        bounds.append((high + REACH * F.greatest(high - middle, least)).alias(f"high_{name}"))
        if both:
            bounds.append((low - REACH * F.greatest(middle - low, least)).alias(f"low_{name}"))
    return wide.select("lang", "source", *bounds)


def _limited(docs: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with the counts and their group's bounds, and for each measure whether it rejects a row."""
    known = cut(
        counts(docs).withColumn(
            "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
        )
    )
    limits = thresholds(sketches(known)).select(F.col("lang").alias("l"), F.col("source").alias("s"), "*").drop("lang", "source")
    same = F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))
    outside = {}
    for name, (*_, both) in MEASURES.items():
        beyond = measure(name) > F.col(f"high_{name}")
        if both:
            beyond = beyond | (measure(name) < F.col(f"low_{name}"))
        outside[name] = F.coalesce(~F.col("base_failed") & beyond, F.lit(False))
    return known.join(limits, same, "left"), outside


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, the counts, base_failed, kept) per row of ``docs``."""
    rows, outside = _limited(docs)
    kept = ~F.col("base_failed") & ~reduce(or_, outside.values())
    return rows.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"))


def rejections(docs: DataFrame) -> DataFrame:
    """(lang, source, n, base_failed, and rows rejected by each measure) per group."""
    rows, outside = _limited(docs)
    return rows.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("base_failed").alias("base_failed"),
        *(F.count_if(o).alias(name) for name, o in outside.items()),
        *(F.first(f"high_{name}").alias(f"high_{name}") for name in MEASURES),
    )
