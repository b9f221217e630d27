"""Language of texts by hyperdimensional profiles.

Every letter has a random vector of -1 and 1. A run of three letters is bound
into one vector: the first letter's vector shifted by two places, times the
second's shifted by one, times the third's. A document is the sum of the vectors
of its runs, a language the sum of its documents' vectors scaled to one length;
a document gets the language with the largest cosine.

Letters are code points that are letters of any script, folded to lower case; a
gap between words is one letter more, so that word ends count. Vectors are drawn
from the code point, so every task has the same ones.

Defined results: a NULL text or one without a letter is ``und`` with score 0.
Documents with a NULL language, or NULL ``doc_id``, teach nothing. Without any
teaching document every text is ``und``. Ties go to the first language in order
of code points.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epifold.llm import words

DIMENSIONS = 512
RUN = 3
GAP = 0
UNKNOWN = "und"
#: Bytes of text whose runs are counted together.
BLOCK = 1 << 18
#: Documents summed at once.
ROWS = 64


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept for the test."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Letters:
    """Lower-case letters by code point, and their vectors."""

    def __init__(self):
        self.table = np.full(0x110000, -1, np.int32)
        self.table[: 0x250] = [self._fold(c) for c in range(0x250)]
        self.filled = np.zeros(0x110000, bool)
        self.filled[:0x250] = True
        self.vectors: dict[int, np.ndarray] = {}

    @staticmethod
    def _fold(code: int) -> int:
        lower = chr(code).lower()
        return ord(lower[0]) if unicodedata.category(lower[0])[0] == "L" else GAP

    def fold(self, codes: np.ndarray) -> np.ndarray:
        missing = np.unique(codes[~self.filled[codes]])
        for code in missing.tolist():
            self.table[code] = self._fold(code)
        self.filled[missing] = True
        return self.table[codes]

    def vector(self, code: int) -> np.ndarray:
        if code not in self.vectors:
            bits = np.random.Generator(np.random.PCG64(code + 1)).integers(0, 2, DIMENSIONS, dtype=np.int8)
            self.vectors[code] = (2 * bits - 1).astype(np.int8)
        return self.vectors[code]

    def bound(self, runs: np.ndarray) -> np.ndarray:
        """Vectors of runs, a row for each; a run is the code points of its letters."""
        used, place = np.unique(runs, return_inverse=True)
        place = place.reshape(runs.shape)
        base = np.stack([self.vector(c) for c in used.tolist()])
        out = np.ones((len(runs), DIMENSIONS), np.int8)
        for k in range(RUN):
            out *= np.roll(base, RUN - 1 - k, axis=1)[place[:, k]]
        return out.astype(np.float32)


def runs_of(letters: Letters, data: np.ndarray, offsets: np.ndarray):
    """Row, run of letters and count of each distinct run per text, in order of the rows."""
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    bounds = lead[offsets]
    if bounds[-1] != len(codes):
        raise ValueError("text is not UTF-8")
    folded = letters.fold(codes)
    row = words.owners(bounds)
    # Several gaps in a row are one, and every text starts and ends with one.
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != GAP) | (folded[:-1] != GAP) | (row[1:] != row[:-1])
    folded, row = folded[keep], row[keep]
    starts = np.searchsorted(row, np.arange(len(offsets)))
    folded, row = np.insert(folded, starts, GAP), np.insert(row, starts, np.append(np.arange(len(offsets) - 1), len(offsets) - 1))
    a, b, c = folded[:-2].astype(np.int64), folded[1:-1].astype(np.int64), folded[2:].astype(np.int64)
    # The gap put before the next text is the end of this one; a run holds a letter in its middle.
    inside = (row[:-2] == row[1:-1]) & (b != GAP)
    key = (a[inside] << 42) | (b[inside] << 21) | c[inside]
    return row[:-2][inside], key


def _parts(data: np.ndarray, offsets: np.ndarray):
    """Blocks as (first row, bytes, row offsets); a longer text comes in parts cut at white space.

    A run never reaches over white space but by the gap that stands for it, so
    the parts' vectors add up to the text's.
    """
    for i, j in words.blocks(offsets, BLOCK):
        start, stop = int(offsets[i]), int(offsets[j])
        if j > i + 1 or stop - start <= 2 * BLOCK:
            yield i, data[start:stop], offsets[i : j + 1] - start
            continue
        while start < stop:
            cut = min(stop, start + BLOCK)
            while cut < stop and not words.IS_SEPARATOR[data[cut]]:
                near = np.flatnonzero(words.IS_SEPARATOR[data[cut : cut + BLOCK]])
                cut = cut + int(near[0]) if len(near) else min(stop, cut + BLOCK)
            yield i, data[start:cut], np.array([0, cut - start])
            start = cut


def profiles(letters: Letters, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The vector of each text; zero without letters."""
    out = np.zeros((len(offsets) - 1, DIMENSIONS), np.float32)
    for i, part, bounds in _parts(data, offsets):
        row, key = runs_of(letters, part, bounds)
        if not len(key):
            continue
        used, place = np.unique(key, return_inverse=True)
        mask = (1 << 21) - 1
        bound = letters.bound(np.stack([used >> 42, (used >> 21) & mask, used & mask], axis=1))
        rows = len(bounds) - 1
        cuts = np.searchsorted(row, np.arange(rows + 1))
        for r in range(0, rows, ROWS):
            s = min(rows, r + ROWS)
            x, y = cuts[r], cuts[s]
            if x == y:
                continue
            count = np.bincount((row[x:y] - r) * len(used) + place[x:y], minlength=(s - r) * len(used))
            out[i + r : i + s] += count.reshape(s - r, len(used)).astype(np.float32) @ bound
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length == 0, 1, length)


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their vectors, from all documents that are not held out."""

    def run(batches):
        letters, total = Letters(), {}
        for batch in batches:
            tags = np.array(batch.column("lang").to_pylist(), object)
            for i, j, data, offsets in words.text_blocks(batch, "text"):
                # Whole numbers add up to the same in any order.
                unit = np.rint(_unit(profiles(letters, data, offsets)) * 1e6).astype(np.int64)
                for tag in set(tags[i:j]):
                    total[tag] = total.get(tag, 0) + unit[tags[i:j] == tag].sum(0)
        for tag, vector in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([tag] * DIMENSIONS), pa.array(np.arange(DIMENSIONS)), pa.array(vector)],
                ["lang", "place", "value"],
            )

    teaching = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    summed = (
        teaching.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
        .mapInArrow(run, "lang string, place long, value long")
        .groupBy("lang", "place")
        .agg(F.sum("value").alias("value"))
    )
    # One vector per language: its size follows the languages, not the documents.
    rows = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("cells")).collect()
    rows = [r for r in rows if any(c.value for c in r.cells)]
    rows.sort(key=lambda r: r.lang)
    names = [r.lang for r in rows]
    return names, _unit(np.array([[c.value for c in r.cells] for r in rows], np.float64).reshape(len(names), DIMENSIONS))


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score) per row; only the text enters the result."""

    def run(batches):
        letters = Letters()
        known = np.array([*names, UNKNOWN], object)
        for batch in batches:
            for i, j, data, offsets in words.text_blocks(batch, "text"):
                vectors = profiles(letters, data, offsets)
                empty = ~vectors.any(axis=1)
                if names:
                    cosine = _unit(vectors.astype(np.float64)) @ prototypes.T
                    best, value = cosine.argmax(1), np.clip(cosine.max(1), 0, 1)
                else:
                    best, value = np.zeros(j - i, int), np.zeros(j - i)
                best, value = np.where(empty | (not names), len(names), best), np.where(empty, 0.0, value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(known[best], pa.string()), pa.array(value)],
                    ["doc_id", "lang_pred", "score"],
                )

    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return text.mapInArrow(run, "doc_id long, lang_pred string, score double")
