"""Whitened embeddings: leading components by Chebyshev-filtered subspace iteration.

Entries become whole numbers, so that counts, sums and deviations are exact. The
covariance is never formed. A block of directions Q is refined by passes over
the rows: every pass adds up Xc'(Xc Q), with Xc centred before multiplying, in
each task and then over the tasks; only a matrix of the block's size reaches the
driver. A Chebyshev recurrence of such passes damps the part of the spectrum
between its estimated lower end and the block's smallest Ritz value; QR and a
Rayleigh-Ritz step follow, until the residual of every wanted pair certifies it.
A Lanczos column rides along in each pass and bounds the spectrum from below. A
block that makes no progress is widened, at the end to all dimensions, where the
Rayleigh-Ritz step alone is exact. In every round its last direction is drawn
anew, so that one missed at the start comes in.

Defined results: rows without a vector, and vectors that are empty or hold a
NULL, non-finite or very large entry (``LARGEST`` or more), are dropped. If
lengths differ, those of the most frequent length (of several, the longest) are
taken. Repeated rows and rows without ``vec_id`` count as they stand. Components
without variance are left out, so equal vectors or an empty table give an empty
result. A deviation beyond a long is NULL. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epifold.sources.storage import Scratch

COMPONENTS = 8
SCALE = 1024
SHIFT = 100_000
LARGEST = 2.0**36
#: Directions in the block per wanted component.
BLOCK = 3
DEGREE = 10
#: Residuals, as a share of the largest eigenvalue: certified, and good enough at the floor of rounding.
CERTIFIED = 1e-14
FLOOR = 1e-11
#: Eigenvalues below this share of the largest one count as none.
NOTHING = 1e-12
ROUNDS = 60


@dataclass(frozen=True)
class Whitening:
    """Count and exact sums of the fit list; eigenvalues, unit vectors (columns) and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """Nearest whole numbers to the means and n times what is left."""
        whole = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        return np.array(whole, np.int64), np.array([s - self.n * w for s, w in zip(self.sums, whole)], np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): the remaining rows, entries as whole numbers."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)) & (F.size("v") > 0)
    whole = F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + F.lit(SHIFT).cast("long"))
    return rows.where(F.coalesce(good, F.lit(False))).select("vec_id", whole.alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """The entries (at, value) that the tasks sent, added up by place."""
    out = np.zeros(size)
    for r in parts.groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r.at] = r.value
    return out


class Rows:
    """The fit list: passes over it return matrices of a fixed size."""

    def __init__(self, rows: DataFrame, n: int, sums: list[int]):
        self.rows, self.n = rows, n
        self.whole, rest = Whitening(n, sums, np.zeros(0), np.zeros((0, 0)), 0.0).centre()
        self.rest = rest / n
        self.passes = 0

    def _added(self, size: int, per_batch) -> np.ndarray:
        whole, rest = self.whole, self.rest
        self.passes += 1

        def run(batches):
            total = np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    total += per_batch((_matrix(batch) - whole) - rest)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["at", "value"])

        return _summed(self.rows.mapInArrow(run, "at int, value double"), size) / self.n

    def times(self, block: np.ndarray) -> tuple[np.ndarray, float]:
        """The covariance times a block of columns, and its trace."""
        size = block.size

        def products(x):
            return np.append((x.T @ (x @ block)).ravel(), np.einsum("ij,ij->", x, x))

        out = self._added(size + 1, products)
        return out[:size].reshape(block.shape), float(out[size])

    def covariance(self, block: np.ndarray) -> np.ndarray:
        """Covariance of the rows projected on the columns, centred before multiplying."""
        k = block.shape[1]
        mean = self._added(k, lambda x: (x @ block).sum(axis=0))

        def products(x):
            y = x @ block - mean
            return (y.T @ y).ravel()

        return self._added(k * k, products).reshape(k, k)


class Lanczos:
    """A vector carried along in the passes; tells how far down the spectrum reaches."""

    def __init__(self, start: np.ndarray):
        self.basis = [start / np.linalg.norm(start)]
        self.diagonal: list[float] = []
        self.beside: list[float] = []

    @property
    def column(self) -> np.ndarray:
        return self.basis[-1]

    def step(self, product: np.ndarray) -> None:
        self.diagonal.append(float(self.column @ product))
        for q in self.basis * 2:
            product = product - (q @ product) * q
        length = float(np.linalg.norm(product))
        if length <= NOTHING * abs(self.diagonal[0]) or len(self.basis) == len(product):
            # The space is used up: the column stays, its steps add nothing.
            self.step = lambda product: None
            length = 0.0
        else:
            self.basis.append(product / length)
        self.beside.append(length)

    def lowest(self) -> float:
        """A lower bound for nearly all of the spectrum; 0 at the least."""
        t = np.diag(self.diagonal) + np.diag(self.beside[:-1], 1) + np.diag(self.beside[:-1], -1)
        values, vectors = np.linalg.eigh(t)
        return max(0.0, values[0] - 2 * self.beside[-1] * abs(vectors[-1, 0]))


def _filtered(rows: Rows, lanczos: Lanczos, x: np.ndarray, vx: np.ndarray, low: float, high: float, top: float) -> np.ndarray:
    """The Chebyshev polynomial of the covariance times ``x``, damping values from ``low`` to ``high``."""
    centre, half = (high + low) / 2, (high - low) / 2
    first = sigma = half / (top - centre)
    before, now = x, (vx - centre * x) * (first / half)
    for _ in range(DEGREE - 1):
        product = rows.times(np.column_stack([now, lanczos.column]))[0]
        lanczos.step(product[:, -1])
        after = 1 / (2 / first - sigma)
        before, now = now, 2 * (product[:, :-1] - centre * now) * (after / half) - sigma * after * before
        sigma = after
    return now


def leading(rows: Rows, components: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest eigenvalues, their unit vectors and the trace."""
    d = len(rows.whole)
    rng = np.random.default_rng(seed)
    size = min(d, BLOCK * components)
    q = np.linalg.qr(rng.normal(size=(d, size)))[0]
    lanczos = Lanczos(rng.normal(size=d))
    last = np.inf
    for _ in range(ROUNDS):
        product, trace = rows.times(np.column_stack([q, lanczos.column]))
        lanczos.step(product[:, -1])
        inner = q.T @ product[:, :-1]
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        x, vx = q @ turn, product[:, :-1] @ turn
        if trace <= 0 or values[0] <= 0:
            return np.zeros(0), np.zeros((d, 0)), 0.0
        wanted = min(components, d)
        off = np.linalg.norm(vx[:, :wanted] - x[:, :wanted] * values[:wanted], axis=0).max() / values[0]
        stuck = off > last / 4
        if size == d or off <= CERTIFIED or (stuck and off <= FLOOR):
            break
        last = off
        low, high = min(lanczos.lowest(), values[-1] * 0.999), values[-1]
        if high - low <= NOTHING * values[0]:
            y = np.column_stack([x, rng.normal(size=(d, min(d - size, size)))])
        else:
            y = _filtered(rows, lanczos, x, vx, low, high, values[0])
            y /= np.linalg.norm(y, axis=0)
            y[:, -1] = rng.normal(size=d)
            if stuck:
                y = np.column_stack([y, rng.normal(size=(d, min(d - size, size)))])
                last = np.inf
        q = np.linalg.qr(y)[0]
        size = q.shape[1]
    else:
        raise RuntimeError(f"components not certified after {ROUNDS} rounds: residual {off:.1e}")
    real = values[:wanted] > NOTHING * values[0]
    vectors = x[:, :wanted][:, real]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values[:wanted][real], vectors * sign, trace


def _counted(rows: DataFrame) -> tuple[int, list[int]]:
    """Rows and exact sums per dimension."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                at = np.arange(-1, x.shape[1], dtype=np.int32)
                total = np.concatenate([[len(x)], x.sum(axis=0)])
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total)], ["at", "value"])

    sums = rows.mapInArrow(run, "at int, value long").groupBy("at").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value"))
    found = sorted((r.at, int(r.value)) for r in sums.collect())
    return found[0][1], [s for _, s in found[1:]]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitening, int, float] | None:
    """The components, the vectors' length and the largest error of the whitened covariance; None without variance."""
    with Scratch(vectors.sparkSession, "whitening") as scratch:
        stored = scratch.store(usable(vectors), "rows")
        sizes = stored.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        if sizes is None:
            return None
        rows = stored.where(F.size("x") == sizes.d).select("x")
        n, sums = _counted(rows)
        passes = Rows(rows, n, sums)
        values, found, trace = leading(passes, components)
        if not len(values):
            return None
        error = np.abs(passes.covariance(found / np.sqrt(values)) - np.eye(len(values))).max()
        return Whitening(n, sums, values, found, trace), sizes.d, float(error)


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _deviations(model: Whitening, y: np.ndarray) -> list:
    """The exact sum of (n*x - S)^2 per row, where y is x less the whole centre; None beyond a long."""
    _, rest = model.centre()
    n, d = model.n, y.shape[1]
    largest = int(np.abs(y).max(initial=0))
    if largest * max(largest, int(np.abs(rest).max())) * d >= 2**62:
        y, rest = y.astype(object), rest.astype(object)
    squares, mixed = (y * y).sum(axis=1).tolist(), (y @ rest).tolist()
    fixed = sum(int(r) ** 2 for r in rest)
    exact = (n * n * s - 2 * n * m + fixed for s, m in zip(squares, mixed))
    return [v if v < 2**63 else None for v in exact]


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per remaining vector and component: ``RESULT``."""
    model = fit(vectors, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    model, d, error = model
    whole, rest = model.centre()
    shift, onto = rest / model.n, model.vectors / np.sqrt(model.values)
    k = len(model.values)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _matrix(batch) - whole
            rows = len(y)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, model.n)),
                    pa.array(_deviations(model, y), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(((y - shift) @ onto).ravel()),
                    pa.array(np.tile(model.values / model.trace, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return usable(vectors).where(F.size("x") == d).mapInArrow(run, RESULT)
