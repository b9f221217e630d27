import numpy as np
import pytest

from epifold.llm import whitening

RNG = np.random.default_rng(12)
SCHEMA = "vec_id long, embedding array<float>, label int, n string, component string, at string, x string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "x", "x", "x") for i, v in rows], SCHEMA).repartition(2)


def floats(v):
    return [float(x) for x in np.float32(v)]


def brute(vectors):
    """Whole entries, count, sums, eigenvalues and unit vectors by a dense solver."""
    x = np.floor(1024 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    c = x - x.sum(axis=0) / len(x)
    values, onto = np.linalg.eigh(c.T @ c / len(x))
    return x, c, values[::-1], onto[:, ::-1]


def compare(got, ids, vectors, components=8, close=1e-6):
    x, c, values, onto = brute(vectors)
    n, sums = len(x), x.sum(axis=0)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(by_id) == sorted(ids) and len(got) == components * len(ids)
    for k in range(components):
        mine = np.array([by_id[i][k + 1].whitened for i in ids])
        true = c @ onto[:, k] / np.sqrt(values[k])
        assert min(np.abs(mine - true).max(), np.abs(mine + true).max()) < close
        assert abs(by_id[ids[0]][k + 1].explained / (values[k] / values.sum()) - 1) < 1e-9
    for i, row in zip(ids, x.tolist()):
        exact = sum((n * a - int(s)) ** 2 for a, s in zip(row, sums))
        assert all((r.n, r.deviation) == (n, exact) for r in by_id[i].values())
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_whole_table_matches_a_dense_solver(spark, sf_dir):
    from epifold.llm.q_whitening import op12_whitening

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    compare(op12_whitening(spark, sf_dir).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_unusable_rows_and_more_dimensions_than_the_block(spark):
    base = RNG.normal(size=(400, 40)) * np.linspace(3, 0.5, 40)
    good = [(i, floats(v)) for i, v in enumerate(base)] + [(0, floats(base[0]))]
    bad = [(900, None), (901, [None] * 40), (902, [float("nan")] * 40), (903, [float("inf")] + [0.0] * 39), (904, []), (905, [1.0, 2.0]), (906, [1e30] * 40)]
    got = whitening.whitened(table(spark, good + bad)).collect()
    assert len(got) == 8 * 401 and {r.n for r in got} == {401}
    x, c, values, onto = brute([v for _, v in good])
    seven = {r.component: r for r in got if r.vec_id == 7}
    for k in range(8):
        assert abs(abs(seven[k + 1].whitened) - abs(c[7] @ onto[:, k] / np.sqrt(values[k]))) < 1e-7


def test_few_directions_no_variance_and_empty(spark):
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(6)] + [(None, [9.0, 18.0, 5.0])]
    got = whitening.whitened(table(spark, line)).collect()
    assert {r.component for r in got} == {1} and len(got) == 7
    assert abs(np.mean([r.whitened**2 for r in got]) - 1) < 1e-9 and all(abs(r.explained - 1) < 1e-9 for r in got)
    assert whitening.whitened(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whitening.whitened(table(spark, [])).collect() == []


class Dense:
    """Passes over rows that lie in memory."""

    def __init__(self, x):
        self.whole, self.x, self.passes = np.zeros(x.shape[1]), x - x.mean(axis=0), 0

    def times(self, block):
        self.passes += 1
        return self.x.T @ (self.x @ block) / len(self.x), float((self.x**2).sum() / len(self.x))


SPECTRA = {
    "sampled": np.ones(90),
    "two levels": np.r_[np.full(40, 5.0), np.ones(50)],
    "steep": np.geomspace(1e4, 1e-2, 90),
    "one close pair": np.r_[9.0, 9.0 - 1e-6, np.linspace(3, 1, 88)],
    "few": np.r_[np.full(5, 2.0), np.zeros(85)],
}


@pytest.mark.parametrize("name", SPECTRA)
def test_flat_and_steep_spectra(name):
    turn = np.linalg.qr(RNG.normal(size=(90, 90)))[0]
    x = (RNG.normal(size=(900, 90)) * np.sqrt(SPECTRA[name])) @ turn
    rows = Dense(x)
    values, vectors, trace = whitening.leading(rows, 8)
    cov = rows.x.T @ rows.x / len(x)
    true = np.linalg.eigvalsh(cov)[::-1]
    real = min(8, int((true > 1e-9 * true[0]).sum()))
    assert len(values) == real and np.abs(values - true[:real]).max() < 1e-9 * true[0]
    assert np.abs(cov @ vectors - vectors * values).max() < 1e-9 * true[0]
    assert np.abs(vectors.T @ vectors - np.eye(real)).max() < 1e-9 and abs(trace / true.sum() - 1) < 1e-9


def test_equal_eigenvalues_in_all_directions():
    rows = Dense(np.concatenate([np.eye(70), -np.eye(70)]))
    values, vectors, _ = whitening.leading(rows, 8)
    assert np.abs(values - 1 / 70).max() < 1e-12 and np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-9


def test_more_equal_leading_values_than_the_block():
    # No gap inside the block: it is widened until the step is exact.
    scale = np.sqrt(np.r_[np.full(50, 4.0), np.linspace(1, 0.5, 40)])
    rows = Dense(np.concatenate([np.diag(scale), -np.diag(scale)]))
    values, vectors, _ = whitening.leading(rows, 8)
    assert np.abs(values - 4 / 90).max() < 1e-12
    cov = np.diag(scale**2) / 90
    assert np.abs(cov @ vectors - vectors * values).max() < 1e-10


def test_deviations_beyond_a_long():
    model = whitening.Whitening(10**9, [3, 10**12], np.zeros(0), np.zeros((2, 0)), 0.0)
    got = whitening._deviations(model, np.array([[0, 0], [1, 0], [10**9, 5]]))
    assert got == [9, (10**9 - 3) ** 2, None]
