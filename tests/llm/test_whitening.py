import numpy as np
import pytest

from tidegrid.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(rng, n, d, spread=None):
    spread = np.linspace(2, 0.4, d) if spread is None else spread
    return [(i, (rng.normal(size=d) * spread + 3).astype(np.float32).tolist(), 0) for i in range(n)]


def run(spark, tmp_path, rows, name="a"):
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(tmp_path / name / "embeddings.parquet"))
    return whitening.op13_embedding_whitening(spark, str(tmp_path / name)).toPandas()


def brute(rows, k=32):
    """Eigenvectors of the centred covariance, in one piece."""
    x = np.array([[np.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v, _ in rows])
    sums = [sum(int(v) for v in column) for column in x.T]
    n = len(x)
    c = np.array([[(n * int(v) - s) / n for v, s in zip(row, sums, strict=True)] for row in x])
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return c @ u / np.sqrt(e), e, np.trace(c.T @ c / n), [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]


@pytest.mark.parametrize("n,d", [(400, 64), (300, 12), (50, 1)])
def test_whitened_rows_equal_brute_force(spark, tmp_path, n, d):
    rows = table(np.random.default_rng(d), n, d)
    got = run(spark, tmp_path, rows)
    z, e, trace, deviation = brute(rows)
    assert len(got) == n * min(d, 32) and set(got.n) == {n} and got.identity_error.max() < 1e-10
    by = got.sort_values(["vec_id", "component"])
    mine = by.whitened.to_numpy().reshape(n, -1)
    assert mine == pytest.approx(z * np.sign((mine * z).sum(axis=0)), abs=1e-8)
    assert by.deviation.to_numpy().reshape(n, -1)[:, 0].tolist() == deviation
    assert by.explained.to_numpy()[: len(e)] == pytest.approx(e / trace, rel=1e-10)
    assert by.component.tolist() == list(range(1, min(d, 32) + 1)) * n


def test_rows_that_take_no_part_and_repeats(spark, tmp_path):
    rows = table(np.random.default_rng(1), 60, 4)
    rows += [rows[3], rows[3], (None, rows[7][1], None)]
    odd = [(900, None, 1), (901, [1.0, None, 1.0, 1.0], 1), (902, [float("nan")] * 4, 1), (903, [1.0, float("-inf"), 1.0, 1.0], 1), (904, [1.0] * 3, 1), (905, [], 1)]
    got = run(spark, tmp_path, rows + odd)
    assert len(got) == 4 * len(rows) and set(got.n) == {len(rows)} and got.vec_id.isna().sum() == 4 and (got.vec_id == 3).sum() == 12
    assert not set(got.vec_id.dropna()) & {900, 901, 902, 903, 904, 905}


def test_no_rows_one_row_and_no_variance(spark, tmp_path):
    assert len(run(spark, tmp_path, [], "none")) == 0
    assert len(run(spark, tmp_path, [(1, None, 0)], "null")) == 0
    got = run(spark, tmp_path, [(1, [1.0, 2.0], 0)], "one")
    assert len(got) == 2 and got.whitened.isna().all() and got.deviation.tolist() == [0, 0] and got.identity_error.isna().all()
    flat = [(i, [float(i), 5.0, -2.0 * i], 0) for i in range(20)]  # one direction only
    got = run(spark, tmp_path, flat, "flat")
    assert got[got.component == 1].whitened.std(ddof=0) == pytest.approx(1) and got[got.component > 1].whitened.isna().all() and got.identity_error.max() < 1e-9


def test_subspace_iteration_is_certified_without_the_whole_space():
    rng = np.random.default_rng(2)
    basis = np.linalg.qr(rng.normal(size=(120, 120)))[0]
    e = np.concatenate([np.linspace(50, 20, 6), np.linspace(5, 1, 114)])
    v = basis * e @ basis.T
    passes = []
    values, vectors, trace, residual = whitening.subspace(lambda q: (passes.append(q.shape[1]), (v @ q, float(np.trace(v))))[1], 120, 6, 12)
    assert max(passes) < 120 and len(passes) > 3 and residual.max() <= whitening.TOLERANCE * 50
    assert values == pytest.approx(e[:6], rel=1e-12) and np.abs((vectors * basis[:, :6]).sum(axis=0)) == pytest.approx(np.ones(6))


def test_a_block_that_converges_slowly_is_doubled_up_to_the_whole_space():
    e = np.linspace(2, 1, 40)
    passes = []
    values, vectors, _, _ = whitening.subspace(lambda q: (passes.append(q.shape[1]), (e[:, None] * q, float(e.sum())))[1], 40, 4, 5)
    assert passes[-1] > 5 and len(passes) < 60 and values == pytest.approx(e[:4], rel=1e-11) and np.abs(np.diag(vectors)) == pytest.approx(np.ones(4))


def test_huge_deviations_are_exact_or_null():
    how = whitening.Lattice(2, 64.0, 0, 3, np.zeros(2, np.int64), [0, 0])
    assert whitening.deviations(np.array([[1 << 40, 0], [1 << 20, 3]]), how) == [None, 9 * ((1 << 40) + 9)]


def test_a_large_shift_costs_no_digit(spark):
    df = spark.createDataFrame(table(np.random.default_rng(9), 200, 6), SCHEMA)
    near, far = (whitening.fit(df, "embedding", k=3, shift=shift) for shift in (0, 10**15))
    assert far.variances == pytest.approx(near.variances, rel=1e-13) and np.abs(far.components) == pytest.approx(np.abs(near.components), abs=1e-11)
