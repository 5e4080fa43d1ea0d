"""Whitening against numpy's eigenvectors; inertia counts; exact sums; close, repeated and missing eigenvalues; odd rows."""

import numpy as np
import pytest

from dewfall.llm import queries, whitening
from tests.llm.test_queries import SF, rows

SCHEMA = "vec_id long, embedding array<double>, n string, dim string"


def test_counts_are_numbers_of_eigenvalues():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 30):
        a = rng.standard_normal((n, n))
        a = a + a.T
        a[rng.random((n, n)) < 0.4] = 0
        a = np.triu(a) + np.triu(a, 1).T  # zero pivots
        values = np.linalg.eigvalsh(a)
        for shift in [*(values[:-1] + values[1:]) / 2, values[0] - 1, values[-1] + 1, 0.1234]:
            assert whitening.above(a, shift) == (values > shift).sum()


@pytest.mark.parametrize("values", [[9, 5, 5, 5, 2, 1], [4, 4 - 1e-9, 4 - 2e-9, 1, 0, 0], [1] * 6, [0] * 6, [1e12, 1e3, 1e-3, 0, 0, 0], [3, 2, 1, 0.5, 0.25, 0.125]])
def test_leading_eigenvalues(values):
    q, _ = np.linalg.qr(np.random.default_rng(5).standard_normal((6, 6)))
    matrix = q @ np.diag(np.array(values, "f8")) @ q.T
    matrix = (matrix + matrix.T) / 2
    got, axes = whitening.leading(matrix, 4)
    want = [v for v in sorted(values, reverse=True)[:4] if v > 1e-12 * max(values)]
    assert got == pytest.approx(want, rel=1e-9, abs=1e-12 * max(values))
    assert axes.T @ axes == pytest.approx(np.eye(len(want)), abs=1e-12)
    assert matrix @ axes == pytest.approx(axes * got, abs=1e-12 * max(max(values), 1))


def expected(vectors, k=32):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    z = np.array((n * x - s) / n, "f8")
    v = np.array((n * x - s).T @ (n * x - s) / n**3, "f8")
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, deviation, z @ u / np.sqrt(e), e / np.trace(v)


def test_equals_numpy_over_the_table(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in rows("embeddings")}
    n, deviation, whitened, explained = expected(list(vectors.values()))
    got = queries.op11_embedding_whitening(spark, SF).collect()
    assert len(got) == 32 * n
    at = {i: k for k, i in enumerate(vectors)}
    w = np.zeros((n, 32))
    for r in got:
        w[at[r.vec_id], r.component - 1] = r.whitened
        assert (r.n, r.deviation) == (n, deviation[at[r.vec_id]])
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-10)
        assert r.identity_error < 1e-10
    sign = np.sign((w * whitened).sum(axis=0))
    assert w * sign == pytest.approx(whitened, abs=1e-8)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(8)
    good = [(k, rng.normal(0, 3, 4).tolist(), "x", "y") for k in range(30)]
    other = [(100 + k, rng.normal(0, 3, 2).tolist(), None, None) for k in range(5)]
    odd = [(200, None, "x", "y"), (201, [], "x", "y"), (202, [1.0, None, 1.0, 1.0], "x", "y"), (203, [nan] * 4, "x", "y"), (204, [1.0, 2.0, 3.0, inf], "x", "y"), (205, [1e300] * 4, "x", "y")]
    df = spark.createDataFrame([*good, good[3], (None, good[4][1], None, None), *other, *odd], SCHEMA).repartition(5)
    fits = whitening.fit(df)
    got = whitening.components(whitening.whiten(df, fits), fits).collect()
    assert {d: f.n for d, f in fits.items()} == {4: 32, 2: 5}
    assert sum(r.vec_id == 3 for r in got) == 8 and sum(r.vec_id is None for r in got) == 4
    assert not any((r.vec_id or 0) >= 200 for r in got)
    assert all(r.identity_error < 1e-10 for r in got)
    n, deviation, _, _ = expected([v for _, v, _, _ in other])
    assert {r.vec_id: r.deviation for r in got if r.n == 5} == dict(zip(range(100, 105), deviation))


def test_large_values_stay_exact(spark):
    rng = np.random.default_rng(2)
    vectors = [(1e10 + rng.normal(0, 1e6, 3)).tolist() for _ in range(40)] + [(1e15 * rng.normal(0, 1, 3)).tolist() for _ in range(3)]
    df = spark.createDataFrame([(k, v, None, None) for k, v in enumerate(vectors)], SCHEMA)
    fits = whitening.fit(df)
    got = {r.vec_id: r.deviation for r in whitening.whiten(df, fits).collect()}
    _, deviation, _, explained = expected(vectors)
    assert got == {k: d if d < 1 << 63 else None for k, d in enumerate(deviation)}
    assert (fits[3].values / fits[3].trace).tolist() == pytest.approx(explained.tolist(), rel=1e-9)


def test_no_variance_and_no_rows(spark):
    same = spark.createDataFrame([(k, [1.0, 2.0], None, None) for k in range(3)], SCHEMA)
    assert whitening.components(whitening.whiten(same, fits := whitening.fit(same)), fits).collect() == []
    empty = same.limit(0)
    assert whitening.fit(empty) == {} and whitening.components(whitening.whiten(empty, {}), {}).collect() == []
