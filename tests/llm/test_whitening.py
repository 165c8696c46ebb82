"""Whitening against numpy's eigenvalues and exact integer moments."""

from fractions import Fraction

import numpy as np
import pytest

from lexspan.llm import queries, whiten

SCHEMA = "vec_id long, embedding array<float>, key string, x int, n long"


def put(spark, path, vectors):
    rows = [(i, v, "k", 1, 2) for i, v in vectors]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(path / "embeddings.parquet"))
    return str(path)


def brute(vectors, components=32):
    x = [[int(np.floor(64.0 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(dims)]
    deviation = [sum((n * r[k] - s[k]) ** 2 for k in range(dims)) for r in x]
    centred = np.array([[float(r[k] - Fraction(s[k], n)) for k in range(dims)] for r in x])
    v = centred.T @ centred / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    return deviation, centred @ axes[:, :components] / np.sqrt(np.where(e > 1e-9, e, np.nan))[:components], e[:components] / np.trace(v)


@pytest.mark.parametrize("dims,count", [(5, 40), (40, 300), (3, 1), (7, 4)])
def test_query_equals_brute_force(spark, tmp_path, dims, count):
    rng = np.random.default_rng(dims)
    base = (rng.normal(size=(count, dims)) * np.geomspace(40, 0.5, dims)).astype(np.float32)
    kept = [(i, v.tolist()) for i, v in enumerate(base)]
    bad = [(900, None), (901, [None] * dims), (902, [float("nan")] * dims), (903, [float("inf")] + [1.0] * (dims - 1)), (904, [1e30] * dims), (905, [])]
    folder = put(spark, tmp_path, [*kept, *bad])
    rows = queries.op11_whitening(spark, folder).collect()
    k = min(32, dims)
    assert len(rows) == count * k and {r.n for r in rows} == {count}
    deviation, want, explained = brute([v for _, v in kept])
    got = np.full((count, k), np.nan)
    for r in rows:
        assert r.deviation == deviation[r.vec_id]
        assert r.explained == pytest.approx(explained[r.component - 1] if count > 1 else 0, rel=1e-6, abs=1e-12)
        got[r.vec_id, r.component - 1] = np.nan if r.whitened is None else r.whitened
    assert (np.isnan(got) == np.isnan(want)).all()
    real = ~np.isnan(want[0])
    signs = np.sign((got * want)[:, real].sum(axis=0))
    assert np.allclose(got[:, real] * signs, want[:, real], atol=1e-6)
    errors = {r.identity_error for r in rows}
    assert len(errors) == 1 and (errors == {None} if not real.any() else max(errors) < 1e-9)


def test_ties_nulls_and_empty_tables(spark, tmp_path):
    folder = put(spark, tmp_path / "a", [(None, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [2.0, 1.0]), (8, [3.0]), (9, [4.0])])
    rows = queries.op11_whitening(spark, folder).collect()
    assert sorted((r.vec_id or -1, r.component) for r in rows) == [(-1, 1), (-1, 2), (7, 1), (7, 1), (7, 2), (7, 2)]
    assert all((r.whitened is None) == (r.component == 2) for r in rows)  # three points on a line
    none = queries.op11_whitening(spark, put(spark, tmp_path / "b", []))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    far = queries.op11_whitening(spark, put(spark, tmp_path / "c", [(i, [1e14 * i, -1e13 * i * i]) for i in range(5)])).collect()
    assert len(far) == 10 and all(r.identity_error < 1e-9 and r.deviation is None for r in far)


@pytest.mark.parametrize("dims", [1, 2, 7, 64])
def test_jacobi(dims):
    rng = np.random.default_rng(dims)
    b = rng.normal(size=(dims, dims))
    a = b @ b.T
    e, v = whiten.jacobi(a)
    assert np.allclose(e, np.linalg.eigvalsh(a)[::-1]) and np.allclose(v @ np.diag(e) @ v.T, a) and np.allclose(v.T @ v, np.eye(dims))


def test_small_eigenvalues_are_accurate():
    """A graded matrix: the small eigenvalues have no correct digit by a method that is only accurate beside the largest."""
    d = np.geomspace(1, 1e-12, 6)
    s = np.full((6, 6), 0.3) + 0.7 * np.eye(6)
    e, _ = whiten.jacobi(d[:, None] * s * d)
    inverse, _ = whiten.jacobi(np.linalg.inv(s) / d[:, None] / d)
    assert np.allclose(e, 1 / inverse[::-1], rtol=1e-9)


def test_sums_beyond_a_long_are_exact(spark):
    big = 1 << 60
    frame = spark.createDataFrame([(0, [big, -big]), (1, [big + 1, 5]), (2, [big, 7])], "key long, x array<long>")
    assert whiten.sums(frame, 2) == [3 * big + 1, 12 - big]
    got = whiten.scatter(frame, np.array([5, 0]))
    d = [(big - 5, -big), (big - 4, 5), (big - 5, 7)]
    assert got == {(0, 0): sum(a * a for a, _ in d), (0, 1): sum(a * b for a, b in d), (1, 1): sum(b * b for _, b in d)}
