"""Embedding whitening by cyclic Jacobi: exact integer moments from the executors, rotations on the driver.

1. Vectors become integers, floor(64 * entry) + 1000000, in one written table.
2. Sums, then the scatter of the centred vectors: each task subtracts the floor of the mean before it multiplies, so that
   its products are small integers, and adds them up exactly; the fraction of the mean that is left is put right in
   exact arithmetic. A task gives D (D + 1) / 2 numbers, which meet in an aggregation by matrix entry; the driver gets
   one number an entry, whatever the number of vectors.
3. The driver rotates the covariance until each off-diagonal entry is negligible beside the two diagonal entries it
   couples (not beside the largest one): that keeps small eigenvalues accurate. A sweep meets all pairs of dimensions
   in rounds of disjoint pairs.
4. The whitening matrix (D x 32 numbers) goes to the tasks, which project the centred vectors.

Defined results: rows whose vector is null, or holds a null or non-finite entry or one of 2^55 or more in size (its
integer is no long), go. The dimension is the most frequent length of the others (ties: the larger); vectors of other
lengths go too, as they have no covariance with the rest. A component whose variance is zero, up to rounding, has no
whitened value (null) and does not count for identity_error, which is null if there is none. A deviation beyond 38
digits is null (beyond a long: in the query). Rows with equal or null ids are kept as they are; empty tables give empty
ones; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.plans.runtime import Scratch, ship

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Entries of this size or more have no long.
TOO_LARGE = 2.0**55
#: Sums that exceed a decimal travel in two parts.
LOW_BITS = 60
SWEEPS = 60
EPS = float(np.finfo(np.float64).eps)


def integer_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x array<long>) of the rows whose vector is whole and finite."""
    fine = F.forall(vectors[vector], lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < TOO_LARGE))
    x = F.transform(vectors[vector], lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    return vectors.filter(vectors[vector].isNotNull() & fine).select(vectors[key].alias("key"), x.alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], dims: int, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if len(batch):
            yield batch, batch.column(column).flatten().to_numpy().reshape(len(batch), dims)


def _exact(a: np.ndarray, terms: int, power: int, limit: int) -> np.ndarray:
    """a itself if sums of this many products of so many entries stay below limit, else a as Python's integers."""
    most = max(abs(int(a.max())), abs(int(a.min())), 1) if a.size else 1
    return a if terms * most**power < limit else a.astype(object)


def _parts(names: list[str], places: list[np.ndarray], values: list[int]) -> pa.RecordBatch:
    """Exact sums by place, as an upper and a lower part that decimals hold."""
    wide = pa.decimal128(38, 0)
    high = pa.array([Decimal(int(v) >> LOW_BITS) for v in values], wide)
    low = pa.array([Decimal(int(v) & ((1 << LOW_BITS) - 1)) for v in values], wide)
    return pa.RecordBatch.from_arrays([*(pa.array(p.astype(np.int32)) for p in places), high, low], [*names, "high", "low"])


def _added(parts: DataFrame, by: list[str]) -> dict[tuple[int, ...], int]:
    rows = parts.groupBy(*by).agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    return {tuple(r[b] for b in by): (int(r["high"]) << LOW_BITS) + int(r["low"]) for r in rows}


def sums(vectors: DataFrame, dims: int) -> list[int]:
    """The exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims, object)
        for _, x in _matrices(batches, dims, 0):
            total += _exact(x, len(x), 1, 1 << 62).sum(axis=0).astype(object)
        yield _parts(["i"], [np.arange(dims)], list(total))

    got = _added(vectors.select("x").mapInArrow(run, "i int, high decimal(38,0), low decimal(38,0)"), ["i"])
    return [got[(i,)] for i in range(dims)]


def scatter(vectors: DataFrame, centre: np.ndarray) -> dict[tuple[int, ...], int]:
    """The exact sums of products of x - centre, by upper matrix entry."""
    dims = len(centre)
    i, j = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), object)
        for _, x in _matrices(batches, dims, 0):
            d = _exact(x - centre, len(x), 2, 1 << 53)
            d = d if d.dtype == object else d.astype(np.float64)  # whole numbers below 2^53 multiply exactly
            product = d.T @ d
            total += product if product.dtype == object else product.astype(np.int64).astype(object)
        yield _parts(["i", "j"], [i, j], list(total[i, j]))

    return _added(vectors.select("x").mapInArrow(run, "i int, j int, high decimal(38,0), low decimal(38,0)"), ["i", "j"])


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors (columns) of a symmetric matrix."""
    a = np.array(a, np.float64)
    dims = len(a)
    v = np.eye(dims)
    seats = np.arange(dims + dims % 2)  # an odd one out meets nobody in a round
    half = len(seats) // 2
    for _ in range(SWEEPS):
        still = True
        for _ in range(len(seats) - 1):
            p, q = np.minimum(seats[:half], seats[:half - 1 : -1]), np.maximum(seats[:half], seats[:half - 1 : -1])
            p, q = p[q < dims], q[q < dims]
            off, one, two = a[p, q], a[p, p], a[q, q]
            far = np.abs(off) > EPS * np.sqrt(np.abs(one)) * np.sqrt(np.abs(two))
            if far.any():
                still = False
                p, q, off, one, two = p[far], q[far], off[far], one[far], two[far]
                tau = (two - one) / 2 / off
                t = np.where(tau < 0, -1.0, 1.0) / (np.abs(tau) + np.hypot(1.0, tau))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                rows_p, rows_q = a[p], a[q]
                a[p], a[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
                for m in (a, v):
                    cols_p, cols_q = m[:, p], m[:, q]
                    m[:, p], m[:, q] = c * cols_p - s * cols_q, s * cols_p + c * cols_q
                a[p, p], a[q, q] = one - t * off, two + t * off
                a[p, q] = a[q, p] = 0.0
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if still:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order]


@dataclass
class Whitening:
    """What a fit leaves: n vectors, sums S = n * centre + rest, the leading components and how much each explains."""

    n: int
    centre: np.ndarray
    rest: list[int]
    matrix: np.ndarray  # D x components; a column of nan where there is no variance
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) - np.array([r / self.n for r in self.rest])) @ self.matrix


def fit(vectors: DataFrame, n: int, dims: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of a table of integer vectors, all of this length."""
    total = sums(vectors, dims)
    centre = np.array([s // n for s in total], np.int64)
    rest = [s % n for s in total]
    products = scatter(vectors, centre)
    v = np.zeros((dims, dims))
    for (i, j), p in products.items():
        v[i, j] = v[j, i] = (n * p - rest[i] * rest[j]) / (n * n)
    trace = float(np.trace(v))
    e, axes = jacobi(v)
    e, axes = e[:components], axes[:, :components]
    noise = dims * EPS * (np.abs(axes) * np.sqrt(np.diag(v))[:, None]).sum(axis=0) ** 2
    real = e > noise
    matrix = np.where(real, axes / np.sqrt(np.where(real, e, 1.0)), np.nan)
    return Whitening(n, centre, rest, matrix, np.where(real, e, 0.0) / (trace or 1.0))


def whitened(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(key, deviation decimal, whitened array<double>) of every integer vector."""
    n, dims = model.n, len(model.centre)
    k = model.matrix.shape[1]
    bare = np.isnan(model.matrix[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _matrices(batches, dims, 1):
            far = x - model.centre
            bound = dims * (n * (abs(far).max() + 1).astype(object)) ** 2
            far = far if bound < 1 << 62 else far.astype(object)
            far = (far * n - np.array(model.rest, far.dtype)) ** 2
            far = [None if d >= 10**38 else Decimal(int(d)) for d in far.sum(axis=1).tolist()]
            w = model.project(x).ravel()
            values = pa.array(w, mask=np.tile(bare, len(x)))
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * k, values)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(far, pa.decimal128(38, 0)), lists], ["key", "deviation", "whitened"])

    key = vectors.schema["key"].dataType.simpleString()
    return vectors.select("key", "x").mapInArrow(run, f"key {key}, deviation decimal(38,0), whitened array<double>")


def identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """The largest entry by which the covariance of the whitened vectors differs from the identity, measured on all of them."""
    real = np.flatnonzero(~np.isnan(model.matrix[0]))
    if not len(real):
        return None
    dims, k = len(model.centre), len(real)
    i, j = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for _, x in _matrices(batches, dims, 0):
            w = model.project(x)[:, real]
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "total"])

    each = vectors.select("x").mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
    error = F.abs(F.col("total") / model.n - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    return each.agg(F.max(error)).first()[0]


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None, float | None]:
    """(key, deviation, whitened) of every vector that is kept, the model, and the measured identity error.

    The fit list is all kept vectors. whitened has min(components, dimensions) entries.
    """
    spark = vectors.sparkSession
    ship(spark)
    kept = Scratch(spark).put(integer_vectors(vectors, key, vector), "vectors")
    sized = kept.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n"))
    most = sized.orderBy(F.desc("n"), F.desc("dims")).first()
    if most is None or not most["dims"]:
        none = kept.limit(0).select("key", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened"))
        return none, None, None
    kept = kept.filter(F.size("x") == most["dims"])
    model = fit(kept, most["n"], most["dims"], components)
    return whitened(kept, model), model, identity_error(kept, model)
