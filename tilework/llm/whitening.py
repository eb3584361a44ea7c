"""Whitening of embeddings: Welford's rank-one updates in every partition, merged by the parallel formula, and a symmetric QR eigen-solve.

Vectors go in fixed point (`fixed_point`), so that their sums and deviations are
exact. Moments are those of the distinct vectors.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: A vector's entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components that are returned at most.
COMPONENTS = 16
#: Moments that one task merges; more of them are merged by several tasks first.
MERGED_AT_ONCE = 64
#: Eigenvalues under this share of the largest are those of directions in which the vectors do not differ.
FLAT = 1e-13


class Moments(NamedTuple):
    """n vectors' sums (exact), mean, and sums of products of deviations."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    products: np.ndarray


def streamed(rows) -> Moments | None:
    """Welford's update, vector by vector: the mean moves, and the products grow by a matrix of rank one."""
    found = None
    for x in rows:
        if found is None:
            found = True
            n, sums, mean, products = 0, np.zeros(len(x), x.dtype), np.zeros(len(x)), np.zeros((len(x), len(x)))
        n += 1
        sums += x
        at = x.astype("f8")
        before = at - mean
        mean += before / n
        products += np.multiply.outer(before, at - mean)
    return None if found is None else Moments(n, sums, mean, products)


def merged(a: Moments, b: Moments) -> Moments:
    """The moments of both (the parallel update formula)."""
    n, apart = a.n + b.n, b.mean - a.mean
    return Moments(n, a.sums + b.sums, a.mean + apart * (b.n / n), a.products + b.products + np.multiply.outer(apart, apart) * (a.n * b.n / n))


def _tridiagonal(square: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder's reduction of a symmetric matrix: diagonal, off-diagonal, and the basis (a row a vector)."""
    a, n = square.copy(), len(square)
    basis = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        norm = math.sqrt(float((v * v).sum()))
        if not norm:
            continue
        target = -math.copysign(norm, v[0])
        v[0] -= target
        v /= math.sqrt(float((v * v).sum()))
        block = a[k + 1 :, k + 1 :]
        p = (block * v).sum(1)
        w = p - float((p * v).sum()) * v
        block -= 2 * (np.multiply.outer(v, w) + np.multiply.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = target
        below = basis[k + 1 :]
        below -= 2 * np.multiply.outer(v, (below * v[:, None]).sum(0))
    return np.diag(a).copy(), np.diag(a, 1).copy(), basis


def symmetric_eigen(square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors (a row each), by implicit QR steps with Wilkinson's shift on the tridiagonal form."""
    d, e, basis = _tridiagonal(np.asarray(square, "f8"))
    high, eps = len(d) - 1, np.finfo("f8").eps
    while high > 0:
        small = np.abs(e[:high]) <= eps * (np.abs(d[:high]) + np.abs(d[1 : high + 1]))
        e[:high][small] = 0.0
        if not e[high - 1]:
            high -= 1
            continue
        apart = np.flatnonzero(e[: high - 1] == 0)
        low = int(apart[-1]) + 1 if len(apart) else 0
        half = (d[high - 1] - d[high]) / 2
        shift = d[high] - e[high - 1] ** 2 / (half + math.copysign(math.hypot(half, e[high - 1]), half))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):  # the bulge is chased down the diagonal
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            top, off, bottom = d[k], e[k], d[k + 1]
            d[k] = c * c * top + 2 * c * s * off + s * s * bottom
            d[k + 1] = s * s * top - 2 * c * s * off + c * c * bottom
            e[k] = c * s * (bottom - top) + (c * c - s * s) * off
            if k < high - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            upper = c * basis[k] + s * basis[k + 1]
            basis[k + 1] = c * basis[k + 1] - s * basis[k]
            basis[k] = upper
    order = np.argsort(-d, kind="stable")
    return d[order], basis[order]


def fixed_point(embeddings: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x binary): x are 64-bit numbers; vectors that are null, empty, or hold a null or an entry that is not finite are left out."""
    rows = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))

    def put(batches):
        for batch in batches:
            v = batch.column(1)
            ends, flat = v.offsets.to_numpy(), v.values
            known = flat.is_valid().to_numpy(zero_copy_only=False) if flat.null_count else np.ones(len(flat), bool)
            values = flat.fill_null(0.0).to_numpy(zero_copy_only=False) if flat.null_count else flat.to_numpy(zero_copy_only=False)
            bad = np.concatenate([[0], np.cumsum(~(known & np.isfinite(values)))])
            good = (bad[ends[1:]] == bad[ends[:-1]]) & (ends[1:] > ends[:-1]) & v.is_valid().to_numpy(zero_copy_only=False)
            with np.errstate(all="ignore"):
                x = np.clip(np.floor(np.nan_to_num(values, nan=0.0, posinf=0.0, neginf=0.0) * SCALE), -(2.0**62), 2.0**62).astype("<i8") + SHIFT
            kept = np.flatnonzero(good)
            made = [x[ends[i] : ends[i + 1]].tobytes() for i in kept.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array(made, pa.binary())], ["vec_id", "x"])

    return rows.mapInArrow(put, "vec_id long, x binary")


def _vectors(column, exact: bool = False):
    for x in column:
        v = np.frombuffer(x.as_buffer(), "<i8")
        yield v.astype(object) if exact else v


def _packed(m: Moments) -> dict:
    return {"n": m.n, "sums": [str(int(s)) for s in m.sums], "mean": m.mean.tolist(), "products": m.products.tobytes()}


def _unpacked(row: dict) -> Moments:
    mean = np.array(row["mean"])
    return Moments(row["n"], np.array([int(s) for s in row["sums"]], object), mean, np.frombuffer(row["products"]).reshape(len(mean), len(mean)))


_MOMENTS = "n long, sums array<string>, mean array<double>, products binary"
_ARROW = pa.schema([("n", pa.int64()), ("sums", pa.list_(pa.string())), ("mean", pa.list_(pa.float64())), ("products", pa.binary())])


def _merge(batches):
    found = None
    for batch in batches:
        for row in batch.to_pylist():
            new = _unpacked(row)
            found = new if found is None else merged(found, new)
    if found is not None:
        yield pa.RecordBatch.from_pylist([_packed(found)], schema=_ARROW)


def _in_one(partials: DataFrame) -> Moments | None:
    """The moments of all partitions; tasks merge them in several rounds, so that none gets one from every partition."""
    partials = saved(partials, "moments")
    many = partials.count()
    while many > MERGED_AT_ONCE:
        many = -(-many // MERGED_AT_ONCE)
        partials = saved(partials.repartition(many).mapInArrow(_merge, _MOMENTS), "moments")
    row = partials.repartition(1).mapInArrow(_merge, _MOMENTS).first()
    return None if row is None else _unpacked(row.asDict())


def moments(vectors: DataFrame) -> Moments | None:
    """The moments of the column x (see fixed_point) of all rows, which are equally long; nothing without rows."""

    def stream(batches):
        found = None
        for batch in batches:
            columns = list(_vectors(batch.column(0)))
            if not columns:
                continue
            exact = max(int(np.abs(x).max()) for x in columns) * len(columns) >= 2**62
            new = streamed(_vectors(batch.column(0), exact) if exact else columns)
            found = new._replace(sums=new.sums.astype(object)) if found is None else merged(found, new._replace(sums=new.sums.astype(object)))
        if found is not None:
            yield pa.RecordBatch.from_pylist([_packed(found)], schema=_ARROW)

    return _in_one(vectors.select("x").mapInArrow(stream, _MOMENTS))


class Whitening(NamedTuple):
    """What whitens: of each component its unit vector (a row), eigenvalue and share of the variance; n and sums of the fit list."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def deviations(self, xs: np.ndarray) -> np.ndarray:
        """n * x - S of vectors (a row each), exact: numbers of 64 bits, or Python's where those do not do."""
        top = max([abs(s) for s in self.sums], default=0) + self.n * int(np.abs(xs).max(initial=0))
        return (self.n * xs.astype(object) if top >= 2**62 else self.n * xs) - np.array(self.sums, object if top >= 2**62 else "i8")

    def whiten(self, apart: np.ndarray) -> np.ndarray:
        """The whitened values out of deviations(); of directions in which the fit list does not differ, NaN."""
        found = np.einsum("ij,kj->ik", (apart / self.n).astype("f8"), self.components)
        return found / np.sqrt(np.where(self.values > 0, self.values, np.nan))


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the column x, each vector once; the driver gets one matrix, as wide as a vector is long."""
    found = moments(distinct)
    if found is None:
        return None
    covariance = found.products / found.n
    values, vectors = symmetric_eigen((covariance + covariance.T) / 2)
    trace = float(np.trace(covariance))
    values = np.where(values > FLAT * max(trace, 0.0), values, 0.0)[:components]
    return Whitening(found.n, [int(s) for s in found.sums], vectors[:components], values, values / trace if trace > 0 else values)


def identity_error(distinct: DataFrame, made: Whitening) -> float:
    """The largest entry by which the covariance of the fit list's whitened vectors departs from the identity, over directions that differ."""

    def stream(batches):
        found = None
        for batch in batches:
            if batch.num_rows:
                z = made.whiten(made.deviations(np.stack(list(_vectors(batch.column(0))))))[:, made.values > 0]
                middle = z - z.mean(0)
                new = Moments(len(z), np.zeros(z.shape[1], object), z.mean(0), np.einsum("ij,ik->jk", middle, middle))
                found = new if found is None else merged(found, new)
        if found is not None:
            yield pa.RecordBatch.from_pylist([_packed(found)], schema=_ARROW)

    found = _in_one(distinct.select("x").mapInArrow(stream, _MOMENTS))
    if found is None or not found.products.size:
        return 0.0
    return float(np.abs(found.products / found.n - np.eye(len(found.mean))).max())


def whiten(embeddings: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component, numbered from 1.

    Vectors that are null, empty, or hold null or non-finite entries are left out;
    so are those that are not as long as the most are (of equals, the longest).
    Repeated rows and null ids stay, and equal vectors count once in the fit.
    A direction in which the fit list does not differ has a null `whitened`;
    a deviation beyond 64 bits is null. Other columns are ignored; a table
    without vectors gives no rows.

    The distinct vectors are found by one aggregation, which a vector that many
    rows share enters once a task. They are written once and read for the moments
    and for the check; all rows are then mapped where they lie.
    """
    rows = fixed_point(embeddings, id_column, vector)
    columns = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    distinct = saved(rows.groupBy("x").agg(F.count("*").alias("copies")), "vectors", "zstd")
    sizes = distinct.groupBy(F.length("x").alias("bytes")).agg(F.sum("copies").alias("copies")).orderBy(F.desc("copies"), F.desc("bytes")).first()
    if sizes is None:
        return embeddings.sparkSession.createDataFrame([], columns)
    wide = sizes["bytes"]
    same = distinct.where(F.length("x") == wide)
    made = fit(same, components)
    error = identity_error(same, made)

    def put(batches):
        k = len(made.values)
        for batch in batches:
            if not batch.num_rows:
                continue
            apart = made.deviations(np.stack(list(_vectors(batch.column(1)))))
            z = made.whiten(apart)
            top = int(np.abs(apart).max(initial=0))
            if top * top * apart.shape[1] < 2**63:
                squares = pa.array((apart * apart).sum(1).astype("i8"))
            else:
                squares = pa.array([s if s < 2**63 else None for s in (int(sum(int(v) ** 2 for v in row)) for row in apart)], pa.int64())
            at = pa.array(np.repeat(np.arange(len(z)), k))
            flat = np.broadcast_to(made.values > 0, z.shape).reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), len(z))), pa.array(np.full(len(z) * k, made.n)), squares.take(at),
                    pa.array(z.reshape(-1), mask=~flat), pa.array(np.tile(made.explained, len(z))), pa.array(np.full(len(z) * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.where(F.length("x") == wide).mapInArrow(put, columns)
