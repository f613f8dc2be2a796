"""Embedding whitening (operator 11): mixed-precision eigenvectors of a distributed covariance.

Entries become whole numbers of 1/256. Equal vectors count once (the fit list). Tasks centre the list's vectors at the whole number nearest to the mean and
add up their products as exact integers; what is left of the mean is taken off exactly too, so the covariance is a matrix of
fractions, without rounding. Its float32 eigenvectors are the start; Ogita-Aishima iterations (matrix multiplications in extended precision) square their error each time. Where
eigenvalues lie closer together than the iteration can tell apart, the vectors of such a cluster are first turned among themselves by a sub-solve of the cluster's own small matrix.

Nothing but a d x d matrix reaches the driver. Edge cases: rows whose vector is null, empty, or holds a null, NaN or infinite entry go. Vectors of
another length than most rows have go too (the longer one of equally common lengths stays). Entries beyond the range of long / 256 saturate. Components whose eigenvalue is nothing but rounding (fewer distinct
vectors than components, constant dimensions) cannot be whitened and are left out, so a corpus of equal vectors gives no rows. A deviation that no long can hold is null. Repeated rows and
ids, and null ids, are rows like others. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle

EXACT = 2**53  # integers up to here are exact as doubles
WIDE = np.longdouble
CLUSTER = 1e-6  # relative gap under which eigenvalues are turned together first


@dataclass(frozen=True)
class Whitening:
    """What the rows need: counts and sums of the fit list, unit eigenvectors (columns), eigenvalues, trace."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def matrix_of(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list<long> column as int64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def centred(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """rows - centre, as Python integers where int64 could run over."""
    if max(np.abs(rows.astype(float)).max(initial=0), np.abs(centre.astype(float)).max(initial=0)) < 2.0**61:
        return rows - centre
    return rows.astype(object) - centre.astype(object)


def products(rows: np.ndarray) -> np.ndarray:
    """rows^T rows as exact Python integers: multiplied as doubles by so many rows at a time that every sum is exact, and number by number where one product may not be."""
    most = max(int(rows.max(initial=0)), -int(rows.min(initial=0)), 1)
    step = EXACT // (most * most)
    if not step:
        wide = rows.astype(object)
        return wide.T @ wide
    out = np.zeros((rows.shape[1], rows.shape[1]), object)
    for at in range(0, len(rows), step):
        own = rows[at : at + step].astype(float)
        out = out + (own.T @ own).astype(np.int64).astype(object)
    return out


def whole_vectors(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """Settled: vec_id and x array<long>, of the rows that stay."""
    v = F.transform(F.col(column), lambda c: c.cast("double"))
    fine = F.coalesce((F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf")))), F.lit(False))  # NaN is above everything
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(fine)
    return settle(rows.select("vec_id", F.transform("v", lambda c: F.floor(256 * c)).alias("x")), "whitening-vectors")


def fit_list(rows: DataFrame) -> tuple[int, DataFrame | None]:
    """(length, settled distinct vectors x) of the commonest length of vectors."""
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return 0, None
    return sizes["d"], settle(rows.filter(F.size("x") == sizes["d"]).select("x").distinct(), "whitening-fit")


def fit(distinct: DataFrame, d: int, components: int) -> Whitening:
    """The whitening of a fit list of vectors of length d."""

    def added(batches):
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            own = matrix_of(batch.column("x"), d)
            n += len(own)
            high, low = own >> 32, own & 0xFFFFFFFF
            total = total + (high.sum(0).astype(object) << 32) + low.sum(0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(d)], pa.int32()), *limbs([n, *total])], ["i", "high", "low"])

    def limbs(values):
        return [pa.array([str(int(v) >> 90) for v in values], pa.string()), pa.array([str(int(v) & (1 << 90) - 1) for v in values], pa.string())]

    def summed(task, *keys):
        """keys -> integer: integers of any length, added up by Spark in two decimal(38) parts."""
        parts = distinct.mapInArrow(task, f"{', '.join(f'{k} int' for k in keys)}, high string, low string").groupBy(*keys)
        rows = parts.agg(*[F.sum(F.col(c).cast("decimal(38,0)")).cast("string").alias(c) for c in ("high", "low")]).collect()
        return {tuple(r[k] for k in keys): (int(r["high"]) << 90) + int(r["low"]) for r in rows}

    found = {i: v for (i,), v in summed(added, "i").items()}
    n, sums = found[-1], [found[i] for i in range(d)]
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    upper = np.triu_indices(d)

    def multiplied(batches):
        total, some = np.zeros((d, d), object), False
        for batch in batches:
            total, some = total + products(centred(matrix_of(batch.column("x"), d), centre)), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), *limbs(total[upper])], ["i", "j", "high", "low"])

    rest = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    square = [[Fraction(0)] * d for _ in range(d)]
    for (i, j), v in summed(multiplied, "i", "j").items():
        square[i][j] = square[j][i] = Fraction(n * v - rest[i] * rest[j], n * n)
    values, vectors = eigen(square, components)
    return Whitening(n, tuple(sums), vectors, values, float(sum(square[i][i] for i in range(d))))


def extended(x: Fraction) -> WIDE:
    """A fraction in extended precision: its double, and the double of what that leaves."""
    near = float(x)
    return WIDE(near) + WIDE(float(x - Fraction(near)))


def eigen(square: list[list[Fraction]], components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues that are more than rounding, falling, and their unit eigenvectors as columns; correct to double precision where gaps are over a thousandth, and always orthonormal."""
    a = np.array([[extended(x) for x in row] for row in square], WIDE)
    scale = np.abs(a).max(initial=WIDE(0))
    if not scale:
        return np.zeros(0), np.zeros((len(a), 0))
    a = a / scale
    start = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1]
    values, vectors = refined(a, start.astype(WIDE))
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    kept = int((values[:components] > len(a) * np.finfo(np.float64).eps * values[0]).sum())
    return (values[:kept] * scale).astype(np.float64), vectors[:, :kept].astype(np.float64)


def even(m: np.ndarray) -> np.ndarray:
    """A matrix made symmetric: what rounding leaves then turns eigenvectors of close eigenvalues, but doesn't skew them."""
    return (m + m.T) / 2


def orthonormal(x: np.ndarray) -> np.ndarray:
    """One Newton step of nearly orthonormal columns to orthonormal ones."""
    return x + x @ even(np.eye(x.shape[1], dtype=WIDE) - x.T @ x) / 2


def refined(a: np.ndarray, x: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Ogita-Aishima: from approximate eigenvectors (columns of x) of the symmetric matrix a to those of the working precision (2^-63, divided by the gap between eigenvalues)."""
    eye, small = np.eye(len(a), dtype=WIDE), np.finfo(WIDE).eps * len(a)
    for _ in range(rounds):
        x, own = turned(a, x)
        r, s = even(eye - x.T @ x), even(x.T @ a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        alike = own[None, :] == own[:, None]
        e = np.where(alike, r / 2, (s + values[None, :] * r) / np.where(alike, 1, values[None, :] - values[:, None]))
        x = x + x @ e
        if np.abs(e).max() < small:
            break
    x = orthonormal(x)
    return np.diag(x.T @ a @ x), x


def clusters(values: np.ndarray, gap: float) -> np.ndarray:
    """A number for each eigenvalue: those that lie within gap of the next one have the same."""
    order = np.argsort(-values, kind="stable")
    out = np.empty(len(values), int)
    out[order] = np.concatenate([[0], np.cumsum(values[order][:-1] - values[order][1:] > gap)])
    return out


def turned(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x with the vectors of each cluster of eigenvalues turned among themselves, so that their own small matrix becomes diagonal; and the clusters' numbers.

    The cluster's mean eigenvalue is taken off first, in extended precision, so the sub-solve sees the differences and not their common size. What makes a cluster is a gap under CLUSTER, or
    under what the error of x leaves in doubt. Of equal eigenvalues any orthonormal basis will do."""
    x = orthonormal(x)
    s = even(x.T @ a @ x)
    values = np.diag(s)
    own = clusters(values, max(CLUSTER, float(64 * np.abs(s - np.diag(values)).max())))
    x = x.copy()
    for k in range(own.max() + 1):
        at = np.flatnonzero(own == k)
        block = s[np.ix_(at, at)]
        block = block - np.trace(block) / len(at) * np.eye(len(at), dtype=WIDE)
        size = np.abs(block).max()
        if len(at) > 1 and size:
            x[:, at] = x[:, at] @ np.linalg.eigh((block / size).astype(np.float64))[1].astype(WIDE)
    return x, own


def deviations(rows: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2 of each row, exact; None where no long holds it."""
    most = max(int(rows.max(initial=0)), -int(rows.min(initial=0))) * n + max(map(abs, sums))
    if most < 1 << 46:
        far = rows * n - np.array(sums, np.int64)
        high, low = far >> 23, far & (1 << 23) - 1
        parts = [(p * q).sum(1).tolist() for p, q in ((high, high), (high, low), (low, low))]
        out = [(hh << 46) + (hl << 24) + ll for hh, hl, ll in zip(*parts, strict=True)]
    else:
        far = rows.astype(object) * n - np.array(sums, object)
        out = (far * far).sum(1).tolist()
    return [v if v < 1 << 63 else None for v in out]


def projected(rows: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened rows: centred, projected on the eigenvectors, divided by the roots of the eigenvalues."""
    whole = np.array([s // model.n for s in model.sums], np.int64)
    part = np.array([s % model.n / model.n for s in model.sums])
    return ((rows - whole).astype(float) - part) @ model.vectors / np.sqrt(model.values)


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the fit list's whitened vectors minus the identity, measured on all of them."""
    d, k = len(model.sums), len(model.values)

    def run(batches):
        n, total, square = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = projected(matrix_of(batch.column("x"), d), model)
            n, total, square = n + len(w), total + w.sum(0), square + w.T @ w
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(k + k * k), pa.int32()), pa.array([*total, *square.ravel()])], ["i", "v"])

    found = distinct.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(k + k * k)
    for r in found:
        flat[r["i"]] = r["v"] / model.n
    mean, square = flat[:k], flat[k:].reshape(k, k)  # the mean is nothing but rounding: the vectors have been centred
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, components: int = 4, column: str = "embedding") -> DataFrame:
    """A row for each row that stays and each of the first components: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = embeddings.sparkSession
    rows = whole_vectors(embeddings, column)
    d, distinct = fit_list(rows)
    model = fit(distinct, d, components) if distinct is not None else None
    if model is None or not len(model.values):
        return spark.createDataFrame([], SCHEMA)
    k, error = len(model.values), identity_error(distinct, model)
    forget(distinct)

    def run(batches):
        for batch in batches:
            own = matrix_of(batch.column("x"), len(model.sums))
            each = lambda column: np.repeat(column, k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(each(np.arange(len(own))))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))),
                    pa.array(np.full(len(own) * k, model.n, np.int64)),
                    pa.array([v for v in deviations(own, model.n, model.sums) for _ in range(k)], pa.int64()),
                    pa.array(projected(own, model).ravel()),
                    pa.array(np.tile(model.values / model.trace, len(own))),
                    pa.array(np.full(len(own) * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.filter(F.size("x") == len(model.sums)).mapInArrow(run, SCHEMA)
