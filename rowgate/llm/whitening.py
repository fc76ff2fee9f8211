"""PCA whitening: exact integer covariance, single-precision eigenvectors, refined to double precision by matrix products.

The fit is two passes. Integer vectors have exact sums, and centred at the rounded mean an exact matrix of products, which
is set right for the rounding in whole numbers; so the covariance has no error but its last rounding. A 32-bit
solver gives approximate eigenvectors. Ogita and Aishima's iteration corrects them with four matrix products in extended precision
a step, the error squared each time. Where eigenvalues lie too close for that, their space is refined as one, and then split by
solving the small matrix of that space, shifted by its mean, so that what tells its eigenvalues apart is not rounded away.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgate.llm.clustering import usable, whole
from rowgate.llm.common import slices

_LONG = (1 << 63) - 1
_WIDE = np.longdouble


def integer_vectors(embeddings: DataFrame, dims: int = 64, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``vec_id``, ``x``: floor(scale * component) + shift of the vectors that have ``dims`` components, all finite."""
    kept = embeddings.filter(usable("embedding") & (F.size("embedding") == dims))
    x = F.transform("embedding", lambda c: whole(c, scale) + F.lit(shift).cast("long"))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


# --- eigenvectors ---


def _norm(m: np.ndarray) -> float:
    return float(np.linalg.norm(m.astype(np.float64), 2))


def _correction(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The step by which ``x`` nears the eigenvectors of ``a``, its eigenvalues, and the gap below which two of them are one cluster."""
    r = np.eye(len(a), dtype=_WIDE) - x.T @ x
    s = x.T @ (a @ x)
    value = np.diag(s) / (1 - np.diag(r))
    gap = 2 * (_norm(s - np.diag(value)) + _norm(a) * _norm(r))
    apart = value[None, :] - value[:, None]
    far = np.abs(apart) > gap
    step = np.where(far, (s + value[None, :] * r) / np.where(far, apart, 1), r / 2)
    return step, value, gap


def _clusters(value: np.ndarray, gap: float) -> list[np.ndarray]:
    order = np.argsort(value)
    cut = np.flatnonzero(np.diff(value[order]) > gap) + 1
    return [c for c in np.split(order, cut) if len(c) > 1]


def refined(a: np.ndarray, most: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix in extended precision, to double precision.

    Within a group of equal eigenvalues any orthogonal basis of their space is returned.
    """
    a = np.asarray(a, _WIDE)
    size = np.abs(a).max(initial=0)
    if not size:
        return np.zeros(len(a), _WIDE), np.eye(len(a), dtype=_WIDE)
    a, size = a / size, _WIDE(size)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(_WIDE)
    tiny = 4 * np.finfo(_WIDE).eps
    for _ in range(most):
        step, value, gap = _correction(a, x)
        x = _orthonormal(x + x @ step)
        groups = _clusters(value, gap)
        for group in groups:
            # the group's space is right to the square of the last error: its own small matrix, less its mean, tells its members apart
            basis, middle = x[:, group], value[group].mean()
            small = basis.T @ (a @ basis - middle * basis)
            spread = np.abs(small).max()
            if spread > tiny:
                turn = np.linalg.eigh(((small + small.T) / (2 * spread)).astype(np.float64))[1].astype(_WIDE)
                x[:, group] = basis @ _orthonormal(turn)
        if _norm(step) <= 64 * len(a) * float(tiny) and (not groups or gap <= 1e3 * len(a) * float(tiny)):
            break
    value = (x * (a @ x)).sum(0)
    order = np.argsort(-value, kind="stable")
    return value[order] * size, x[:, order]


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """The nearest matrix of orthonormal columns, by Newton's iteration; ``x`` nearly is one."""
    eye = np.eye(x.shape[1], dtype=_WIDE)
    for _ in range(4):
        r = eye - x.T @ x
        x = x + x @ r / 2
        if np.abs(r).max() < 1e-11:
            break
    return x


# --- fit ---


@dataclass
class Whitening:
    """``n`` vectors of integer sums ``total``; ``matrix`` (dims, components) projects a centred vector to unit variance.

    ``share`` is each component's part of the variance. A component without variance has no direction: its column is NaN.
    """

    n: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray
    matrix: np.ndarray
    share: np.ndarray

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """The rounded mean as whole numbers, and what the mean is above it."""
        middle = [(2 * t + self.n) // (2 * self.n) for t in self.total]
        return np.array(middle, object), np.array([float(Fraction(t, self.n) - m) for t, m in zip(self.total, middle, strict=True)])


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _centred(column: pa.Array, middle: np.ndarray) -> np.ndarray:
    """Vectors less a whole-numbered centre: longs, or whole numbers of any size where they don't fit."""
    x = _rows(column)
    most = max(int(np.abs(x).max()), max(abs(int(m)) for m in middle))
    return x - middle.astype(np.int64) if most < 1 << 61 else x.astype(object) - middle


def _totals(vectors: DataFrame) -> tuple[int, list[int]]:
    """How many vectors, and the exact sum of each component. A number for each comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, []
        for batch in (s for b in batches for s in slices(b, 2048)):
            if batch.num_rows:
                x = _rows(batch.column("x"))
                small = int(np.abs(x).max()) < 1 << 50
                part = (x if small else x.astype(object)).sum(0).astype(object)
                n, sums = n + len(x), part + (sums if len(sums) else 0)
        if n:
            values = pa.array([Decimal(int(v)) for v in sums], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums), pa.int64()), values], ["i", "n", "v"])

    parts = vectors.select("x").mapInArrow(run, "i int, n long, v decimal(38,0)")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).orderBy("i").collect()
    return (rows[0].n if rows else 0), [int(r.v) for r in rows]


def _products(vectors: DataFrame, middle: np.ndarray) -> list[list[int]]:
    """Sums over all rows of the products of centred components, exact. dims x dims numbers come to the driver."""
    dims = len(middle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros((dims, dims), object)
        for batch in (s for b in batches for s in slices(b, 2048)):
            if batch.num_rows:
                y = _centred(batch.column("x"), middle)
                most = int(np.abs(y).max(initial=0))
                if most * most * len(y) < 1 << 53:  # doubles are exact
                    part = (y.astype(np.float64).T @ y.astype(np.float64)).astype(np.int64)
                else:
                    part = y.astype(object).T @ y.astype(object)
                whole = whole + part.astype(object)
        values = [[Decimal(int(v)) for v in row] for row in whole]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(values, pa.list_(pa.decimal128(38, 0)))], ["i", "row"])

    parts = vectors.select("x").mapInArrow(run, "i int, row array<decimal(38,0)>")
    sums = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = [[0] * dims for _ in range(dims)]
    for r in sums.collect():
        out[r.i][r.j] = int(r.v)
    return out


def fit(vectors: DataFrame, components: int = 32) -> Whitening | None:
    """The whitening of all ``vectors`` (``x``, of one length); None if there are none."""
    n, total = _totals(vectors)
    if not n:
        return None
    middle = [(2 * t + n) // (2 * n) for t in total]
    rest = [t - n * m for t, m in zip(total, middle, strict=True)]
    products = _products(vectors, np.array(middle, object))
    # n * n * covariance, in whole numbers
    exact = [[n * p - a * b for p, b in zip(row, rest, strict=True)] for row, a in zip(products, rest, strict=True)]
    square = n * n
    cov = np.array([[_longdouble(Fraction(v, square)) for v in row] for row in exact], _WIDE)
    values, directions = refined(cov)
    k = min(components, len(total))
    trace = float(Fraction(sum(exact[i][i] for i in range(len(total))), square))
    lively = values[:k] > 1e-13 * max(float(values[0]), 0.0)
    scale = np.where(lively, 1 / np.sqrt(np.where(lively, values[:k], 1)), np.nan)
    share = np.where(lively, values[:k] / (trace or 1), 0)
    return Whitening(n, total, values[:k].astype(np.float64), directions[:, :k].astype(np.float64), (directions[:, :k] * scale).astype(np.float64), share.astype(np.float64))


def _longdouble(f: Fraction) -> np.longdouble:
    high = float(f)
    return _WIDE(high) + _WIDE(float(f - Fraction(high)))


def _whitened(y: np.ndarray, fraction: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    return (y.astype(np.float64) - fraction) @ matrix


def identity_error(vectors: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity, measured on all of them.

    Components without variance are left out; without any it is 0.
    """
    middle, fraction = fitted.parts()
    lively = np.flatnonzero(~np.isnan(fitted.matrix[0])) if len(fitted.matrix) else np.zeros(0, int)
    matrix = fitted.matrix[:, lively]
    k = len(lively)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, sums = np.zeros((k, k)), np.zeros(k)
        for batch in (s for b in batches for s in slices(b, 2048)):
            if batch.num_rows:
                w = _whitened(_centred(batch.column("x"), middle), fraction, matrix)
                gram, sums = gram + w.T @ w, sums + w.sum(0)
        flat = pa.array(np.concatenate([gram.ravel(), sums]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), flat], ["i", "v"])

    parts = vectors.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    flat = np.array([r.v for r in parts]) / fitted.n
    gram, mean = flat[: k * k].reshape(k, k), flat[k * k :]  # the vectors are centred, so their mean is rounding alone
    return float(np.abs(gram - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, fitted: Whitening) -> DataFrame:
    """``vec_id``, ``deviation``, ``whitened`` (an array, a number for each component) for each row.

    ``deviation`` is the exact sum over dimensions of (n * x - total)^2, null where no long holds it; a component
    without variance is null.
    """
    middle, fraction = fitted.parts()
    n = fitted.n
    rest = np.array([t - n * int(m) for t, m in zip(fitted.total, middle, strict=True)], object)
    far = max((abs(int(r)) for r in rest), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, 2048)):
            if not batch.num_rows:
                continue
            y = _centred(batch.column("x"), middle)
            most = n * int(np.abs(y).max(initial=0)) + far
            d = n * y - rest.astype(np.int64) if len(rest) * most * most < 1 << 63 else n * y.astype(object) - rest
            deviation = (d * d).sum(1)
            told = pa.array(deviation) if deviation.dtype == np.int64 else pa.array([int(v) if v <= _LONG else None for v in deviation], pa.int64())
            w = _whitened(y, fraction, fitted.matrix)
            flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), told, lists], ["vec_id", "deviation", "whitened"])

    return vectors.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def components(embeddings: DataFrame, most: int = 32, dims: int = 64, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """A row for each usable vector and each of the ``most`` first components (of all, if vectors are shorter): ``vec_id``, ``component``,
    ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Vectors that are null, have another length than ``dims``, or hold a null or a number that isn't finite are in neither the fit nor
    the result. Repeated rows each count; a null vec_id is a row like another. A component without variance (of too few or constant
    vectors) has a null in ``whitened`` and explains 0. A component beyond 2^56 is an error. No vectors give no rows. Columns other than vec_id and embedding are not looked at.
    """
    vectors = integer_vectors(embeddings, dims, scale, shift)
    fitted = fit(vectors, most)
    if fitted is None:
        schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, fitted)
    rows = whiten(vectors, fitted).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.array(*(F.lit(float(s)) for s in fitted.share))
    return rows.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
