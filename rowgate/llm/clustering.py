"""Exact k-means over integer vectors by bounded search from the nearer of two remembered centroids.

A vector keeps four numbers from round to round: its centroid, the second-nearest one, an upper bound of the distance to
the first and a lower bound of that to all others. Where the bounds (moved by what the centroids moved) or half the way
to the next centroid settle it, nothing is computed. Otherwise the search starts at the closer of the two, walks that one's
neighbours from near to far, and ends where they leave a ball that shrinks whenever a nearer second one is
found. What is within the ball is compared by squared distances in integers, so ties are told exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgate.llm.common import discard, shared_table, slices

#: Bounds are floats; distances between them and a test are taken as equal within this share.
_SLACK = 1e-9
_LONG = (1 << 63) - 1
_STATE = "vec_id long, x array<long>, cluster int, second int, upper double, lower double, distance long, n long, sums array<decimal(38,0)>, inertia decimal(38,0)"
_NAMES = [f.split()[0] for f in _STATE.replace("decimal(38,0)", "decimal").split(", ")]


def usable(vector: str | Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    v = F.col(vector) if isinstance(vector, str) else vector
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & good, F.lit(False))


def whole(component: Column, scale: int) -> Column:
    """floor(scale * component) as a long; an error where that is beyond 2^62."""
    scaled = component.cast("double") * scale
    return F.when(F.abs(scaled) < F.lit(2.0**62), F.floor(scaled).cast("long")).otherwise(F.raise_error(F.lit("a component is too large")).cast("long"))


def integer_vectors(embeddings: DataFrame, dims: int = 64, scale: int = 1024) -> DataFrame:
    """``vec_id``, ``x``: floor(scale * component) of the vectors that have exactly ``dims`` finite components."""
    kept = embeddings.filter(usable("embedding") & (F.size("embedding") == dims))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: whole(c, scale)).alias("x"))


def seeds(vectors: DataFrame, k: int, salt: int) -> np.ndarray:
    """The vectors of the ``k`` smallest sha256 of ``salt:vec_id``; a null id comes last, rows of one id by their components."""
    by = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(by.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r.x for r in rows], object)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(1)


def _root(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64))


@dataclass
class Round:
    """Centroids with, for each, the others from near to far, and how far the centroids moved since the last round."""

    centers: np.ndarray
    order: np.ndarray
    reach: np.ndarray
    drift: np.ndarray
    others: np.ndarray

    @staticmethod
    def of(centers: np.ndarray, before: np.ndarray | None = None) -> Round:
        k = len(centers)
        apart = np.array([_root(_squared(centers, c)) for c in centers]).reshape(k, k)
        order = np.array([[j for j in np.lexsort((np.arange(k), row)) if j != i] for i, row in enumerate(apart)], np.int64).reshape(k, max(0, k - 1))
        drift = np.zeros(k) if before is None else _root(_squared(centers, before))
        others = np.array([np.delete(drift, i).max(initial=0) for i in range(k)])
        return Round(centers, order, np.take_along_axis(apart, order, 1), drift, others)

    def search(self, x: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
        """Nearest and second-nearest centroid of each row with their squared distances; ties go to the smaller number."""
        own, other = _squared(x, self.centers[first]), _squared(x, self.centers[second])
        turn = (other < own) | ((other == own) & (second < first))
        start = np.where(turn, second, first)
        near, far = np.where(turn, other, own), np.where(turn, own, other)
        b1, b2 = start.copy(), np.where(turn, first, second)
        d1, d2, away = near, far, _root(near)
        walking = np.arange(len(x))
        for place in range(self.order.shape[1]):
            ball = (away[walking] + _root(d2[walking])) * (1 + _SLACK)
            walking = walking[self.reach[start[walking], place] <= ball]
            if not len(walking):
                break
            c = self.order[start[walking], place]
            new = (c != first[walking]) & (c != second[walking])
            at, c = walking[new], c[new]
            d = _squared(x[at], self.centers[c])
            best = (d < d1[at]) | ((d == d1[at]) & (c < b1[at]))
            i = at[best]
            b2[i], d2[i], b1[i], d1[i] = b1[i], d1[i], c[best], d[best]
            close = ~best & ((d < d2[at]) | ((d == d2[at]) & (c < b2[at])))
            i = at[close]
            b2[i], d2[i] = c[close], d[close]
        return b1, d1, b2, d2

    def assign(self, x: np.ndarray, cluster: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cluster, second-nearest, upper and lower bound of each row under these centroids."""
        if len(self.centers) == 1:
            return np.zeros_like(cluster), second, np.full(len(x), np.inf), lower
        cluster, second = cluster.copy(), second.copy()
        upper = upper + self.drift[cluster]
        lower = np.maximum(lower - self.others[cluster], self.reach[cluster, 0] / 2)
        open_ = np.flatnonzero(upper * (1 + _SLACK) >= lower * (1 - _SLACK))
        upper[open_] = _root(_squared(x[open_], self.centers[cluster[open_]]))
        open_ = open_[upper[open_] * (1 + _SLACK) >= lower[open_] * (1 - _SLACK)]
        cluster[open_], d1, second[open_], d2 = self.search(x[open_], cluster[open_], second[open_])
        upper[open_], lower[open_] = _root(d1), _root(d2)
        return cluster, second, upper, lower


def _matrix(column: pa.Array, exact: bool) -> np.ndarray:
    flat = column.flatten().to_numpy()
    wide = flat.reshape(len(column), -1)
    return wide if exact else wide.astype(object)


def _step(state: DataFrame, now: Round, exact: bool, last: bool) -> str:
    """Every vector under these centroids, and behind each task's rows one row of totals for each of its clusters. Returns the folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = now.centers.shape
        count, sums, inertia = np.zeros(k, np.int64), np.zeros((k, dims), object), np.zeros(k, object)
        for batch in (s for b in batches for s in slices(b, 4096)):
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), exact)
            held = [batch.column(c).to_numpy() for c in ("cluster", "second", "upper", "lower")]
            cluster, second, upper, lower = now.assign(x, *held)
            distance = _squared(x, now.centers[cluster])
            order = np.argsort(cluster, kind="stable")
            found, starts = np.unique(cluster[order], return_index=True)
            count[found] += np.diff(np.append(starts, len(order)))
            sums[found] += np.add.reduceat(x[order], starts, axis=0).astype(object)
            if last:
                inertia[found] += np.add.reduceat(distance[order].astype(object), starts)
            none = pa.nulls(batch.num_rows)
            told = pa.array([int(d) if d <= _LONG else None for d in distance], pa.int64()) if last else none.cast(pa.int64())
            columns = [batch.column("vec_id"), batch.column("x"), pa.array(cluster), pa.array(second), pa.array(upper), pa.array(lower), told]
            yield pa.RecordBatch.from_arrays([*columns, *(none.cast(t) for t in _TOTALS)], _NAMES)
        found = np.flatnonzero(count)
        if len(found):
            none = [pa.nulls(len(found)).cast(t) for t in (pa.int64(), pa.list_(pa.int64()))]
            rest = [pa.nulls(len(found)).cast(t) for t in (pa.int32(), pa.float64(), pa.float64(), pa.int64())]
            values = (count[found].tolist(), [[Decimal(int(v)) for v in row] for row in sums[found]], [Decimal(int(v)) for v in inertia[found]])
            totals = [pa.array(v, t) for v, t in zip(values, _TOTALS, strict=True)]
            yield pa.RecordBatch.from_arrays([*none, pa.array(found.astype(np.int32)), *rest, *totals], _NAMES)

    return shared_table(state.mapInArrow(run, _STATE))


_TOTALS = (pa.int64(), pa.list_(pa.decimal128(38, 0)), pa.decimal128(38, 0))


def _moved(totals: DataFrame, centers: np.ndarray, exact: bool) -> np.ndarray:
    """Each centroid at the floor of its vectors' mean; one without vectors stays. A number for each centroid and component comes here."""
    n = {r.cluster: r.n for r in totals.groupBy("cluster").agg(F.sum("n").alias("n")).collect()}
    each = totals.select("cluster", F.posexplode("sums").alias("i", "v")).groupBy("cluster", "i").agg(F.sum("v").alias("v"))
    out = centers.astype(object)
    for r in each.collect():
        out[r.cluster, r.i] = int(r.v) // n[r.cluster]
    return out.astype(np.int64) if exact else out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, salt: int = 3) -> tuple[DataFrame, np.ndarray]:
    """k-means of integer ``vectors`` (``vec_id``, ``x``, all of one length): rows with ``cluster`` and squared ``distance``, and the centroids.

    One row for each row; with fewer vectors than ``k`` there are as many centroids as vectors. The rows also come with
    ``cluster_inertia`` and ``inertia``. No vectors give no rows. A distance or inertia that no long holds is null: components
    may be so large, and then everything is computed in whole numbers of any size. Each round reads one written
    table and writes the next; only centroids, k times the vector's length, come to the driver.
    """
    spark = vectors.sparkSession
    start = [F.lit(0).alias("cluster"), F.lit(min(1, k - 1)).alias("second"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower")]
    path = shared_table(vectors.select("vec_id", "x", *start))
    state = spark.read.parquet(path)
    centers = seeds(state, k, salt)
    if not len(centers):
        empty = spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long")
        return empty, centers
    state = state.withColumn("second", F.lit(min(1, len(centers) - 1)))
    largest = state.agg(F.max(F.array_max(F.transform("x", lambda c: F.abs(c))))).first()[0]
    exact = len(centers[0]) * (2 * largest) ** 2 <= _LONG
    centers = centers.astype(np.int64) if exact else centers
    now = Round.of(centers)
    for at in range(rounds + 1):
        written = _step(state, now, exact, at == rounds)
        discard(spark, path)
        path = written
        table = spark.read.schema(_STATE).parquet(path)
        state, totals = table.filter("n is null").select(*_NAMES[:6]), table.filter("n is not null").select("cluster", "n", "sums")
        if at < rounds:
            moved = _moved(totals, now.centers, exact)
            now = Round.of(moved, now.centers)
    sums = {r.cluster: int(r.v) for r in table.filter("n is not null").groupBy("cluster").agg(F.sum("inertia").alias("v")).collect()}
    whole = sum(sums.values())
    told = [(c, v if v <= _LONG else None, whole if whole <= _LONG else None) for c, v in sums.items()]
    frame = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long")  # k rows
    return table.filter("n is null").select("vec_id", "cluster", "distance").join(F.broadcast(frame), "cluster"), now.centers


def digest(center: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in center).encode()).hexdigest()


def clusters(embeddings: DataFrame, k: int = 8, rounds: int = 10, salt: int = 3, dims: int = 64, scale: int = 1024) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256`` of the usable vectors of ``embeddings``.

    Vectors that are null, have another length, or hold a null or a number that isn't finite get no row. Repeated rows each
    get one; a null vec_id is a row like another, and last among the seeds. A component beyond 2^52 is an error. Columns other than vec_id and embedding
    are not looked at.
    """
    rows, centers = cluster(integer_vectors(embeddings, dims, scale), k, rounds, salt)
    digests = rows.sparkSession.createDataFrame([(i, digest(c)) for i, c in enumerate(centers)], "cluster int, centroid_sha256 string")
    named = rows.join(F.broadcast(digests), "cluster")
    return named.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
