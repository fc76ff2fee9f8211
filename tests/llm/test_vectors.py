"""Clustering and whitening against plain versions."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowgate.llm import clustering, queries, whitening
from rowgate.llm.common import table

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, extra string"


def plain_kmeans(rows, k, rounds, salt=3):
    """All distances in whole numbers of any size."""
    x = [[int(np.floor(1024 * float(c))) for c in v] for _, v in rows]
    seeds = sorted(range(len(x)), key=lambda i: (hashlib.sha256(f"{salt}:{rows[i][0]}".encode()).hexdigest() if rows[i][0] is not None else "x", x[i]))[:k]
    centers = [x[i] for i in seeds]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centers)) for v in x]

    for _ in range(rounds):
        near = assigned()
        for n in range(len(centers)):
            mine = [v for v, (_, c) in zip(x, near, strict=True) if c == n]
            if mine:
                centers[n] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return sorted((rows[i][0] is not None, rows[i][0] or 0, c, d) for i, (d, c) in enumerate(assigned())), centers


def clustered(spark, rows, dims, k, rounds):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).withColumn("cluster", F.lit("clash")).repartition(3)
    found = clustering.clusters(df, k, rounds, dims=dims).collect()
    return sorted((r.vec_id is not None, r.vec_id or 0, r.cluster, r.distance) for r in found), found


@pytest.mark.parametrize("k, n, dims, spread", [(1, 9, 2, 1), (4, 60, 3, 1), (8, 200, 5, 0.01), (8, 5, 2, 1), (13, 300, 2, 1)])
def test_kmeans_against_plain(spark, k, n, dims, spread):
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(size=(n, dims)) * spread, 2)  # many ties
    rows = [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(values)]
    want, centers = plain_kmeans(rows, k, 6)
    got, found = clustered(spark, rows, dims, k, 6)
    assert got == want
    assert {r.cluster: r.centroid_sha256 for r in found}.items() <= {i: clustering.digest(c) for i, c in enumerate(centers)}.items()
    assert {r.inertia for r in found} == {sum(w[3] for w in want)}
    for c in {r.cluster for r in found}:
        assert {r.cluster_inertia for r in found if r.cluster == c} == {sum(w[3] for w in want if w[2] == c)}


def test_kmeans_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [5.0, 2.0]), (None, [0.5, -0.5]), (3, [1.0, 2.0]), (3, [7.0, 7.0])]
    bad = [(4, None), (5, [1.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [1.0, -inf]), (9, []), (10, [1.0, 2.0, 3.0])]
    want, _ = plain_kmeans(good, 3, 4)
    assert clustered(spark, good + bad, 2, 3, 4)[0] == want
    assert clustered(spark, bad, 2, 3, 4)[0] == [] and clustered(spark, [], 2, 3, 4)[0] == []


def test_kmeans_of_huge_components(spark):
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate([[1e12, 3.0], [1e12, 9.0], [-1e12, 0.5], [2.0, 1.0], [5.0, 1.0]])]
    want, _ = plain_kmeans(rows, 2, 3)
    assert clustered(spark, rows, 2, 2, 3)[0] == [(*w[:3], w[3] if w[3] < 1 << 63 else None) for w in want]


def test_bounds_save_work(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-50, 50, (300, 4)) + 4000 * c for c in rng.integers(-3, 3, (6, 4))])
    first = clustering.Round.of(x[:: len(x) // 6][:6].copy())
    n = len(x)
    held = first.assign(x, np.zeros(n, np.int64), np.ones(n, np.int64), np.full(n, np.inf), np.zeros(n))
    second = clustering.Round.of(first.centers + 1, first.centers)
    searched = []
    whole = clustering.Round.search
    monkeypatch.setattr(clustering.Round, "search", lambda self, x, a, b: searched.append(len(x)) or whole(self, x, a, b))
    again = second.assign(x, *held)
    assert (again[0] == ((x[:, None] - second.centers[None]) ** 2).sum(2).argmin(1)).all()
    assert sum(searched) < n // 20


# --- whitening ---


def spectrum(values, seed=0):
    """A symmetric matrix of these eigenvalues, in extended precision, and its eigenvectors."""
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values),) * 2))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (3 * np.eye(len(q)) - q.T @ q) / 2
    order = np.argsort(-np.array(values), kind="stable")
    q, v = q[:, order], np.array(values, np.longdouble)[order]
    a = (q * v) @ q.T
    return (a + a.T) / 2, v, q


CLOSE = [1 + 1e-9 * i for i in range(16)] + [2 + 1e-12 * i for i in range(4)] + [5.0, 7.0, 7.5]


@pytest.mark.parametrize("values", [[3.0], [4.0, 3.0], list(range(1, 41)), CLOSE, [2.0] * 5 + [1.0] * 9, [0.0] * 6 + [1.0, 2.0], [0.0] * 4])
def test_refined_eigenvectors(values):
    a, want, q = spectrum([float(v) for v in values])
    got, x = whitening.refined(a)
    assert np.abs(got - want).max() <= 1e-17 * max(1, want[0]) * len(want)
    assert np.abs(x.T @ x - np.eye(len(x))).max() < 1e-17 * len(x) and np.abs(a @ x - x * got).max() < 1e-17 * len(x) * max(1, want[0])
    if len(set(values)) == len(values):
        gap = min(np.abs(np.diff(want)), default=1) / want[0]
        assert (1 - np.abs((x * q).sum(0))).max() < (1e-17 / gap) ** 2 + 1e-15


def test_single_precision_alone_isnt_enough():
    a, _, q = spectrum(CLOSE)
    rough = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1]
    assert (1 - np.abs((rough * q).sum(0))).max() > 0.01


def whitened(spark, rows, dims, most=32, scale=64):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).withColumn("component", F.lit("clash")).repartition(3)
    return whitening.components(df, most, dims, scale).collect()


def test_whitening_against_plain(spark):
    rng = np.random.default_rng(2)
    values = (rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6))).astype(np.float32)
    got = whitened(spark, [(i, [float(c) for c in v]) for i, v in enumerate(values)], 6, 4)
    x = np.floor(64 * values.astype(float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(0)
    cov = np.cov(x - total / n, rowvar=False, bias=True)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    want = (x - total / n) @ u / np.sqrt(e)
    table_ = np.full((n, 4), np.nan)
    for r in got:
        table_[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == ((n * x[r.vec_id] - total) ** 2).sum() and r.identity_error < 1e-10
        assert r.explained == pytest.approx(e[r.component - 1] / np.trace(cov), rel=1e-10)
    sign = np.sign((table_ * want[:, :4]).sum(0))
    assert len(got) == 4 * n and np.abs(table_ * sign - want[:, :4]).max() < 1e-9


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (None, [4.0, 2.0, -3.0]), (2, [0.0, 2.0, 1.0]), (3, [-5.0, 2.0, 9.0])]
    bad = [(4, None), (5, [1.0, None, 2.0]), (6, [nan, 1.0, 1.0]), (7, [1.0, inf, 1.0]), (8, []), (9, [1.0])]
    got = whitened(spark, good + bad, 3)
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((i or 0, c) for i, _ in good for c in (1, 2, 3))
    assert all((r.whitened is None) == (r.component == 3) for r in got)  # the second dimension is constant
    assert {r.explained for r in got if r.component == 3} == {0.0} and got[0].identity_error < 1e-12
    assert sum(r.whitened**2 for r in got if r.component == 1) == pytest.approx(5)
    one = whitened(spark, [(1, [1.0, 2.0])], 2)
    assert [(r.whitened, r.explained, r.deviation, r.identity_error) for r in one] == [(None, 0.0, 0, 0.0)] * 2
    assert whitened(spark, bad, 3) == [] and whitened(spark, [], 3) == []


def test_whitening_of_large_numbers(spark):
    values = [[1e15, 0.0], [-1e15, 1.0], [3e15, 2.0]]
    got = whitened(spark, list(enumerate(values)), 2, scale=1)
    x = [[int(np.float32(c)) + 1_000_000 for c in v] for v in values]
    total = [sum(c) for c in zip(*x, strict=True)]
    exact = [sum((3 * a - t) ** 2 for a, t in zip(v, total, strict=True)) for v in x]
    assert {r.vec_id: r.deviation for r in got} == {i: v if v < 1 << 63 else None for i, v in enumerate(exact)}
    assert got[0].identity_error < 1e-9


def test_whitening_of_the_given_tables(spark):
    df = queries.op12_embedding_whitening(spark, DATA)
    rows = table(spark, DATA, "embeddings").collect()
    x = np.floor(64 * np.array([r.embedding for r in rows])).astype(np.int64) + 1_000_000
    got = {(r.vec_id, r.component): r for r in df.collect()}
    assert len(got) == 32 * len(rows)
    c = (x - x.mean(0)) @ np.linalg.eigh(np.cov(x, rowvar=False, bias=True))[1][:, ::-1][:, :32]
    c = c / c.std(0)
    w = np.array([[got[r.vec_id, k + 1].whitened for k in range(32)] for r in rows])
    assert np.abs(np.abs(w) - np.abs(c)).max() < 1e-6
    assert all(got[r.vec_id, 1].deviation == int(d) for r, d in zip(rows, ((len(x) * x - x.sum(0)) ** 2).sum(1), strict=True))
