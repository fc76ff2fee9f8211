"""Bucketed tables: what a write touches, versions, change feeds."""

import random

import pytest
from pyspark.sql import functions as F

from rowgate.sinks.buckets import BucketTable, ChangeTable, WriteConflictError, net_changes

SCHEMA = "k bigint, v string, n int"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def of(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=16)
    t.upsert(spark.range(400).selectExpr("id AS k", "'old' AS v", "1 AS n"))
    before = t.folders()
    files = {b: sorted(p.name for p in (tmp_path / "t" / "data" / f).glob("*.parquet")) for b, f in before.items()}
    assert len(before) == 16 and t.version() == 1
    changed = rows(spark, (7, "new", 2), (5000, "new", 3))
    touched = {r.b for r in changed.select(t.bucket().alias("b")).collect()}
    assert t.upsert(changed) == 2
    after = t.folders()
    assert {b for b in after if after[b] != before.get(b)} == touched and 1 <= len(touched) <= 2
    assert all(sorted(p.name for p in (tmp_path / "t" / "data" / after[b]).glob("*.parquet")) == files[b] for b in after if b not in touched)
    got = {r.k: r.v for r in t.read().collect()}
    assert len(got) == 401 and {k for k, v in got.items() if v == "new"} == {7, 5000}
    assert t.read(version=1).count() == 400
    assert {r.k for r in t.find(rows(spark, (7, None, None), (9999, None, None))).collect()} == {7}


def test_against_a_dictionary(spark, tmp_path):
    rng, want = random.Random(3), {}
    t = BucketTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=5, parts=2)
    for step in range(6):
        some = [(rng.choice([None, *range(12)]), f"s{step}", rng.randint(0, 99)) for _ in range(8)]
        newest = {k: (k, v, n) for k, v, n in sorted(some, key=lambda r: r[2])}
        if step % 3 == 2:
            t.delete(rows(spark, *some))
            want = {k: r for k, r in want.items() if k not in newest}
        elif step % 3 == 1:
            t.insert_new(rows(spark, *some), ["n"])
            want = newest | want
        else:
            t.upsert(rows(spark, *some), ["n"])
            want |= newest
        assert {r[0]: r[2] for r in of(t)} == {k: r[2] for k, r in want.items()}
    assert t.upsert(rows(spark)) == t.version()


def test_conflicts_and_failures_leave_one_version(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = BucketTable(spark, path, SCHEMA, ["k"], 4), BucketTable(spark, path, SCHEMA, ["k"], 4)
    one.upsert(rows(spark, (1, "a", 1)))
    stale = two._manifest()
    one.upsert(rows(spark, (2, "b", 1)))
    two._manifest = lambda version=None: stale
    with pytest.raises(WriteConflictError):
        two.upsert(rows(spark, (3, "c", 1)))
    assert of(one) == [(1, "a", 1), (2, "b", 1)]
    (tmp_path / "t" / "manifests" / "3.json").write_text('{"1": ')  # a writer died
    assert one.version() == 2
    with pytest.raises(Exception, match="boom"):
        one.upsert(rows(spark, (4, "d", 1)).withColumn("v", F.raise_error(F.lit("boom"))))
    assert of(one) == [(1, "a", 1), (2, "b", 1)]


def test_vacuum(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], 4)
    for n in range(4):
        t.upsert(rows(spark, *((k, f"v{n}", n) for k in range(20))))
    assert t.vacuum(1) == 12 and t.vacuum(1) == 0
    assert {r[1] for r in of(t)} == {"v3"} and len(list((tmp_path / "t" / "manifests").glob("*.json"))) == 1


FEED = "op string, seq bigint, k bigint, v string"


def test_changes_in_any_order(spark, tmp_path):
    rng = random.Random(5)
    changes, alive = [], set()
    for seq in range(120):
        k = rng.randint(0, 14)
        op = "I" if k not in alive else rng.choice("UUD")
        alive = alive - {k} if op == "D" else alive | {k}
        changes.append((op, seq, k, None if op == "D" else f"v{seq}"))
    want = {}
    for op, _, k, v in changes:
        want.pop(k, None) if op == "D" else want.update({k: v})
    mixed = changes + changes[10:30]  # some come twice
    rng.shuffle(mixed)
    t = ChangeTable(spark, str(tmp_path / "t"), "k bigint, v string", ["k"], "seq", buckets=4)
    for at in range(0, len(mixed), 35):
        t.apply(spark.createDataFrame(mixed[at : at + 35], FEED))
    assert {r.k: r.v for r in t.current().collect()} == want
    assert t.current().columns == ["k", "v"] and t.read().count() == len({c[2] for c in changes})
    assert t.purge(60) and {r.k: r.v for r in t.current().collect()} == want
    assert t.read().filter("_deleted and seq < 60").count() == 0
    with pytest.raises(Exception, match="isn't I, U or D"):
        t.apply(spark.createDataFrame([("X", 999, 1, "v")], FEED))
    net = {r.k: (r.op, r.v) for r in net_changes(spark.createDataFrame(changes, FEED), ["k"], "seq").collect()}
    assert net == {k: ("I", v) for k, v in want.items()}


@pytest.mark.parametrize("ops, net", [("I", "I"), ("IU", "I"), ("IUD", None), ("U", "U"), ("UD", "D"), ("D", "D"), ("DI", "U"), ("DIU", "U"), ("UDI", "U"), ("IDI", "I")])
def test_net_change(spark, ops, net):
    feed = spark.createDataFrame([(op, n, 1, f"v{n}") for n, op in enumerate(ops)], FEED)
    got = [(r.op, r.seq, r.v) for r in net_changes(feed, ["k"], "seq").collect()]
    assert got == ([] if net is None else [(net, len(ops) - 1, f"v{len(ops) - 1}")])
