"""Keys of all history, recovery without help, and what the engine says of runs."""

import gzip
import json
import os
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from rowgate.contract import Contract
from rowgate.streaming import files as stream_files
from rowgate.streaming.files import OrderStream
from rowgate.streaming.seen import SeenKeys
from rowgate.streaming.supervise import RunHistory, supervise
from tests.test_ladder import AS_OF, BASE


def test_a_load_costs_the_same_after_fifty(spark, tmp_path):
    seen = SeenKeys(spark, str(tmp_path / "seen"), "k string, n int", partitions=2)
    try:
        for load in range(50):
            rows = spark.range(load * 100, load * 100 + 100).selectExpr("concat('k', id) AS k", "cast(id % 3 AS int) AS n", "'x' AS other")
            again = spark.createDataFrame([("k5", 2), ("k5", 0), (None, None)], "k string, n int")
            got = sorted((str(r.k), r.n) for r in seen.earlier(rows.select("k", "n").unionByName(again), load).collect())
            assert got == ([] if load == 0 else [("None", None), ("k5", 0), ("k5", 2)])
        told = [p for p in seen.query.recentProgress if p["numInputRows"]]
        assert len(told) == 50 and all(p["numInputRows"] in (102, 103) and p["stateOperators"][0]["numRowsUpdated"] in (102, 103) for p in told)
        assert told[-1]["stateOperators"][0]["numRowsTotal"] == 5000 + 2
    finally:
        seen.close()


def test_state_outlives_its_query(spark, tmp_path):
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    seen = SeenKeys(spark, str(tmp_path / "seen"), "k string", partitions=2)
    assert seen.earlier(keys("a", "b"), 0).count() == 0 and seen.earlier(keys(), 1).count() == 0
    assert [r.k for r in seen.earlier(keys("b", "c"), 1).collect()] == ["b"]
    seen.close()
    later = SeenKeys(spark, str(tmp_path / "seen"), "k string", partitions=2)
    assert sorted(r.k for r in later.earlier(keys("a", "c", "d"), 2).collect()) == ["a", "c"]
    assert [r.k for r in later.earlier(keys("b", "c"), 1).collect()] == ["b"]  # repeated: as the first time
    assert later.earlier(keys("a", "d"), 0).count() == 0
    later.close()


def streamed(spark, tmp_path):
    products = spark.createDataFrame([("SKU-0001", "toys")], "sku string, category string")
    customers = spark.createDataFrame([("CUST-00001",)], "customer_id string")
    landing = tmp_path / "landing"
    landing.mkdir()
    return landing, OrderStream(spark, str(tmp_path / "out"), products, customers, Contract(), AS_OF)


def put(landing, name, *orders):
    (landing / name).write_text("".join(json.dumps(BASE | {"order_id": o}) + "\n" for o in orders))


def test_an_outage_is_over_without_help(spark, tmp_path):
    landing, stream = streamed(spark, tmp_path)
    for n in range(3):
        put(landing, f"f{n}.json", f"ORD-{n}", "ORD-0")
    real, left, waits = stream._write, [3], []

    def away(name, df, load_no):
        if name == "orders" and left[0] and load_no == 1:
            left[0] -= 1
            raise OSError("the store is away")
        real(name, df, load_no)

    stream._write = away
    history = RunHistory(spark)
    try:
        supervise(lambda: stream.start(str(landing), str(tmp_path / "cp")), wait=waits.append)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        assert waits == [1.0, 2.0, 4.0]
        assert sorted(r.order_id for r in stream.read("items").collect()) == ["ORD-0", "ORD-1", "ORD-2"]
        assert [r.reason for r in stream.read("rejects").collect()] == ["DUP_KEY"] * 3
        one = history.health().filter("query is null").first()
        assert (one.state, one.failures) == ("ENDED", 3) and one.batches >= 3 and "store is away" in str([r.error for r in history.history().filter("event = 'failed'").collect()])
    finally:
        history.close()
        stream.close()


def test_an_outage_that_lasts_is_raised(spark, tmp_path):
    landing, stream = streamed(spark, tmp_path)
    put(landing, "a.json", "ORD-1")

    def away(name, df, load_no):
        raise OSError("the store is away")

    stream._write, waits = away, []
    with pytest.raises(StreamingQueryException):
        supervise(lambda: stream.start(str(landing), str(tmp_path / "cp")), tries=4, longest=3.0, wait=waits.append)
    assert waits == [1.0, 2.0, 3.0]
    stream.close()


def test_a_stream_that_hangs_is_stalled(spark, tmp_path):
    history = RunHistory(spark, names={"slow"})
    (tmp_path / "in").mkdir()
    spark.range(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    query = rows.groupBy().agg(F.count("*").alias("n")).writeStream.queryName("slow").outputMode("complete").format("memory").start()
    try:
        query.processAllAvailable()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        now = history.health().first()
        assert (now.query, now.state, now.input_rows, now.batches) == ("slow", "RUNNING", 3, 1)
        assert history.health(datetime.now(UTC) + timedelta(minutes=5)).first().state == "STALLED"
    finally:
        query.stop()
        history.close()


def test_packed_files_are_loaded_with_their_texts(spark, tmp_path):
    landing, stream = streamed(spark, tmp_path)
    lines = [json.dumps(BASE), json.dumps(BASE | {"line_no": "2", "qty": "0"}), '{"order_id":"ORD-7","line_no":"3"}', '{"order_id":"ORD-7 ","line_no":"3"}', "junk"]
    for name, text in (("a.json.gz", "\n".join(lines) + "\n"), ("none.json.gz", "")):
        (landing / name).write_bytes(gzip.compress(text.encode()))
    stream.start(str(landing), str(tmp_path / "cp"), files_per_batch=10).awaitTermination()
    stream.close()
    assert sorted(r.raw_payload for r in stream.read("rejects").collect()) == sorted(lines[1:])
    assert {(r.source_file, r.status, r.error_text) for r in stream.read("ledger").collect()} >= {("none.json.gz", "FAILED", "<empty file>")}
    assert [r.batch_id for r in stream.read("items").collect()] == ["a"]
    assert all(f.endswith(".zstd.parquet") for f in stream.read("rejects").inputFiles())


def test_a_further_try_does_not_judge_the_lines_again(spark, tmp_path, monkeypatch):
    landing, stream = streamed(spark, tmp_path)
    for n in range(2):
        put(landing, f"f{n}.json", f"ORD-{n}", "ORD-0")
    calls, kept, real, tried, decide = [], [], stream._write, set(), stream_files.decide
    monkeypatch.setattr(stream_files, "decide", lambda *a: calls.append(1) or decide(*a))

    def away(name, df, load_no):
        kept.append(stream._kept[1])
        if name == "ledger" and load_no not in tried:
            tried.add(load_no)
            raise OSError("the store is away")
        real(name, df, load_no)

    stream._write = away
    supervise(lambda: stream.start(str(landing), str(tmp_path / "cp")), wait=lambda seconds: None)
    stream.close()
    assert len(tried) == len(calls) == len(set(kept)) == 2 and not any(os.path.exists(k) for k in kept)
    assert sorted(r.order_id for r in stream.read("items").collect()) == ["ORD-0", "ORD-1"]
    assert [r.detail for r in stream.read("rejects").collect()] == ["ORD-0#1"] * 2
