import gzip
import json

from pyspark.sql import functions as F

from rowgate.contract import Contract
from rowgate.plans import file_queries
from rowgate.sinks.tables import Table, conform, quarantine, reason_json, replace_batch, write_jdbc, write_rejects
from rowgate.sources import files
from rowgate.sources.tables import read_jdbc
from rowgate.streaming.files import OrderStream, health, windowed
from tests.test_ladder import AS_OF, BASE


def write(folder, name, texts):
    (folder / name).write_text("".join(t + "\n" for t in texts))


def test_lines_numbers_and_blanks(spark, tmp_path):
    write(tmp_path, "a.json", ['{"order_id": "1"}', "", "junk", '{"order_id": "2", "extra": 1}'])
    got = files.read_ndjson(spark, str(tmp_path)).orderBy("source_line_no").collect()
    assert [(r.source_line_no, r.order_id, r.parse_status) for r in got] == [(1, "1", "OK"), (3, None, "PARSE_ERROR"), (4, "2", "OK")]
    whole = files.read_ndjson(spark, str(tmp_path), "fail_file")
    assert {r.parse_status for r in whole.collect()} == {"READER_FAILURE"}


def test_delimited(spark, tmp_path):
    (tmp_path / "r.txt").write_bytes("1.5\tGBP\tcaf\u20ac\r\nx\tEUR\tb\r\n".encode("windows-1252"))
    good, bad = files.read_delimited(spark, str(tmp_path / "r.txt"), [("rate", "double"), ("code", "string"), ("name", "string")], "\t", encoding="windows-1252", row_end="\r\n")
    assert [tuple(r) for r in good.collect()] == [(1.5, "GBP", "caf\u20ac")] and [r._corrupt_record for r in bad.collect()] == ["x\tEUR\tb"]
    assert (good.select("code").count(), bad.count()) == (1, 1)
    lines = spark.createDataFrame([("a;b|c",)], "value string")
    assert tuple(files.split_columns(lines, [("x", ";"), ("y", "|"), ("z", "\n")]).first()) == ("a", "b", "c")


def test_listing_finds_empty_files(spark, tmp_path):
    write(tmp_path, "a.json", ["{}"])
    (tmp_path / "b.json").write_text("")
    listing = files.list_files(spark, str(tmp_path))
    assert [r.source_file for r in files.empty_files(listing).collect()] == ["b.json"]
    ledger = spark.createDataFrame([("a.json",)], "source_file string")
    assert [r.source_file for r in files.pending(listing, ledger).collect()] == ["b.json"]
    dead = files.dead_letters(spark, str(tmp_path), ledger).collect()
    assert [(r.source_file, r.raw_payload) for r in dead] == [("b.json", "<empty file>")]


def test_versioned_table(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), "k int, v string")
    assert t.read().count() == 0
    t.append(spark.createDataFrame([(1, "a")], "k int, v string"))
    t.upsert(spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string"), ["k"])
    t.insert_new(spark.createDataFrame([(2, "x"), (3, "d")], "k int, v string"), ["k"])
    assert sorted(tuple(r) for r in t.read().collect()) == [(1, "b"), (2, "c"), (3, "d")]
    t.retain(F.col("k") > 1)
    assert t.read().count() == 2
    t.reset()
    assert t.read().count() == 0


def test_batches_are_replaced(spark, tmp_path):
    path = str(tmp_path / "b")
    replace_batch(spark.createDataFrame([(1, "x"), (2, "x")], "v int, etl_batch_id string"), path)
    replace_batch(spark.createDataFrame([(3, "y")], "v int, etl_batch_id string"), path)
    replace_batch(spark.createDataFrame([(9, "x")], "v int, etl_batch_id string"), path)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [3, 9]


def test_conform_and_rejects(spark, tmp_path):
    target = spark.createDataFrame([], "id int, name string, gone date")
    out = conform(spark.createDataFrame([("7", "n", 1)], "ID string, NAME string, other int"), target, "lower")
    assert [tuple(r) for r in out.collect()] == [(7, "n", None)]
    rejects = spark.createDataFrame([("A", "raw"), ("A", "raw"), ("B", "raw")], "reason string, raw_line string")
    assert quarantine(rejects).first().raw_payload == "raw"
    assert json.loads(reason_json(rejects).first().reasons) == {"A": 2, "B": 1}
    for _ in range(2):
        write_rejects(rejects, str(tmp_path / "rej"))
    assert spark.read.json(str(tmp_path / "rej")).count() == 6


def test_stream_equals_batch_and_replay_changes_nothing(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    products = spark.createDataFrame([("SKU-0001", "toys")], "sku string, category string")
    customers = spark.createDataFrame([("CUST-00001",)], "customer_id string")
    write(landing, "one.json", [json.dumps(BASE), json.dumps(BASE | {"line_no": 2, "qty": "two"}), "junk"])
    stream = OrderStream(spark, str(tmp_path / "out"), products, customers, Contract(), AS_OF)
    stream.start(str(landing), str(tmp_path / "cp")).awaitTermination()
    write(landing, "two.json", [json.dumps(BASE), json.dumps(BASE | {"order_id": "ORD-2"})])
    stream.start(str(landing), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.order_id, r.line_no, r.source_file) for r in stream.read("items").collect()) == [("ORD-1", 1, "one.json"), ("ORD-2", 1, "two.json")]
    assert sorted((r.source_file, r.reason) for r in stream.read("rejects").collect()) == [("one.json", "PARSE_ERROR"), ("one.json", "PARSE_ERROR"), ("two.json", "DUP_KEY")]
    ledger = {r.source_file: (r.records_valid, r.records_invalid, r.status) for r in stream.read("ledger").collect()}
    assert ledger == {"one.json": (1, 2, "PARTIAL"), "two.json": (1, 1, "PARTIAL")}
    # a retried micro-batch replaces what its first try wrote
    last = stream.loads("items").agg(F.max("load_no")).first()[0]
    lines = files.read_lines(spark, str(landing / "two.json"))
    stream.load(lines, last)
    assert stream.read("items").count() == 2 and stream.read("rejects").count() == 3
    one = health(files.list_files(spark, str(landing)), stream.read("ledger")).first()
    assert (one.pending_files, one.files_done, one.failed_files, one.last_file) == (0, 2, 0, "two.json")


def streamed(spark, tmp_path, **options):
    products = spark.createDataFrame([("SKU-0001", "toys")], "sku string, category string")
    customers = spark.createDataFrame([("CUST-00001",)], "customer_id string")
    landing = tmp_path / "landing"
    landing.mkdir()
    return landing, OrderStream(spark, str(tmp_path / "out"), products, customers, Contract(), AS_OF, **options)


def test_failed_files_are_recorded_and_parked(spark, tmp_path):
    landing, stream = streamed(spark, tmp_path, on_bad_line="fail_file")
    write(landing, "bad.json", [json.dumps(BASE), "{not json", json.dumps(BASE | {"line_no": 2})])
    (landing / "empty.json").write_text("")
    write(landing, "good.json", [json.dumps(BASE | {"order_id": "ORD-9", "line_total": 40})])
    stream.start(str(landing), str(tmp_path / "cp"), files_per_batch=10).awaitTermination()
    ledger = {r.source_file: r for r in stream.read("ledger").collect()}
    assert {k: (r.records_valid, r.records_invalid, r.status) for k, r in ledger.items()} == {
        "bad.json": (0, 3, "FAILED"), "empty.json": (0, 0, "FAILED"), "good.json": (1, 0, "SUCCESS")
    }
    assert ledger["empty.json"].error_text == "<empty file>" and "can't be read" in ledger["bad.json"].error_text and ledger["good.json"].error_text is None
    assert all(r.duration_ms >= 0 and r.started_at <= r.finished_at for r in ledger.values())
    assert {r.reason for r in stream.read("rejects").collect()} == {"READER_FAILURE"}
    item = stream.read("items").first()
    assert (item.order_id, item.quality_status, float(item.line_total), float(item.line_total_fixed)) == ("ORD-9", "CLEANED", 40.0, 31.5)
    parked = tmp_path / "out" / "parked"
    assert (parked / "bad.json").read_bytes() == (landing / "bad.json").read_bytes() and (parked / "empty.json").read_bytes() == b""
    assert not (parked / "good.json").exists()
    one = stream.read("health").first()
    assert (one.pending_files, one.files_done, one.failed_files, one.last_file, one.last_status, one.last_error) == (0, 3, 2, "good.json", "SUCCESS", "<empty file>")


def test_a_replayed_file_keeps_its_status(spark, tmp_path):
    landing, stream = streamed(spark, tmp_path)
    write(landing, "a.json", [json.dumps(BASE)])
    lines = files.read_lines(spark, str(landing))
    stream.load(lines, 0)
    stream.load(lines, 1)
    assert [(r.records_valid, r.records_invalid, r.status) for r in stream.read("ledger").collect()] == [(0, 1, "FAILED")]
    assert [(r.records_valid, r.records_invalid, r.status, r.loads) for r in stream.accumulated().collect()] == [(1, 1, "SUCCESS", 2)]


def test_orders_of_several_loads_count_once(spark, tmp_path):
    landing, stream = streamed(spark, tmp_path)
    for load, line in enumerate((1, 2, 2)):
        write(landing, "a.json", [json.dumps(BASE | {"line_no": line}), json.dumps(BASE | {"order_id": f"ORD-{load}x"})])
        stream.load(files.read_lines(spark, str(landing)), load)
    one = stream.accumulated().first()
    assert (one.records_valid, one.orders_loaded, one.orders, one.loads) == (5, 5, 4, 3)


def test_an_outage_loses_and_doubles_nothing(spark, tmp_path):
    landing, stream = streamed(spark, tmp_path)
    for n in range(3):
        write(landing, f"f{n}.json", [json.dumps(BASE | {"order_id": f"ORD-{n}"}), json.dumps(BASE | {"order_id": f"ORD-{n}", "qty": 0})])
    real, left = stream._write, [2]

    def write_or_fail(name, df, load_no):
        if name == "orders" and left[0]:
            left[0] -= 1
            raise OSError("the store is away")
        real(name, df, load_no)

    stream._write = write_or_fail
    for _ in range(3):
        try:
            stream.start(str(landing), str(tmp_path / "cp")).awaitTermination()
        except Exception:  # noqa: BLE001, S110
            pass
    assert not left[0] and sorted(r.order_id for r in stream.read("items").collect()) == ["ORD-0", "ORD-1", "ORD-2"]
    assert stream.read("rejects").count() == 3 and stream.read("ledger").count() == 3


def test_line_numbers_of_a_file_in_blocks(spark, tmp_path):
    write(tmp_path, "long.json", ["" if i % 7 == 0 else json.dumps({"order_id": str(i)}) for i in range(1, 4001)])
    write(tmp_path, "short.json", ['{"order_id": "1"}'])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = files.read_ndjson(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(int(r.order_id) for r in got if r.source_file == "long.json") == [i for i in range(1, 4001) if i % 7]
    assert all(int(r.order_id) == r.source_line_no for r in got)


def test_database_round_trip(spark):
    """Against the database that comes with Spark, in memory."""
    url = "jdbc:derby:memory:rowgate;create=true"
    rows = spark.range(1200).selectExpr("id AS k", "concat('n', id % 7) AS name", "cast(id / 4 AS decimal(14,2)) AS amount")
    write_jdbc(rows, url, "items", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    write_jdbc(rows.filter("k < 10"), url, "items", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    back = read_jdbc(spark, url, "items", ["k", "amount"], "k", (0, 1200), 3, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert back.columns == ["k", "amount"] and back.rdd.getNumPartitions() == 3
    assert tuple(back.agg(F.count("*"), F.sum("k")).first()) == (1210, 719_400 + 45) and back.filter("k = 1000").count() == 1


def test_windowed_stream(spark, tmp_path):
    source = tmp_path / "ev"
    spark.createDataFrame([(0, 1), (30, 2), (70, 4)], "s int, v int").select(F.timestamp_seconds("s").alias("ts"), "v").write.parquet(str(source))
    stream = spark.readStream.schema("ts timestamp, v int").parquet(str(source))
    query = windowed(stream, "ts", "1 minute", "10 minutes", [], F.sum("v").alias("total")).writeStream.format("memory").queryName("w").outputMode("complete")
    query.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.total for r in spark.table("w").collect()) == [3, 4]


def test_dead_letters_read_no_more_than_they_show(spark, tmp_path):
    with open(tmp_path / "huge.json", "wb") as f:
        f.write("é".encode() * 5000)
        f.truncate(3 << 30)  # holes: no disk, but more than a row may have
    (tmp_path / "small.json").write_text("one\r\ntwo\n")
    rows = {r.source_file: r.raw_payload for r in files.dead_letters(spark, str(tmp_path), spark.createDataFrame([], "source_file string")).collect()}
    assert rows == {"huge.json": "é" * 4000, "small.json": "one\r\ntwo\n"}


def test_whole_files_are_written_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(file_queries, "scratch_path", lambda spark: str(tmp_path / "w"))
    one = file_queries.source_files_on_disk(spark, "/root/testdata/sf0.001", 1000).first()
    assert one.lines > 1000 and one.same_listed_bytes and one.same_read_bytes and one.same_content_bytes
    assert max(len(p.read_text().splitlines()) for p in (tmp_path / "w").glob("*.txt")) == 1000


def test_lines_are_numbered_where_they_are_read(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.json").write_text("".join(f"{name}{i}\n" if i % 7 else "\n" for i in range(1, 3001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = files.read_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 4
        found = rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(tuple(r) for r in found) == sorted((f"{n}{i}", f"{n}.json", i) for n in "ab" for i in range(1, 3001) if i % 7)
    assert "SortMergeJoin" not in plan


def test_quarantined_text_is_the_record_and_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(file_queries, "scratch_path", lambda spark: str(tmp_path / "w"))
    back = file_queries.sink_quarantine(spark, "/root/testdata/sf0.001")
    assert back.count() > 1 and {p.suffix for p in (tmp_path / "w").glob("part-*")} == {".gz"}
    assert set(json.loads(spark.read.json(str(tmp_path / "w")).first().raw_payload)) <= set(file_queries.LINE)


def test_packed_dead_letters_are_unpacked_as_far_as_shown(spark, tmp_path, monkeypatch):
    (tmp_path / "long.json.gz").write_bytes(gzip.compress(b"x" * 10_000_000))
    (tmp_path / "broken.json.gz").write_text("no packed file")
    (tmp_path / "none.json.gz").write_bytes(gzip.compress(b""))
    rows = {r.source_file: r.raw_payload for r in files.dead_letters(spark, str(tmp_path), spark.createDataFrame([], "source_file string")).collect()}
    assert rows == {"long.json.gz": "x" * 4000, "broken.json.gz": "no packed file", "none.json.gz": "<empty file>"}
    monkeypatch.setattr(file_queries, "scratch_path", lambda spark: str(tmp_path / "w"))
    one = file_queries.source_dead_letters(spark, "/root/testdata/sf0.001").first()
    assert (one.n, one.longest) == (5, 4000) and len(list((tmp_path / "w").glob("*.txt.gz"))) == 5
