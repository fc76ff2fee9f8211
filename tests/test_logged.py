"""Counts taken by the write itself, sketches of ledgers, exported columns, flat files by their description."""

import hashlib

import pytest
from pyspark.sql import functions as F

from rowgate.operators import rollup
from rowgate.sinks.logged import export_column, logged_split, logged_write
from rowgate.sources import files
from rowgate.sources.tables import read_whole_files


def test_a_logged_write_reads_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    df = spark.range(100).mapInArrow(counted, "id long").withColumn("odd", F.col("id") % 2 == 1)
    log = logged_write(df, str(tmp_path / "t"), "b1", "load", {"odd": F.col("odd"), "none": F.lit(None).cast("boolean")})
    got = {r.measure: r.value for r in log.collect()}
    assert got == {"rows": 100, "odd": 50, "none": 0} and reads.value == 100
    assert spark.read.parquet(str(tmp_path / "t")).count() == 100
    first = log.first()
    assert (first.batch_id, first.stage) == ("b1", "load") and first.duration_ms >= 0
    assert {r.measure: r.value for r in logged_write(df.filter("id < 0"), str(tmp_path / "none"), "b1", "load").collect()} == {"rows": 0}


def test_a_logged_split_accounts_for_every_row(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "a")], "k int, v string")
    outputs, log = logged_split(df, [("a", F.col("v") == "a"), ("never", F.col("k") > 9)], str(tmp_path / "t"), "b", "s", "rest")
    assert {n: sorted(r.k for r in o.collect()) for n, o in outputs.items()} == {"a": [1, 4], "never": [], "rest": [2, 3]}
    assert {r.measure: r.value for r in log.collect()} == {"rows": 4, "a": 2, "never": 0, "rest": 2, "unaccounted": 0}
    assert all(o.columns == ["k", "v"] for o in outputs.values())
    with pytest.raises(ValueError):
        logged_split(df, [("rest", F.lit(True))], str(tmp_path / "u"), "b", "s", "rest")


def test_distinct_orders_add_up_without_their_lines(spark):
    lines = spark.range(30_000).selectExpr("concat('f', id % 3) AS source_file", "concat('o', id % 9000) AS order_id", "if(id % 10 = 0, 'X', null) AS reason", "'1.50' AS line_total", "id % 2 AS load")
    loads = [rollup.with_sketch(lines.filter(F.col("load") == n)) for n in (0, 1)]
    got = {r.source_file: r for r in rollup.merged(loads[0].unionByName(loads[1])).collect()}
    want = {r.source_file: r for r in rollup.per_file(lines).collect()}
    assert set(got) == set(want)
    for f, r in got.items():
        assert (r.lines_in, r.lines_clean, r.lines_rejected, r.revenue) == (want[f].lines_in, want[f].lines_clean, want[f].lines_rejected, want[f].revenue)
        assert abs(r.orders - want[f].orders_loaded) <= 0.07 * want[f].orders_loaded
    once = rollup.merged(loads[0]).unionByName(rollup.merged(loads[1]))
    assert {r.source_file: r.orders for r in rollup.merged(once).collect()} == {f: r.orders for f, r in got.items()}  # in any order


def test_export_and_import(spark, tmp_path):
    body = {"a.bin": bytes(range(256)), "deep/er/b.txt": "é\n".encode(), "empty": b"", "big": b"x" * 3_000_000}
    df = spark.createDataFrame([*body.items(), (None, b"x"), ("gone", None)], "name string, body binary").repartition(3)
    for _ in range(2):  # again: the same files
        told = {r.file: (r.bytes, r.sha256) for r in export_column(df, str(tmp_path / "out"), "name", "body").collect()}
        assert told == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in body.items()}
    found = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == body
    assert {r.source_file for r in read_whole_files(spark, str(tmp_path / "out"), "*.bin").collect()} == {"a.bin"}
    with pytest.raises(ValueError, match="several rows"):
        export_column(df.unionByName(df), str(tmp_path / "twice"), "name", "body")
    for name in ("../out.txt", "/etc/x", "a//b", "a/"):
        with pytest.raises(Exception, match="not a file's name"):
            export_column(spark.createDataFrame([(name, b"x")], "name string, body binary"), str(tmp_path / "bad"), "name", "body").collect()


def flat(spark, path, *args, **options):
    good, bad = files.read_flat_file(spark, str(path), *args, **options)
    return sorted(tuple(r) for r in good.collect()), sorted(r._corrupt_record for r in bad.collect())


def test_row_end_from_the_last_column(spark, tmp_path):
    (tmp_path / "crlf.txt").write_bytes(b"1,a\r\n2,b\r\nx,c\r\n")
    columns = [("k", "int", ","), ("v", "string", "_x000D__x000A_")]
    assert flat(spark, tmp_path / "crlf.txt", columns) == ([(1, "a"), (2, "b")], ["x,c"])
    (tmp_path / "bar.txt").write_bytes(b"1\ta|2\tb\nc|")
    assert flat(spark, tmp_path / "bar.txt", [("k", "int", "_x0009_"), ("v", "string", "|")]) == ([(1, "a"), (2, "b\nc")], [])
    assert files.plain("_x000D__x000A_;_x007C_") == "\r\n;|"


@pytest.mark.parametrize("rows", [0, 1, 2, 3])
def test_header_rows_of_several_files(spark, tmp_path, rows):
    for n in range(3):
        (tmp_path / f"f{n}.txt").write_text("".join(f"title{i},x\n" for i in range(rows)) + "".join(f"{n * 10_000 + i},v\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # files in blocks
    try:
        got, bad = flat(spark, tmp_path, [("k", "int", ","), ("v", "string", "\n")], header_rows=rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [k for k, _ in got] == [n * 10_000 + i for n in range(3) for i in range(3000)] and bad == []


def test_columns_with_delimiters_of_their_own(spark, tmp_path):
    (tmp_path / "m.txt").write_bytes(b"head;er|x\r\n\r\n1;a|2.5\r\n2;|\r\nno delimiters\r\nx;b|1\r\n")
    columns = [("k", "int", ";"), ("v", "string", "|"), ("d", "double", "")]
    got = flat(spark, tmp_path / "m.txt", columns, row_end="_x000D__x000A_", header_rows=1)
    assert got == ([(1, "a", 2.5), (2, None, None)], ["no delimiters", "x;b|1"])
    with pytest.raises(ValueError):
        files.read_flat_file(spark, str(tmp_path / "m.txt"), columns, code_page=1252)


def test_qualifier_and_code_page(spark, tmp_path):
    (tmp_path / "q.txt").write_bytes('title\tx\r\nsub\ty\r\n"a\tb"\t1\r\n€\t2\r\n'.encode("cp1252"))
    columns = [("v", "string", "_x0009_"), ("k", "int", "_x000D__x000A_")]
    assert flat(spark, tmp_path / "q.txt", columns, header_rows=2, code_page=1252, qualifier='"') == ([("a\tb", 1), ("€", 2)], [])
    assert flat(spark, tmp_path / "q.txt", columns, header_rows=2, code_page=1252, qualifier="<none>")[0] == [("€", 2)]
