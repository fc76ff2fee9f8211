import datetime

from pyspark.sql import functions as F

from rowgate.operators import warehouse
from rowgate.plans.views import views
from rowgate.sources import tables

NOW = datetime.datetime(2024, 5, 1, 12, 0)


def test_views(spark):
    orders = spark.createDataFrame([("o1", 10.0, "b1", "b1.json", NOW), ("o2", 5.0, "b9", "b9.json", NOW)], "order_id string, order_total double, batch_id string, source_file string, ingest_ts timestamp")
    items = spark.createDataFrame([("o1", 1, "S", 2, 10.0, "toys", NOW), ("o2", 1, "T", 1, 5.0, "toys", NOW)], "order_id string, line_no int, sku string, qty int, line_total double, category string, ingest_ts timestamp")
    rejects = spark.createDataFrame([("o3", "1", "DUP_KEY", NOW)], "order_id string, line_no string, reason string, quarantined_at timestamp")
    alerts = spark.createDataFrame([("o1", "HIGH_VALUE", "WARN", NOW)], "order_id string, alert_type string, severity string, alert_ts timestamp")
    rows = [("b1.json", 1, 0, "OK", NOW, 5), ("b2.json", 0, 3, "OK", NOW, 5), ("b3.json", 2, 1, "OK", NOW, 5), ("b4.json", 0, 1, "OK", NOW, None), ("b5.json", 9, 0, "FAILED", NOW, 5)]
    ledger = spark.createDataFrame(rows, "source_file string, records_valid long, records_invalid long, status string, finished_at timestamp, duration_ms long")
    out = views(orders, items, rejects, alerts, ledger, F.lit(NOW))
    got = {name: df.collect() for name, df in out.items()}
    assert {r.source_file: r.status for r in got["recent_runs"]} == {"b1.json": "SUCCESS", "b2.json": "FAILED", "b3.json": "PARTIAL", "b4.json": "RUNNING", "b5.json": "FAILED"}
    assert [(r.sku, r.revenue) for r in got["top_skus"]] == [("S", 10.0), ("T", 5.0)]
    assert [str(r.reject_pct) for r in got["quality_per_minute"]] == ["33.3"]
    assert [r.order_id for r in got["orphan_orders"]] == ["o2"]
    assert got["summary"][0].failed_files == 1 and got["reject_reasons"][0].n == 1


def test_logs_and_retention(spark):
    df = spark.range(3).withColumn("ts", F.lit(NOW) - F.make_interval(hours=F.col("id").cast("int") * 4))
    assert warehouse.retained(df, "ts", F.lit(NOW)).count() == 2
    one = warehouse.stage_log("b", "cleanse", df, F.lit(NOW), F.lit(NOW) + F.expr("interval 2 seconds")).first()
    assert (one.rows, one.duration_ms) == (3, 2000)
    assert {r.metric: float(r.value) for r in warehouse.metrics(df.agg(F.count("*").alias("n"), F.max("id").alias("most")), "b", "p").collect()} == {"n": 3.0, "most": 2.0}


def test_sources(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rows><row><id>1</id><n>x</n></row><row><id>2</id><n>y</n></row></rows>")
    assert sorted(tuple(r) for r in tables.read_xml(spark, str(tmp_path / "a.xml"), "row", "id int, n string").collect()) == [(1, "x"), (2, "y")]
    whole = tables.read_whole_files(spark, str(tmp_path), "*.xml").first()
    assert whole.source_file == "a.xml" and whole.bytes == len(whole.content)
    spark.range(10).selectExpr("id", "id * 2 AS twice").write.parquet(str(tmp_path / "ref"))
    assert tables.read_reference(spark, str(tmp_path / "ref"), ["twice"], "id > 7").count() == 2
