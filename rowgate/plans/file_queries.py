"""Registered queries of the sources, sinks, streams, ledgers and reports, over files and tables that Spark derives from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgate.contract import DATA_FLOW_ERRORS
from rowgate.functions import scalar as S
from rowgate.operators import compare, flow, fuzzy, ladder, rollup, seedfaults, terms, warehouse
from rowgate.plans.order_lines import judge, judge_changed, process_judged
from rowgate.plans.queries import AS_OF_MS, CONTRACT, DEALT, OTHER, _ledger_of, batch, customers, decided, kept, known_lines, lines_alone, order_lines, products, run_of, table
from rowgate.plans.views import views
from rowgate.sinks import tables as sinks
from rowgate.sinks.logged import export_column, logged_split
from rowgate.sinks.buckets import BucketTable, ChangeTable, net_changes
from rowgate.sources import files
from rowgate.sources.scratch import scratch_path, staged
from rowgate.sources.tables import read_reference, read_whole_files, read_xml
from rowgate.streaming.files import OrderStream, accumulate, health
from rowgate.streaming.supervise import supervise

LINE = ("order_id", "line_no", "customer_id", "order_ts", "status", "channel", "currency", "sku", "qty", "unit_price", "line_total")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as JSON records."""
    return order_lines(spark, sf_dir).select("source_file", "l_partkey", "l_suppkey", "order_id", "qty", F.to_json(F.struct(*LINE)).alias("value"))


# --- sources ---


def source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record files with junk, arrays and blank lines among them, read back and counted."""
    spoiled = F.when(F.pmod("l_partkey", F.lit(50)) == 0, "not json").when(F.pmod("l_partkey", F.lit(50)) == 1, "[1, 2]").when(F.pmod("l_partkey", F.lit(50)) == 2, " ")
    path = scratch_path(spark)
    _records(spark, sf_dir).select(spoiled.otherwise(F.col("value")).alias("value")).write.text(path)
    rows = files.read_ndjson(spark, path)
    own = F.count_distinct("source_file", "source_line_no").alias("places")
    return rows.groupBy("parse_status", "parse_error").agg(F.count("*").alias("n"), own, F.sum(F.col("qty").cast("bigint")).alias("quantity"))


def source_failed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with one bad line fail whole."""
    value = F.when(F.pmod("l_partkey", F.lit(997)) == 0, "{").otherwise(F.col("value"))
    rows = files.fail_files(files.parse_json_lines(_records(spark, sf_dir).select("source_file", value.alias("raw_line"))))
    return rows.groupBy("source_file", "parse_status").agg(F.count("*").alias("n"))


def source_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delimited export read back with types; values that don't fit come out of the error port."""
    path = scratch_path(spark)
    quantity = F.when(F.pmod("l_partkey", F.lit(100)) == 0, "many").otherwise(F.col("l_quantity").cast("int").cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", quantity.alias("quantity"), F.concat(F.col("l_returnflag"), F.lit(" €")).alias("flag"))
    sinks.write_delimited(rows, path, "\t", header=False)
    good, bad = files.read_delimited(spark, path, [("k", "bigint"), ("quantity", "int"), ("flag", "string")], "\t")
    ok = good.groupBy("flag").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))
    lost = bad.agg(F.count("*").alias("n")).select(F.lit("error").alias("flag"), "n", F.lit(None).cast("bigint").alias("quantity"))
    return ok.unionByName(lost)


def source_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose columns end in delimiters of their own."""
    value = F.concat("l_returnflag", F.lit(";"), F.col("l_orderkey").cast("string"), F.lit("|"), F.col("l_linenumber").cast("string"))
    rows = files.split_columns(table(spark, sf_dir, "lineitem").select(value.alias("value")), [("flag", ";"), ("k", "|"), ("line", "\n")])
    return rows.groupBy("flag").agg(F.sum(F.col("k").cast("bigint")).alias("keys"), F.sum(F.col("line").cast("bigint")).alias("lines"))


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of the lines' files by their content, and an empty file for each nation."""
    made = _records(spark, sf_dir).groupBy("source_file").agg(F.sum(F.octet_length("order_id")).alias("bytes"), F.max("l_partkey").alias("modified"))
    empty = table(spark, sf_dir, "nation").select(F.concat(F.lit("empty-"), F.col("n_nationkey").cast("string"), F.lit(".json")).alias("source_file"))
    return made.unionByName(empty.withColumns({"bytes": F.lit(0).cast("bigint"), "modified": F.lit(0).cast("bigint")}))


def source_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed files that the ledger lacks."""
    done = _records(spark, sf_dir).select("source_file").distinct().filter(F.pmod(F.regexp_extract("source_file", r"(\d+)", 1).cast("int"), F.lit(3)) == 0)
    return files.pending(_listing(spark, sf_dir), done, 10**15, 5).select("source_file", "bytes")


def source_files_on_disk(spark: SparkSession, sf_dir: str, records_per_file: int = 50_000) -> DataFrame:
    """Files as the file system lists them, and as whole files: all bytes are there."""
    path = scratch_path(spark)
    # a whole file is one row, so files are kept small
    _records(spark, sf_dir).select("value").write.option("maxRecordsPerFile", records_per_file).text(path)
    listed = files.list_files(spark, path, ".txt").filter("bytes > 0").agg(F.sum("bytes").alias("listed_bytes"))
    read = read_whole_files(spark, path, "*.txt").agg(F.sum("bytes").alias("read_bytes"), F.sum(F.octet_length("content")).cast("bigint").alias("content_bytes"))
    lines = files.read_lines(spark, path).agg(F.count("*").alias("lines"), F.sum(F.octet_length("raw_line") + 1).alias("line_bytes"))
    one = listed.crossJoin(read).crossJoin(lines)  # one row each
    return one.select("lines", *((F.col(c) == F.col("line_bytes")).alias(f"same_{c}") for c in ("listed_bytes", "read_bytes", "content_bytes")))


def source_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parked files come back as one reject each, cut at 4000 characters."""
    path = scratch_path(spark)
    # five files hold all lines, so they are packed
    _records(spark, sf_dir).select("value").repartition(5).write.option("compression", "gzip").text(path)
    seen = spark.createDataFrame([], "source_file string")
    rows = files.dead_letters(spark, path, seen).filter("source_file like '%.txt.gz' and raw_payload <> '<empty file>'")
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.max(F.length("raw_payload")).alias("longest"))


def source_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    part.write.format("xml").option("rootTag", "parts").option("rowTag", "part").save(path)
    rows = read_xml(spark, path, "part", "p_partkey bigint, p_brand string, p_size int")
    return rows.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"), F.max("p_partkey").alias("last"))


def source_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another warehouse's table: chosen columns and rows."""
    rows = read_reference(spark, f"{sf_dir}/customer.parquet", ["c_mktsegment", "c_acctbal"], "c_acctbal > 0")
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum(F.col("c_acctbal").cast("decimal(14,2)")).cast("decimal(24,2)").alias("balance"))


# --- sinks ---


def sink_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after appends, an upsert, an insert of new keys and a deletion."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("K"), F.col("o_orderstatus").alias("V"))
    t = sinks.Table(spark, scratch_path(spark), "k bigint, v string")
    low = lambda df: sinks.conform(df, spark.createDataFrame([], "k bigint, v string"), "lower")
    t.append(low(o.filter("K % 3 = 0")))
    t.append(low(o.filter("K % 3 = 1")))
    t.upsert(low(o.filter("K % 2 = 0").withColumn("V", F.lit("up"))), ["k"])
    t.insert_new(low(o.withColumn("V", F.lit("new"))), ["k"])
    t.retain(F.col("k") % 7 != 0)
    return t.read().groupBy("v").agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


def bucket_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals kept by upserts of three loads, the last of which changes a hundredth of the orders, and deletions."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(14,2)").alias("total"))
    t = BucketTable(spark, scratch_path(spark), "o_orderkey bigint, o_orderstatus string, total decimal(14,2)", ["o_orderkey"], 16)
    t.upsert(o.filter("o_orderkey % 3 < 2"))
    t.insert_new(o.withColumn("o_orderstatus", F.lit("new")))
    t.upsert(o.filter("o_orderkey % 100 = 5").withColumns({"total": F.lit(1).cast("decimal(14,2)"), "o_orderstatus": F.lit("late")}))
    t.delete(o.filter("o_orderkey % 50 = 7"))
    return t.read().groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("total").cast("decimal(18,2)").alias("total"))


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes to their users: the first of a user inserts, errors delete, and what follows a deletion inserts again."""
    op = F.when(F.col("event_type") == "error", "D").when(F.col("event_type") == "signup", "I").otherwise("U")
    return table(spark, sf_dir, "events").select(op.alias("op"), F.col("event_id").alias("seq"), "user_id", "event_type", F.col("value").cast("decimal(14,2)").alias("value"))


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed applied in four loads that are out of order."""
    feed = _feed(spark, sf_dir)
    t = ChangeTable(spark, scratch_path(spark), "user_id bigint, event_type string, value decimal(14,2)", ["user_id"], "seq", 8)
    for part in (2, 0, 3, 1):
        t.apply(feed.filter(F.col("seq") % 4 == part))
    return t.current()


def change_feed_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the changes of each user come to."""
    return net_changes(_feed(spark, sf_dir), ["user_id"], "seq")


def sink_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run table is emptied, the dimension stays."""
    n = table(spark, sf_dir, "nation")
    run, dim = (sinks.Table(spark, scratch_path(spark), "n_nationkey int, n_name string") for _ in range(2))
    run.append(n)
    dim.append(n)
    run.reset()
    return flow.union_all(*(t.read().agg(F.count("*").alias("n")).withColumn("part", F.lit(name)) for name, t in (("run", run), ("dimension", dim))))


def sink_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that is loaded again replaces its own rows alone."""
    path = scratch_path(spark)
    rows = table(spark, sf_dir, "lineitem").select(F.pmod("l_orderkey", F.lit(7)).alias("etl_batch_id"), F.col("l_quantity").cast("bigint").alias("quantity"))
    sinks.replace_batch(rows, path)
    sinks.replace_batch(rows.filter("etl_batch_id = 3").withColumn("quantity", -F.col("quantity")), path)
    return spark.read.parquet(path).groupBy(F.col("etl_batch_id").cast("bigint").alias("batch")).agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


def sink_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejects as text rows, written by two outputs to one folder, and read back."""
    path = scratch_path(spark)
    judged = decided(spark, sf_dir).withColumn("raw_line", F.to_json(F.struct(*LINE)))
    rows = sinks.quarantine(ladder.rejected(judged), as_of=F.lit("2020-01-01").cast("timestamp"))
    sinks.write_rejects(rows.filter("reason = 'UNKNOWN_SKU'"), path)
    sinks.write_rejects(rows.filter("reason <> 'UNKNOWN_SKU'"), path)
    back = spark.read.schema(rows.schema).json(path)
    texts = F.count_if(F.get_json_object("raw_payload", "$.order_id") == F.col("order_id")).alias("with_payload")
    return back.groupBy("reason").agg(F.count("*").alias("n"), texts, F.count_distinct("source_file").alias("files"))


def sink_reject_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rejects of two runs as delimited files with a header, read back."""
    path = scratch_path(spark)
    sinks.write_delimited(runs_log(spark, sf_dir).withColumnRenamed("side", "engine"), path)
    back = spark.read.option("header", True).csv(path)
    return back.groupBy("engine", "reason").agg(F.count("*").alias("n"))


def sink_reason_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.reason_json(ladder.rejected(decided(spark, sf_dir)))


def sink_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    newest = events.agg(F.max("ts")).first()[0]
    return warehouse.retained(events, "ts", F.lit(newest), "6 hours").groupBy("event_type").agg(F.count("*").alias("n"))


def ledger_of_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file loaded twice, the second time all replay: counts add up, the status stays."""
    full = warehouse.job_ledger(rollup.per_file(decided(spark, sf_dir)))
    times = {"error_text": F.lit(None).cast("string"), "started_at": F.lit(None).cast("timestamp"), "finished_at": F.lit(None).cast("timestamp"), "duration_ms": F.lit(5).cast("bigint")}
    again = full.withColumns({"records_invalid": F.col("records_valid") + F.col("records_invalid"), "records_valid": F.lit(0).cast("bigint"), "status": F.lit("FAILED")})
    loads = full.withColumn("load_no", F.lit(0)).unionByName(again.withColumn("load_no", F.lit(1)))
    return accumulate(loads.withColumns(times)).select("source_file", "records_valid", "records_invalid", "status", "duration_ms", "loads")


def ledger_with_empty_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed files without lines are failed rows of the ledger."""
    ledger = warehouse.job_ledger(rollup.per_file(decided(spark, sf_dir)), _listing(spark, sf_dir))
    return ledger.groupBy("status").agg(F.count("*").alias("files"), F.sum("records_valid").alias("records_valid"), F.sum("records_invalid").alias("records_invalid"))


def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest ledger rows with their derived status: some still run, some were given up."""
    n = F.regexp_extract("source_file", r"(\d+)", 1).cast("int")
    ledger = warehouse.job_ledger(rollup.per_file(decided(spark, sf_dir)))
    ledger = ledger.withColumns({"finished_at": F.timestamp_seconds(1_000_000 + n * 60), "duration_ms": F.when(n % 2 == 0, 7)})
    runs = warehouse.recent_runs(ledger, F.timestamp_seconds(F.lit(1_000_000 + 97 * 60)), 30)
    return runs.select("source_file", "reject_pct", "status")


# --- streams ---


def stream_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines as files, through the stream: every line comes out once, with the batch plan's reasons."""
    landing, path = scratch_path(spark), scratch_path(spark)
    order_lines(spark, sf_dir).select(*LINE).write.option("compression", "gzip").json(landing)
    stream = OrderStream(spark, path, products(spark, sf_dir), customers(spark, sf_dir), CONTRACT, AS_OF_MS)
    try:
        stream.start(landing, f"{path}-checkpoint", files_per_batch=1000).awaitTermination()
    finally:
        stream.close()
    parts = (stream.read("items").select(F.lit("CLEAN").alias("reason")), stream.read("rejects").select("reason"))
    return rollup.histogram(flow.union_all(*parts), "reason")


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts that a stream raises over lines whose keys come once, in files that are read two a micro-batch and archived.

    A further row says whether there were so many loads, each finished after its start, and whether no file was left.
    """
    landing, path, archive = (scratch_path(spark) for _ in range(3))
    lines_alone(spark, sf_dir).select(*LINE).repartition(6).write.json(landing)
    given = files.list_files(spark, landing).filter("bytes > 0").count()
    stream = OrderStream(spark, path, products(spark, sf_dir), customers(spark, sf_dir), CONTRACT, AS_OF_MS)
    try:
        stream.start(landing, f"{path}-checkpoint", files_per_batch=2, archive=archive).awaitTermination()
    finally:
        stream.close()
    raised = stream.read("alerts").groupBy("alert_type", "severity").agg(F.count("*").alias("n"), F.sum("metric_value").cast("decimal(18,2)").alias("total"))
    loads = stream.loads("ledger").agg(F.count_distinct("load_no").alias("loads"), F.min(F.col("started_at") <= F.col("finished_at")).alias("timed"), F.count("*").alias("files"))
    fine = F.col("timed") & (F.col("loads") == -(-given // 2)) & (F.col("files") == given)
    return raised.unionByName(loads.select(F.lit("LOADS").alias("alert_type"), F.lit("INFO").alias("severity"), fine.cast("bigint").alias("n"), F.lit(None).cast("decimal(18,2)").alias("total")))


class _Flaky(OrderStream):
    """A stream whose store is away at the first try of every load."""

    def _write(self, name: str, df: DataFrame, load_no: int) -> None:
        if name == "ledger" and load_no not in self.__dict__.setdefault("tried", set()):
            self.tried.add(load_no)
            raise OSError("the store is away")
        super()._write(name, df, load_no)


def stream_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream through an outage at every load: it goes on by itself, and every line comes out once."""
    landing, path = scratch_path(spark), scratch_path(spark)
    order_lines(spark, sf_dir).select(*LINE).repartition(3).write.json(landing)
    stream = _Flaky(spark, path, products(spark, sf_dir), customers(spark, sf_dir), CONTRACT, AS_OF_MS)
    try:
        supervise(lambda: stream.start(landing, f"{path}-checkpoint", files_per_batch=2), wait=lambda seconds: None)
    finally:
        stream.close()
    parts = (stream.read("items").select(F.lit("CLEAN").alias("reason")), stream.read("rejects").select("reason"))
    return rollup.histogram(flow.union_all(*parts), "reason")


def revenue_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and revenue of each file."""
    loaded = batch(spark, sf_dir).orders
    return loaded.groupBy("batch_id").agg(F.count("*").alias("orders"), F.sum("order_total").cast("decimal(18,2)").alias("revenue"))


def stream_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = warehouse.job_ledger(rollup.per_file(decided(spark, sf_dir), dealt=DEALT)).withColumn("error_text", F.when(F.col("status") == "FAILED", "no valid line"))
    return health(_listing(spark, sf_dir), ledger)


# --- checks and reports ---


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's row count and duration, in long form."""
    at = F.timestamp_millis(F.lit(1_000_000))
    log = warehouse.stage_log("b1", "stage", table(spark, sf_dir, "lineitem"), at, at + F.expr("interval 3 seconds"))
    return warehouse.metrics(log.select("rows", "duration_ms"), "b1", "load")


def runs_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.log_of(run_of(spark, sf_dir, a=CONTRACT, b=OTHER), ("a", "b"))


def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred records by disagreement, then order."""
    return compare.disagreements_first(compare.side_by_side(runs_log(spark, sf_dir))).limit(100)


def largest_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.by_delta(compare.reason_counts(runs_log(spark, sf_dir))).limit(3)


def set_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys only one side rejects and both do, with samples."""
    log = runs_log(spark, sf_dir).withColumn("member", F.concat("order_id", F.lit("#"), F.col("line_no").cast("string")))
    a, b = (log.filter(F.col("side") == s).select(F.col("reason").alias("name"), "member") for s in "ab")
    return compare.set_members(a, b)


def row_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders sent to a side by their key: missing, unexpected, wrong and doubled rows are told apart."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    expected = o.filter("o_orderkey % 11 <> 0").withColumn("side", F.when(F.col("o_orderkey") % 2 == 0, "landed").otherwise("rejected"))
    wrong = F.when(F.col("o_orderkey") % 5 == 0, "rejected").when(F.col("o_orderkey") % 2 == 0, "landed").otherwise("rejected")
    actual = o.filter("o_orderkey % 13 <> 0").withColumn("side", wrong).unionByName(o.filter("o_orderkey % 17 = 0").withColumn("side", F.lit("landed")))
    return compare.oracle_diff(expected, actual, "o_orderkey", "side").groupBy("finding").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def rebased_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order times moved by a day: what falls out of the window then."""
    judged = judge(seedfaults.rebase(known_lines(spark, sf_dir), -86_400_000), CONTRACT, AS_OF_MS)
    return rollup.histogram(judged.select(F.coalesce("reason", F.lit("CLEAN")).alias("reason")), "reason")


def replay_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of known outcome and a replay of the clean ones: each fault's variants get its reason, each replayed line DUP_KEY."""
    named = (*LINE, "source_file", "l_partkey", "l_suppkey", "known_sku", "known_customer")
    clean = staged(batch(spark, sf_dir).decided.filter("reason is null").select(*named))
    keys = ["order_id", "line_no"]
    spoiled = seedfaults.variants(clean, 20, keys)
    replayed = seedfaults.replay(clean.withColumns({"fault": F.lit(None).cast("string"), "expected_reason": F.lit(None).cast("string")}), 10, keys)
    lines = spoiled.withColumn("replayed", F.lit(False)).unionByName(replayed)
    judged = judge_changed(lines, F.col("fault").isNotNull(), products(spark, sf_dir), customers(spark, sf_dir), CONTRACT, AS_OF_MS)
    out = process_judged(judged, CONTRACT, order=("source_file", "replayed", "l_partkey", "l_suppkey"))
    table_ = compare.expected_vs_actual(out.decided.withColumn("expected_reason", F.when(F.col("replayed"), "DUP_KEY").otherwise(F.col("expected_reason"))))
    wrong = F.col("expected") != F.col("actual")
    # a replayed line whose first copy was spoiled loads in its place
    excused = (F.col("expected") == "DUP_KEY") & (F.col("actual") == "CLEAN")
    return table_.agg(F.coalesce(F.sum(F.when(wrong & ~excused, F.col("n"))), F.lit(0)).alias("wrong"), F.count_if(~wrong).alias("right_cells"))


def replay_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay-safe and payload-kept checks of a run that is fed twice."""
    first = batch(spark, sf_dir)
    loaded = staged(first.items.select("order_id", "line_no", DEALT))
    again = kept(spark, sf_dir, loaded=loaded)
    return compare.replay_checks(loaded, again.items, sinks.quarantine(again.rejects))


def file_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PASS or FAIL for each file: every line loaded or rejected, no clean line lost. Files of lines with a late part miss some."""
    outcome = batch(spark, sf_dir).decided.filter("not (l_partkey % 1000 = 7)")
    return warehouse.file_verdicts(order_lines(spark, sf_dir), outcome)


def views_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts and totals of the reports over a loaded run."""
    run = kept(spark, sf_dir)
    at = F.timestamp_millis("order_ts")
    items, raised = run.items.withColumn("ingest_ts", at), run.alerts.withColumn("alert_ts", at)
    rejects = sinks.quarantine(run.rejects).withColumn("quarantined_at", F.timestamp_millis(F.col("order_ts").cast("bigint")))
    ledger = warehouse.job_ledger(_ledger_of(run)).withColumns({"finished_at": F.timestamp_seconds(F.lit(0)), "duration_ms": F.lit(1).cast("bigint")})
    reports = views(run.orders.withColumn("ingest_ts", at), items, rejects, raised, ledger, F.timestamp_seconds(F.lit(0)), "1 day")
    measures = {
        "orders_per_minute": F.sum("orders"), "revenue_by_category": F.sum("orders"), "quality_per_minute": F.sum("rejected"), "reject_reasons": F.sum("n"),
        "alert_kinds": F.sum("n"), "summary": F.sum("valid"), "failed_files": F.count("*"), "file_ledger": F.sum("orders"), "orphan_orders": F.count("*"),
        "top_skus": F.sum("units"), "recent_alerts": F.count("*"), "recent_rejects": F.count("*"), "recent_runs": F.count("*"),
    }
    return flow.union_all(*(reports[k].agg(F.coalesce(m.cast("bigint"), F.lit(0)).alias("value")).withColumn("report", F.lit(k)) for k, m in measures.items()))


# --- columns ---


def strict_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose JSON types are the declared ones: quantities are quoted in some."""
    number = {"line_no": "int", "qty": "int", "order_ts": "bigint", "unit_price": "double"}
    typed = [F.col(c).cast(t).alias(c) for c, t in number.items()]
    quoted = [F.col(c).alias(c) if c == "qty" else F.col(c).cast(t).alias(c) for c, t in number.items()]
    lines = order_lines(spark, sf_dir)
    raw = F.when(F.pmod("l_partkey", F.lit(9)) == 0, F.to_json(F.struct(*quoted))).otherwise(F.to_json(F.struct(*typed)))
    return lines.select(raw.alias("raw_line")).groupBy(ladder.wire_types().alias("declared")).agg(F.count("*").alias("n"))


def error_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes with their texts; unknown codes keep their rows."""
    codes = spark.createDataFrame(list(DATA_FLOW_ERRORS.items()), "code int, text string")
    part = table(spark, sf_dir, "part").select((F.lit(-939_524_094) + F.pmod("p_partkey", F.lit(30))).cast("int").alias("error_code"))
    return flow.describe_codes(part, codes, "error_code").groupBy("error_code", "description").agg(F.count("*").alias("n"))


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    priced = F.format_number(F.col("o_totalprice"), 2)
    rest = F.regexp_replace("o_orderpriority", "^1.*$", "")
    return o.select(
        "o_orderkey",
        F.length("o_orderpriority").alias("letters"),
        S.fallback(rest, F.lit("first")).alias("priority"),
        (F.col("o_orderdate") + F.expr("interval 10 minutes")).alias("later"),
        F.round(S.parse_number(priced).cast("decimal(14,2)"), 1).cast("double").alias("price"),
        F.from_json(F.to_json(F.struct(F.col("o_custkey").alias("c"))), "c bigint")["c"].alias("customer"),
        S.divide_wide(F.col("o_orderkey").cast("decimal(19,0)") * F.lit(1 << 40).cast("decimal(13,0)"), F.lit(-3)).alias("third"),
        S.file_stem(F.concat(F.lit("a."), F.col("o_orderstatus"), F.lit(".json"))).alias("stem"),
    )


def character_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed and copied columns with their lineage, two inputs merged in order."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    mapped = flow.character_map(n.withColumn("copy", F.col("n_name")), {"n_name": "lower", "copy": "reverse"})
    both = flow.merge_sorted(mapped.filter("n_nationkey % 2 = 0"), mapped.filter("n_nationkey % 2 = 1"), ["n_nationkey"])
    return flow.audit(both, "maps", "b7")


def packed_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a clean line's table has no columns for goes into notes and comes back."""
    items = batch(spark, sf_dir).items.select("order_id", "status", "channel", "currency", "line_total")
    notes = flow.pack(items, ["status", "channel", "currency", "line_total"])
    back = flow.unpack(notes, "status string, channel string, currency string, line_total decimal(14,2)")
    return back.groupBy("status", "channel", "currency").agg(F.count("*").alias("n"), F.sum("line_total").cast("decimal(18,2)").alias("total"))


def wanted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that have one of the commonest terms of all part names."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    wanted = terms.terms(part, "p_name").filter("n > 1").select("term")
    return terms.term_lookup(part, "p_name", wanted).groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("parts"))


def cached_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements over named tables, and a reference that two of them share."""
    tables = {"cust": table(spark, sf_dir, "customer"), "nat": flow.cached(table(spark, sf_dir, "nation"))}
    return flow.statement("SELECT n_name, count(*) AS n FROM {cust} JOIN {nat} ON c_nationkey = n_nationkey GROUP BY n_name", **tables)


def fuzzy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of customers that are one edit apart form groups."""
    c = table(spark, sf_dir, "customer").select(F.left(F.md5(F.col("c_name").cast("binary")), F.lit(5)).alias("code"))
    return fuzzy.fuzzy_groups(c, "code", 1).groupBy("group").agg(F.count("*").alias("customers"), F.count_distinct("code").alias("codes"))


def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part descriptions found again among others by their words, which stand in another order there."""
    described = [F.concat_ws(sep, *order).alias("words") for sep, order in ((" ", ("p_name", "p_brand", "p_type")), (", ", ("p_type", "p_brand", "p_name")))]
    part = table(spark, sf_dir, "part")
    own, other = part.filter("p_size % 5 = 0").select("p_partkey", described[0]), part.filter("p_size % 5 = 1").select(described[1])
    found = fuzzy.similar_lookup(own, other.withColumnRenamed("words", "ref"), "words", "ref", 0.5)
    return found.select("p_partkey", "matched", F.round("score", 4).alias("score"))


def document_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of two and three words that the documents have twenty times or more, without those that a stop word begins or ends."""
    found = terms.phrases(table(spark, sf_dir, "documents"), "text", 3, ("the", "and", "of"), 20, 2)
    return found.select("term", "n", "rows", F.round("score", 3).alias("score"))


def phrases_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of parts that are phrases of two words, found in what is said of parts."""
    part = table(spark, sf_dir, "part")
    said = part.select("p_partkey", F.concat(F.lit("This "), F.upper("p_type"), F.lit(" -- "), "p_name", F.lit("; by "), "p_brand").alias("said"))
    wanted = part.filter("p_size <= 5").select(F.col("p_name").alias("term")).unionByName(part.filter("p_size = 7").select(F.concat(F.lit("by "), "p_brand").alias("term")))
    return terms.term_lookup(said, "said", wanted.distinct()).groupBy("term").agg(F.sum("n").cast("bigint").alias("n"), F.count("*").alias("parts"))


def logged_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dealt to three outputs in one scan, with the counts that the write took, beside what the files hold."""
    cases = [("bulk", F.col("l_quantity") >= 40), ("discounted", F.col("l_discount") > 0.05)]
    outputs, log = logged_split(table(spark, sf_dir, "lineitem"), cases, scratch_path(spark), "b1", "split", "rest")
    held = flow.union_all(*(df.agg(F.count("*").alias("in_files")).withColumn("measure", F.lit(n)) for n, df in outputs.items()))
    return log.select("batch_id", "stage", "measure", "value").join(held, "measure", "left")


def orders_over_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files loaded in three parts that share orders: counts from the ledger alone, and whether its distinct orders are within 7 %."""
    lines = staged(decided(spark, sf_dir).select("source_file", "reason", "order_id", "line_total", "l_partkey"))
    ledger = staged(flow.union_all(*(rollup.with_sketch(lines.filter(F.col("l_partkey") % 3 == part)) for part in range(3))))
    exact = lines.filter("reason is null").groupBy("source_file").agg(F.count_distinct("order_id").alias("exact"))
    both = rollup.merged(ledger).join(exact, "source_file", "left").na.fill(0, ["exact"])
    return both.select("source_file", "lines_in", "lines_clean", "lines_rejected", "revenue", (F.abs(F.col("orders") - F.col("exact")) <= 0.07 * F.col("exact")).alias("near"))


def exported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each supplier, written by the tasks, read back and compared by its digest."""
    path = scratch_path(spark)
    s = table(spark, sf_dir, "supplier")
    named = s.select(F.concat(F.col("s_nationkey").cast("string"), F.lit("/"), "s_name", F.lit(".txt")).alias("file"), F.concat("s_name", F.lit(" \u20ac\n"), F.col("s_nationkey").cast("string")).alias("content"))
    written = staged(export_column(named, path, "file", "content"))
    back = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    back = back.select(F.array_join(F.slice(F.split("path", "/"), -2, 2), "/").alias("file"), F.sha2("content", 256).alias("read_sha256"))
    return written.join(back.withColumn("file", F.url_decode("file")), "file", "full").select("file", "bytes", "sha256", "read_sha256")


def source_flat_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of several header rows, whose row end is the last column's delimiter, and whose columns end in delimiters of their own."""
    path, header = scratch_path(spark), "first;second|third\r\nmade today\r\n"
    o = table(spark, sf_dir, "orders")
    key = F.when(F.col("o_orderkey") % 10 == 3, F.lit("none")).otherwise(F.col("o_orderkey").cast("string"))
    lines = o.select("o_orderkey", F.concat("o_orderstatus", F.lit(";"), key, F.lit("|"), "o_orderpriority").alias("line"))
    whole = lines.groupBy(F.pmod("o_orderkey", F.lit(7)).alias("part")).agg(F.array_join(F.sort_array(F.collect_list("line")), "\r\n").alias("body"))
    staged(export_column(whole.select(F.concat(F.lit("f"), F.col("part").cast("string"), F.lit(".txt")).alias("file"), F.concat(F.lit(header), "body", F.lit("\r\n")).alias("body")), path, "file", "body"))
    columns = [("status", "string", "_x003B_"), ("k", "bigint", "|"), ("priority", "string", "_x000D__x000A_")]
    good, bad = files.read_flat_file(spark, path, columns, header_rows=2)
    ok = good.groupBy("status").agg(F.count("*").alias("n"), F.sum("k").alias("keys"), F.count_distinct("priority").alias("priorities"))
    return ok.unionByName(bad.groupBy(F.lit("error").alias("status")).agg(F.count("*").alias("n"), F.sum("k").alias("keys"), F.count_distinct("priority").alias("priorities")))


QUERIES = (
    source_records,
    source_failed_files,
    source_delimited,
    source_columns,
    source_pending,
    source_files_on_disk,
    source_dead_letters,
    source_xml,
    source_reference,
    sink_append,
    bucket_upserts,
    change_feed,
    change_feed_net,
    sink_reset,
    sink_batches,
    sink_quarantine,
    sink_reject_export,
    sink_reason_json,
    sink_retained,
    ledger_of_loads,
    ledger_with_empty_files,
    recent_runs,
    stream_load,
    stream_alerts,
    stream_recovery,
    revenue_by_batch,
    stream_health,
    run_log,
    disagreements,
    largest_deltas,
    set_members,
    row_oracle,
    rebased_times,
    replay_slice,
    replay_conformance,
    file_verdicts,
    views_of_run,
    strict_types,
    error_descriptions,
    scalar_functions,
    character_maps,
    packed_notes,
    wanted_terms,
    cached_reference,
    fuzzy_groups,
    logged_branches,
    orders_over_loads,
    exported_files,
    source_flat_file,
    similar_names,
    document_phrases,
    phrases_found,
)
