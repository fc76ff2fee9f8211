"""File streams: every micro-batch runs the batch plan and writes tables that a re-run leaves as they are."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rowgate.contract import RAW_LINE, Contract
from rowgate.functions.scalar import file_stem
from rowgate.operators.flow import marked_lookup, union_all
from rowgate.operators.rollup import per_file
from rowgate.operators.warehouse import job_ledger
from rowgate.plans.order_lines import clean_keys, decide, outcomes, replays, split
from rowgate.sinks.tables import conform, copy_files, quarantine
from rowgate.sources.files import empty_files, fail_files, list_files, number_lines, parse_json_lines, pending, text_lines
from rowgate.sources.scratch import files_of, scratch_path
from rowgate.streaming.seen import SeenKeys

LOADS = {
    "items": "order_id string, line_no int, customer_id string, sku string, qty int, unit_price decimal(14,4), line_total decimal(14,2), order_ts bigint,"
    " status string, channel string, payment_type string, category string, catalog_price decimal(12,2), currency string, batch_id string, source_file string,"
    " quality_status string, defects string, line_total_fixed decimal(14,2)",
    "orders": "order_id string, customer_id string, order_ts bigint, status string, channel string, payment_type string, currency string, batch_id string,"
    " source_file string, order_total decimal(14,2), item_count bigint",
    "rejects": "reason string, detail string, batch_id string, source_file string, order_id string, line_no string, customer_id string, order_ts string, sku string,"
    " qty string, unit_price string, line_total string, currency string, status string, channel string, raw_payload string, quarantined_at timestamp",
    "alerts": "alert_type string, severity string, metric_value decimal(14,2), order_id string, line_no int, customer_id string, batch_id string, source_file string",
    "ledger": "source_file string, records_valid bigint, records_invalid bigint, orders_loaded bigint, orders_sketch binary, status string, error_text string,"
    " started_at timestamp, finished_at timestamp, duration_ms bigint",
    "health": "pending_files bigint, files_done bigint, failed_files bigint, last_file string, last_status string, last_error string, seen_at timestamp",
}
#: Tables of which a later load's row replaces an earlier one's.
KEYED = {"orders": "order_id", "ledger": "source_file"}
#: Record files, plain or packed.
RECORDS = (".json", ".json.gz")
#: What is kept of a load's lines: their fields, where they stood, what became of them, and their values.
_KEPT = (*RAW_LINE.fieldNames(), "source_file", "source_line_no", "reason", "detail", "__o", "__l", "qty_v", "price_v", "total_v", "ts_v", "raw_line")


class OrderStream:
    """The tables of one pipeline under ``path`` and the function that loads a micro-batch into them.

    Every table is partitioned by ``load_no``, the micro-batch. A load writes its own partitions only, and a retried one
    replaces what its first try wrote. Replays are told by the state of a query beside the loads (``seen``), which looks up the load's
    own keys. ``close()`` ends that query. A load reads and judges its lines once: what became of them is written to the shared folder, packed, and
    every table is made from that; a further try of a micro-batch that failed finds it there.
    ``on_bad_line="fail_file"`` rejects files whole that have a line which can't be read.
    """

    def __init__(
        self, spark: SparkSession, path: str, products: DataFrame, customers: DataFrame, contract: Contract, as_of_ms: int, on_bad_line: str = "line"
    ) -> None:
        self.spark, self.path, self.products, self.customers = spark, path, products, customers
        self.contract, self.as_of_ms, self.on_bad_line = contract, as_of_ms, on_bad_line
        self.seen = SeenKeys(spark, f"{path}/seen", "order_id string, line_no bigint")
        self._kept: tuple[object, str] | None = None

    def close(self) -> None:
        self.seen.close()
        self._forget()

    def loads(self, name: str) -> DataFrame:
        """A table's rows with their ``load_no``."""
        schema = LOADS[name] + ", load_no bigint"
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def read(self, name: str) -> DataFrame:
        """A table as it stands: of a key that several loads wrote, the newest row."""
        rows = self.loads(name)
        if name in KEYED:
            rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(KEYED[name]).orderBy(F.desc("load_no")))).filter("__n = 1").drop("__n")
        return rows.drop("load_no")

    def accumulated(self) -> DataFrame:
        """The ledger over all loads of each file."""
        return accumulate(self.loads("ledger"))

    def _write(self, name: str, df: DataFrame, load_no: int) -> None:
        rows = conform(df, self.spark.createDataFrame([], LOADS[name])).withColumn("load_no", F.lit(load_no).cast("bigint"))
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        writer.partitionBy("load_no").parquet(f"{self.path}/{name}")

    def _keep(self, rows: DataFrame) -> str:
        path = scratch_path(self.spark)
        rows.select(*_KEPT).write.option("compression", "zstd").parquet(path)
        return path

    def _delete(self, path: str) -> None:
        at, fs = files_of(self.spark, path)
        fs.delete(at, True)

    def _forget(self) -> None:
        """Delete what is kept of a load's lines."""
        if self._kept is not None:
            self._delete(self._kept[1])
        self._kept = None

    def _judged(self, lines: DataFrame, load_no: int) -> str:
        """Where each line is kept with what became of it."""
        parsed = parse_json_lines(lines)
        parsed = fail_files(parsed) if self.on_bad_line == "fail_file" else parsed
        judged = decide(parsed, self.products, self.customers, self.contract, self.as_of_ms)
        # a line that is the JSON of its fields needn't be dealt beside them
        own = F.to_json(_fields().withField("order_id", F.trim("order_id")).withField("line_no", F.col("line_no_v").cast("string")))
        judged = judged.withColumn("raw_line", F.when(~own.eqNullSafe(F.col("raw_line")), F.col("raw_line")))
        path = self._keep(outcomes(judged, ("source_file", "source_line_no")))
        first = self.spark.read.parquet(path)
        before = self.seen.earlier(clean_keys(first), load_no, distinct=True)
        if before.isEmpty():
            return path
        again = self._keep(replays(first, before))
        self._delete(path)
        return again

    def load(self, lines: DataFrame, load_no: int, landing: str | None = None, same: object = None) -> None:
        """Load a micro-batch of raw lines (``raw_line``, ``source_file``, ``source_line_no``).

        With ``landing``, empty files there that no earlier load has seen fail in this one, and failed files are parked as they are.
        ``same`` is what tries with the same lines have in common: one that follows a failed one counts them, and doesn't judge them again.
        """
        started = F.lit(datetime.now(UTC)).cast("timestamp")
        if same is None or self._kept is None or self._kept[0] != same or self.spark.read.parquet(self._kept[1]).count() != lines.count():
            self._forget()
            self._kept = same, self._judged(lines, load_no)
        whole = self.spark.read.parquet(self._kept[1]).withColumn("batch_id", file_stem(F.regexp_replace("source_file", r"\.gz$", "")))
        found = [c for c in ("category", "catalog_price") if c in self.products.columns]
        clean = marked_lookup(whole.filter(F.col("reason").isNull()), self.products, [(F.trim("sku"), "sku")], found)
        out = split(whole.withColumn("raw_line", F.coalesce("raw_line", F.to_json(_fields()))), self.contract, clean)
        self._write("rejects", quarantine(out.rejects), load_no)
        self._write("alerts", out.alerts, load_no)
        self._write("orders", out.orders, load_no)
        totals = out.decided.select("source_file", "reason", "order_id", F.col("total_v").alias("line_total"))
        first = out.rejects.groupBy("source_file").agg(F.min_by("detail", "source_line_no").alias("error_text"))
        ledger = job_ledger(per_file(totals, sketch=12)).join(first, "source_file", "left")
        ledger = ledger.withColumn("error_text", F.when(F.col("status") == "FAILED", F.col("error_text")))
        if landing is not None:
            seen = self.loads("ledger").filter(F.col("load_no") < load_no)
            empty = pending(empty_files(list_files(self.spark, landing, RECORDS)), seen).drop("modified")
            ledger = union_all(ledger, empty).na.fill(0, ["records_valid", "records_invalid", "orders_loaded"])
        finished = F.current_timestamp()
        times = {"started_at": started, "finished_at": finished, "duration_ms": F.unix_millis(finished) - F.unix_millis(started)}
        self._write("ledger", ledger.withColumns(times), load_no)
        self._write("items", out.items, load_no)
        if landing is not None:
            mine = self.loads("ledger").filter((F.col("load_no") == load_no) & (F.col("status") == "FAILED"))
            copy_files(self.spark, landing, f"{self.path}/parked", [r.source_file for r in mine.select("source_file").collect()])
            now = health(list_files(self.spark, landing, RECORDS), self.read("ledger")).withColumn("seen_at", F.current_timestamp())
            self._write("health", now, load_no)
        self.seen.forget_answers()
        self._forget()

    def start(
        self, landing: str, checkpoint: str, files_per_batch: int = 1, archive: str | None = None, bytes_per_batch: str | None = None, **trigger
    ) -> StreamingQuery:
        """Watch a folder: files in order of arrival, so many (or so many bytes) a micro-batch, each committed before the next.

        A micro-batch that fails ends the query; started again, it goes on with that one, and nothing is lost or doubled.
        """
        reader = self.spark.readStream.option("pathGlobFilter", "*.{json,json.gz}")
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch) if bytes_per_batch else reader.option("maxFilesPerTrigger", files_per_batch)
        if archive:
            reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
        lines = text_lines(reader, landing)
        # the checkpoint repeats a micro-batch that failed with the same lines
        writer = lines.writeStream.foreachBatch(lambda lines, n: self.load(number_lines(lines), n, landing, (checkpoint, n))).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def _fields() -> Column:
    """The fields of a record as they were read."""
    return F.struct(*RAW_LINE.fieldNames())


def accumulate(ledger: DataFrame) -> DataFrame:
    """One row a file over all its loads: counts add up, the best status stays, so that a replay doesn't make a success a failure.

    ``orders_loaded`` counts an order in each load that had lines of it; ``orders``, told from the ledger's sketches where it has them, once.
    """
    best = F.array("status", F.lit("SUCCESS"), F.lit("PARTIAL"), F.lit("RUNNING"), F.lit("FAILED"))
    place = F.array_position(F.slice(best, 2, 4), F.col("status"))
    distinct = [F.hll_sketch_estimate(F.hll_union_agg("orders_sketch")).alias("orders")] if "orders_sketch" in ledger.columns else []
    return ledger.groupBy("source_file").agg(
        *(F.sum(c).cast("bigint").alias(c) for c in ("records_valid", "records_invalid", "orders_loaded")),
        F.min_by("status", place).alias("status"),
        F.max_by("error_text", F.when(F.col("error_text").isNotNull(), F.col("load_no"))).alias("error_text"),
        F.min("started_at").alias("started_at"),
        F.max("finished_at").alias("finished_at"),
        F.sum("duration_ms").cast("bigint").alias("duration_ms"),
        F.count("*").alias("loads"),
        *distinct,
    )


def windowed(stream: DataFrame, ts: str, interval: str, late: str, by: list[str], *measures: Column) -> DataFrame:
    """Tumbling event-time windows of a stream; rows later than ``late`` behind the newest are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, interval), *by).agg(*measures)


def health(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: pending files, files done, failed files; the last file by name, its status, and the error of the last one that failed."""
    left = listing.join(ledger.select("source_file"), "source_file", "left_anti").agg(F.count("*").alias("pending_files"))
    failed = F.col("status") == "FAILED"
    done = ledger.agg(
        F.count("*").alias("files_done"),
        F.count_if(failed).alias("failed_files"),
        F.max("source_file").alias("last_file"),
        F.max_by("status", "source_file").alias("last_status"),
        F.max_by("error_text", F.when(failed, F.col("source_file"))).alias("last_error"),
    )
    return left.crossJoin(done)
