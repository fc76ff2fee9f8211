"""Keyed loads, dimensions, facts, ledgers and their checks, as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowgate.functions.scalar import date_key, percentage
from rowgate.sources.files import calendar
from rowgate.sources.scratch import staged


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: list[Column | str] | None = None) -> DataFrame:
    """``target`` with the source's rows in place of those with their keys. Of source rows of one key the last by ``order`` counts."""
    rows = source
    if order:
        rank = Window.partitionBy(*keys).orderBy(*(F.col(o).desc() if isinstance(o, str) else o for o in order))
        rows = source.withColumn("__n", F.row_number().over(rank)).filter("__n = 1").drop("__n")
    return target.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*target.columns))


def insert_new(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The source rows whose key the target lacks, one a key."""
    return source.join(target.select(*keys), keys, "left_anti").dropDuplicates(keys)


def surrogate(df: DataFrame, by: str, name: str, after: int = 0) -> DataFrame:
    """Dense keys from ``after`` + 1 in the order of the distinct business key ``by``, without sorting in one task.

    Keys are counted for each range partition; only those counts, one number a partition, are summed in one place. The
    cut is written once, as ranges drawn twice may differ.
    """
    ranked = staged(
        df.repartitionByRange(by)
        .withColumn("__p", F.spark_partition_id())
        .withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(by)))
    )
    counts = ranked.groupBy("__p").agg(F.count("*").alias("__c"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))
    joined = ranked.join(F.broadcast(offsets), "__p")  # a row for each partition
    return joined.withColumn(name, (F.col("__n") + F.col("__o") + after).cast("bigint")).drop("__p", "__n", "__o")


def dim_date(spark, first: str = "2020-01-01", last: str = "2026-12-31") -> DataFrame:
    d = F.col("full_date")
    return calendar(spark, first, last).select(
        date_key(d).alias("date_key"),
        "full_date",
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.date_format(d, "EEEE").alias("day_of_week"),
        F.dayofmonth(d).alias("day_num"),
        F.dayofweek(d).isin(1, 7).alias("is_weekend"),
    )


def new_products(existing: DataFrame, incoming: DataFrame, maker: str = "Stream") -> DataFrame:
    """Products that the dimension lacks; a missing manufacturer gets the default."""
    return insert_new(existing, incoming.withColumn("manufacturer", F.coalesce("manufacturer", F.lit(maker))), ["product_code"])


def customer_versions(current: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """SCD type 2 without a loop: ``customer_id``, ``customer_name``, ``valid_from``, ``valid_to``, ``is_current``.

    ``incoming`` has ``customer_email``, ``customer_name``, ``order_date``. Each distinct (key, name) counts at its first
    date. By date, then name, a version opens where the name changes and closes the one before it. A key's
    current version comes first, whatever its date.
    """
    key = F.lower(F.trim("customer_email"))
    named = incoming.filter(F.coalesce(F.trim("customer_email"), F.lit("")) != "")
    seen = named.groupBy(key.alias("customer_id"), F.trim("customer_name").alias("customer_name")).agg(
        F.min("order_date").alias("valid_from")
    )
    rows = seen.withColumn("__new", F.lit(1))
    if current is not None:
        open_ = current.filter("is_current").select("customer_id", F.trim("customer_name").alias("customer_name"), "valid_from", F.lit(0).alias("__new"))
        rows = rows.unionByName(open_)
    order = Window.partitionBy("customer_id").orderBy("__new", "valid_from", "customer_name")
    changed = rows.withColumn("__before", F.lag("customer_name").over(order)).filter(~F.col("customer_name").eqNullSafe(F.col("__before")) | F.col("__before").isNull())
    out = changed.withColumn("valid_to", F.lead("valid_from").over(order)).select(
        "customer_id", "customer_name", "valid_from", "valid_to", F.col("valid_to").isNull().alias("is_current")
    )
    if current is None:
        return out
    return out.unionByName(current.filter("not is_current").select(*out.columns))


def facts(clean: DataFrame, dates: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Fact rows with their keys resolved; lines without a match fall out and show up in ``reconcile``."""
    total = F.round(
        F.col("quantity").cast("decimal(10,0)")
        * F.col("unit_price").cast("decimal(14,4)")
        * (F.lit(1).cast("decimal(6,4)") - F.coalesce("discount_pct", F.lit(0)).cast("decimal(6,4)")),
        4,
    )
    keyed = clean.withColumns({"__d": date_key(F.col("order_date")), "__c": F.lower(F.trim("customer_email")), "__p": F.upper(F.trim("product_code"))})
    return (
        keyed.join(dates.select(F.col("date_key").alias("__d")), "__d", "left_semi")
        .join(customers.filter("is_current").select(F.col("customer_id").alias("__c"), "customer_key"), "__c")
        .join(products.select(F.upper(F.trim("product_code")).alias("__p"), "product_key"), "__p")
        .select("order_line_id", "order_id", F.col("__d").alias("date_key"), "customer_key", "product_key", "quantity", "unit_price", total.cast("decimal(18,4)").alias("total_price"))
    )


def reconcile(staged: DataFrame, clean: DataFrame, rejected: DataFrame, fact: DataFrame) -> DataFrame:
    """Two checks: clean lines are facts; every staged line is clean or rejected."""

    def n(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias(name))

    one = n(staged, "staged").crossJoin(n(clean, "clean")).crossJoin(n(rejected, "rejected")).crossJoin(n(fact, "fact"))
    checks = F.array(
        F.struct(F.lit("clean_vs_fact").alias("check_name"), F.col("clean").alias("source_count"), F.col("fact").alias("target_count")),
        F.struct(F.lit("sources_vs_outcome").alias("check_name"), F.col("staged").alias("source_count"), (F.col("clean") + F.col("rejected")).alias("target_count")),
    )
    rows = one.select(F.explode(checks).alias("c")).select("c.*")
    return rows.withColumn("pass", F.col("source_count") == F.col("target_count"))


def file_verdicts(lines: DataFrame, outcome: DataFrame, by: str = "source_file") -> DataFrame:
    """For each file: lines read, loaded and rejected, and PASS if they add up."""
    bad = F.col("reason").isNotNull()
    done = outcome.groupBy(by).agg(F.count_if(~bad).alias("lines_clean"), F.count_if(bad).alias("lines_rejected"))
    read = lines.groupBy(by).agg(F.count("*").alias("lines_in"))
    both = read.join(done, by, "left").na.fill(0, ["lines_clean", "lines_rejected"])
    return both.withColumn("verdict", F.when(F.col("lines_in") == F.col("lines_clean") + F.col("lines_rejected"), "PASS").otherwise("FAIL"))


def job_ledger(per_file: DataFrame, listing: DataFrame | None = None, failed: DataFrame | None = None) -> DataFrame:
    """One row for each file, from its line counts; listed files without lines are FAILED, and so are those in ``failed``."""
    rows = per_file.select(
        "source_file",
        F.col("lines_clean").alias("records_valid"),
        F.col("lines_rejected").alias("records_invalid"),
        "orders_loaded",
        *(c for c in per_file.columns if c == "orders_sketch"),
    )
    if listing is not None:
        rows = rows.join(listing.select("source_file"), "source_file", "full_outer").na.fill(0)
    rows = rows.withColumn("status", job_status(F.col("records_valid"), F.col("records_invalid")))
    if failed is not None:
        rows = rows.join(failed.select("source_file", F.lit(True).alias("__f")), "source_file", "left")
        rows = rows.withColumn("status", F.when(F.col("__f"), "FAILED").otherwise(F.col("status"))).drop("__f")
    return rows


def job_status(valid: Column, invalid: Column, running: Column | None = None, failed: Column | None = None, partial_above: str = "0.25") -> Column:
    """FAILED, RUNNING, SUCCESS or PARTIAL (over a quarter rejected)."""
    share = F.try_divide(invalid.cast("decimal(20,6)"), (valid + invalid).cast("decimal(20,6)"))
    first = F.when(failed if failed is not None else F.lit(False), "FAILED").when(running if running is not None else F.lit(False), "RUNNING")
    return (
        first.when(valid == 0, "FAILED")
        .when(invalid == 0, "SUCCESS")
        .when(share > F.lit(partial_above).cast("decimal(4,2)"), "PARTIAL")
        .otherwise("SUCCESS")
    )


def recent_runs(ledger: DataFrame, as_of: Column, most: int = 50) -> DataFrame:
    """The newest ledger rows with their reject percentage and derived status (``finished_at``, ``duration_ms`` given)."""
    total = F.col("records_valid") + F.col("records_invalid")
    running = F.col("duration_ms").isNull() & (F.col("finished_at") > as_of - F.expr("interval 10 minutes"))
    status = job_status(F.col("records_valid"), F.col("records_invalid"), running, F.col("status") == "FAILED")
    shown = ledger.withColumn("reject_pct", percentage(F.col("records_invalid"), total)).withColumn("status", status)
    return shown.orderBy(F.desc("finished_at"), "source_file").limit(most)


def settled(ledger: DataFrame, true_counts: DataFrame) -> DataFrame:
    """Files whose ledger accounts for every line read (``lines_in``)."""
    joined = ledger.join(true_counts.select("source_file", "lines_in"), "source_file")
    return joined.filter(F.col("records_valid") + F.col("records_invalid") == F.col("lines_in")).select("source_file")


def run_summary(decided: DataFrame, facts_: DataFrame, customers: DataFrame, products: DataFrame, files: DataFrame, checks: DataFrame) -> DataFrame:
    """One row of totals with a verdict: PASS if no check and no file failed."""
    bad = F.col("reason").isNotNull()
    parts = [
        decided.agg(F.count("*").alias("staged"), F.count_if(bad).alias("rejected")),
        facts_.agg(
            F.count("*").alias("fact_rows"), F.count_distinct("order_id").alias("orders"), F.coalesce(F.sum("total_price"), F.lit(0)).cast("decimal(24,4)").alias("revenue")
        ),
        customers.agg(F.count_if(F.col("is_current")).alias("current_customers")),
        products.agg(F.count("*").alias("products")),
        files.agg(F.count("*").alias("files"), F.count_if(F.col("status") == "FAILED").alias("failed_files")),
        checks.agg(F.count_if(~F.col("pass")).alias("failed_checks")),
    ]
    one = parts[0]
    for p in parts[1:]:  # one row each
        one = one.crossJoin(p)
    verdict = F.when((F.col("failed_checks") == 0) & (F.col("failed_files") == 0), "PASS").otherwise("FAIL")
    return one.withColumn("verdict", verdict)


def stage_log(batch_id: str, stage: str, rows: DataFrame, started: Column, finished: Column) -> DataFrame:
    """A run log row: the stage's row count and how long it took."""
    return rows.agg(F.count("*").alias("rows")).select(
        F.lit(batch_id).alias("batch_id"), F.lit(stage).alias("stage"), "rows", started.alias("started_at"), (F.unix_millis(finished) - F.unix_millis(started)).alias("duration_ms")
    )


def metrics(one: DataFrame, batch_id: str, package: str) -> DataFrame:
    """A row of numbers in long form: (batch_id, package, metric, value)."""
    wide = one.select(*(F.col(c).cast("decimal(20,4)").alias(c) for c in one.columns))
    return wide.unpivot([], wide.columns, "metric", "value").select(F.lit(batch_id).alias("batch_id"), F.lit(package).alias("package"), "metric", "value")


def retained(df: DataFrame, ts: str, as_of: Column, keep: str = "6 hours") -> DataFrame:
    """Rows that are no older than ``keep``."""
    return df.filter(F.col(ts) >= as_of - F.expr(f"interval {keep}"))
