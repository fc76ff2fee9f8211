"""Order rollups, per-file counts, histograms and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgate.functions.scalar import percentage

HEADER = ("customer_id", "order_ts", "status", "channel", "payment_type", "currency", "batch_id", "source_file")


def orders(items: DataFrame, header: tuple[str, ...] = HEADER, dealt: str | None = None) -> DataFrame:
    """One row for each order: the largest of each header value, the sum of totals (decimal, so in any order) and quantities.

    ``dealt`` is a column that the items of an order share and are dealt by already, so that they needn't be dealt again.
    """
    own = [c for c in header if c in items.columns]
    return items.groupBy(*([dealt] if dealt else []), "order_id").agg(
        *(F.max(c).alias(c) for c in own),
        F.sum(F.col("line_total").cast("decimal(14,2)")).alias("order_total"),
        F.sum("qty").cast("bigint").alias("item_count"),
    ).drop(*([dealt] if dealt else []))


def histogram(df: DataFrame, label: str, count: str = "n") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias(count))


def per_file(decided: DataFrame, by: str = "source_file", sketch: int | None = None, dealt: str | None = None) -> DataFrame:
    """From lines with a null or set ``reason``: lines in, clean, rejected, orders, revenue for each file.

    Lines are added up by file and order first, so that a file's orders are counted without being gathered. With ``sketch`` (12, say)
    also ``orders_sketch``, as ``with_sketch`` has it. ``dealt`` is as in ``orders``.
    """
    clean = F.col("reason").isNull()
    total = F.when(clean, F.col("line_total").cast("decimal(14,2)"))
    by_order = decided.groupBy(*([dealt] if dealt else []), by, "order_id").agg(
        F.count("*").alias("n"), F.count_if(clean).alias("good"), F.sum(total).cast("decimal(18,2)").alias("revenue")
    )
    loaded = (F.col("good") > 0) & F.col("order_id").isNotNull()
    own = [F.hll_sketch_agg(F.when(loaded, F.col("order_id")), sketch).alias("orders_sketch")] if sketch else []
    return by_order.groupBy(by).agg(
        F.sum("n").alias("lines_in"),
        F.sum("good").alias("lines_clean"),
        F.sum(F.col("n") - F.col("good")).alias("lines_rejected"),
        F.count_if(loaded).alias("orders_loaded"),
        F.coalesce(F.sum("revenue"), F.lit(0)).cast("decimal(18,2)").alias("revenue"),
        *own,
    )


def with_sketch(decided: DataFrame, by: str = "source_file", size: int = 12) -> DataFrame:
    """``per_file`` with ``orders_sketch``, from which the distinct orders of several loads of a file can be told without their lines.

    A sketch has 2^``size`` registers at most; what is told from it is off by 1.6 % (one standard deviation) at 12.
    """
    clean = F.col("reason").isNull()
    total = F.when(clean, F.col("line_total").cast("decimal(14,2)"))
    return decided.groupBy(by).agg(
        F.count("*").alias("lines_in"),
        F.count_if(clean).alias("lines_clean"),
        F.count_if(~clean).alias("lines_rejected"),
        F.coalesce(F.sum(total), F.lit(0)).cast("decimal(18,2)").alias("revenue"),
        F.hll_sketch_agg(F.when(clean, F.col("order_id")), size).alias("orders_sketch"),
    )


def merged(ledger: DataFrame, by: str = "source_file") -> DataFrame:
    """Loads of one file (or of whatever ``by`` is) as one: counts add up, and ``orders`` counts an order of several loads once."""
    return ledger.groupBy(by).agg(
        *(F.sum(c).cast("bigint").alias(c) for c in ("lines_in", "lines_clean", "lines_rejected")),
        F.sum("revenue").cast("decimal(18,2)").alias("revenue"),
        F.hll_sketch_estimate(F.hll_union_agg("orders_sketch")).alias("orders"),
        F.hll_union_agg("orders_sketch").alias("orders_sketch"),
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def feed_profile(df: DataFrame, faults: dict[str, Column], keys: list[str], order: str) -> DataFrame:
    """One row: lines, orders, lines that show each fault, lines beyond the first of their key, most lines of an order."""
    hits = [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in faults.items()]
    by_key = df.groupBy(*keys).agg(F.count("*").alias("lines"), *hits)
    by_order = by_key.groupBy(order).agg(
        F.sum("lines").alias("lines"), F.sum(F.col("lines") - 1).alias("dup_keys"), *(F.sum(n).alias(n) for n in faults)
    )
    return by_order.agg(
        F.sum("lines").alias("lines"),
        F.count("*").alias("orders"),
        F.sum("dup_keys").alias("dup_keys"),
        F.max("lines").alias("most_lines_of_an_order"),
        *(F.sum(n).alias(n) for n in faults),
    )


def reason_list(df: DataFrame, by: str) -> DataFrame:
    """The distinct reasons of each group, sorted, comma-joined."""
    return df.groupBy(by).agg(F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))


def quality(df: DataFrame, by: str) -> DataFrame:
    """Valid, rejected and the rejected percentage of each group."""
    bad = F.col("reason").isNotNull()
    counted = df.groupBy(by).agg(F.count_if(~bad).alias("valid"), F.count_if(bad).alias("rejected"))
    return counted.withColumn("reject_pct", percentage(F.col("rejected"), F.col("valid") + F.col("rejected")))


def per_interval(df: DataFrame, ts: str, interval: str, *measures: Column) -> DataFrame:
    """Tumbling windows of any length: ``bucket`` is the window's start."""
    return df.groupBy(F.window(ts, interval)["start"].alias("bucket")).agg(*measures)


def long_form(row: DataFrame, name: str = "measure", value: str = "value") -> DataFrame:
    """A wide row of numbers as (measure, value) rows."""
    columns = [F.col(c).cast("decimal(20,2)").alias(c) for c in row.columns]
    return row.select(*columns).unpivot([], row.columns, name, value)


def latest(df: DataFrame, n: int, *by: Column | str) -> DataFrame:
    """The report's newest rows: a limit is what is asked for."""
    return df.orderBy(*by).limit(n)
