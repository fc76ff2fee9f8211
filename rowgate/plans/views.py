"""The reports over a loaded warehouse, as named views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgate.functions.scalar import percentage
from rowgate.operators import rollup
from rowgate.operators.warehouse import recent_runs


def views(orders: DataFrame, items: DataFrame, rejects: DataFrame, alerts: DataFrame, ledger: DataFrame, as_of: Column, interval: str = "1 minute") -> dict[str, DataFrame]:
    """``orders`` and ``items`` have ``ingest_ts``, ``rejects`` ``quarantined_at``, ``alerts`` ``alert_ts``; ``ledger`` ``finished_at`` and ``duration_ms``."""
    revenue = F.sum("order_total").alias("revenue")
    made = rollup.per_interval(orders, "ingest_ts", interval, F.count("*").alias("orders"), revenue)
    good = rollup.per_interval(items, "ingest_ts", interval, F.count("*").alias("valid"))
    bad = rollup.per_interval(rejects, "quarantined_at", interval, F.count("*").alias("rejected"))
    quality = good.join(bad, "bucket", "full_outer").na.fill(0)
    total = F.col("valid") + F.col("rejected")
    sold = items.groupBy("sku").agg(F.sum("qty").alias("units"), F.sum("line_total").alias("revenue"))
    counts = ledger.agg(
        F.count("*").alias("files"),
        F.count_if(F.col("status") == "FAILED").alias("failed_files"),
        F.coalesce(F.sum("records_valid"), F.lit(0)).alias("valid"),
        F.coalesce(F.sum("records_invalid"), F.lit(0)).alias("rejected"),
    )
    per_file = orders.groupBy("batch_id").agg(F.sum("order_total").alias("revenue"), F.count("*").alias("orders"))
    return {
        "orders_per_minute": made,
        "revenue_by_category": items.groupBy("category").agg(F.sum("line_total").alias("revenue"), F.count_distinct("order_id").alias("orders")),
        "top_skus": rollup.latest(sold, 20, F.desc("revenue"), "sku"),
        "quality_per_minute": quality.withColumn("reject_pct", percentage(F.col("rejected"), total)),
        "recent_runs": recent_runs(ledger, as_of),
        "recent_alerts": rollup.latest(alerts, 200, F.desc("alert_ts"), "order_id", "alert_type"),
        "recent_rejects": rollup.latest(rejects, 25, F.desc("quarantined_at"), "order_id", "line_no"),
        "reject_reasons": rollup.histogram(rejects, "reason"),
        "alert_kinds": alerts.groupBy("alert_type", "severity").agg(F.count("*").alias("n")),
        "summary": counts.withColumn("reject_pct", percentage(F.col("rejected"), total)),
        "failed_files": ledger.filter("status = 'FAILED'").select("source_file", "records_invalid"),
        "file_ledger": ledger.join(per_file, F.regexp_replace("source_file", r"\.[^.]*$", "") == F.col("batch_id"), "left").drop("batch_id"),
        "orphan_orders": orders.join(ledger.select("source_file"), "source_file", "left_anti"),
    }
