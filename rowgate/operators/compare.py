"""Comparing two runs: per file, per reason, per record; and checking one run against its contract."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgate.contract import REASONS
from rowgate.functions.scalar import percentage
from rowgate.operators.flow import rank_in_key
from rowgate.operators.rollup import histogram

RECORD = ("source_file", "order_id", "line_no")


def log(**sides: DataFrame) -> DataFrame:
    """Reject logs of runs as one, each row with its ``side``."""
    frames = [df.select(F.lit(name).alias("side"), *RECORD, "reason") for name, df in sides.items()]
    return reduce(DataFrame.unionByName, frames)


def log_of(judged: DataFrame, sides: tuple[str, ...]) -> DataFrame:
    """The log of runs that judged the same lines side by side (``reason_a`` and so on, null: clean), in one scan."""
    found = [F.when(F.col(f"reason_{s}").isNotNull(), F.struct(F.lit(s).alias("side"), F.col(f"reason_{s}").alias("reason"))) for s in sides]
    return judged.select(*RECORD, F.explode(F.array_compact(F.array(*found))).alias("r")).select("r.side", *RECORD, "r.reason")


def paired(rows: DataFrame, keys: tuple[str, ...], values: list[str]) -> DataFrame:
    """The sides ``a`` and ``b`` of a log beside each other: ``keys``, ``occurrence``, and each value suffixed ``_a`` and ``_b``.

    Null keys pair with null keys, and the n-th row of a repeated key with the other side's n-th by the values. One deal by
    the keys serves both the numbering and the pairing.
    """
    ranked = rank_in_key(rows.repartition(*keys), [*keys, "side"], values, "occurrence")
    own = [F.any_value(F.when(F.col("side") == s, F.col(v)), True).alias(f"{v}_{s}") for v in values for s in "ab"]
    has = [F.bool_or(F.col("side") == s).alias(f"in_{s}") for s in "ab"]
    return ranked.groupBy(*keys, "occurrence").agg(*own, *has)


def compare_files(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per-file counts (``lines_clean``, ``lines_rejected``) beside each other, with a verdict."""
    names = ("lines_clean", "lines_rejected")
    left = a.select("source_file", *(F.col(c).alias(f"{c}_a") for c in names), F.lit(True).alias("in_a"))
    right = b.select("source_file", *(F.col(c).alias(f"{c}_b") for c in names), F.lit(True).alias("in_b"))
    verdict = (
        F.when(F.col("in_a").isNull(), "not in A yet")
        .when(F.col("in_b").isNull(), "not in B yet")
        .when(F.coalesce("lines_rejected_a", F.lit(0)) != F.coalesce("lines_rejected_b", F.lit(0)), "rejects differ")
        .when(F.coalesce("lines_clean_a", F.lit(0)) != F.coalesce("lines_clean_b", F.lit(0)), "loaded differ")
        .otherwise("agree")
    )
    return left.join(right, "source_file", "full_outer").withColumn("verdict", verdict).drop("in_a", "in_b")


def unified_rejects(rows: DataFrame | None = None, **logs: DataFrame) -> DataFrame:
    """Reject logs of several runs, or a ``log`` of them, as one, each row with its ``engine``."""
    rows = log(**logs) if rows is None else rows
    return rows.select(F.col("side").alias("engine"), *(F.col(c).cast("string").alias(c) for c in (*RECORD, "reason")))


def reason_counts(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """Rejects by reason on both sides and their difference, 0 where one has none; alone ``a`` is a ``log`` of both."""
    rows = a if b is None else log(a=a, b=b)
    counted = rows.groupBy("reason").agg(*(F.count_if(F.col("side") == s).alias(f"n_{s}") for s in "ab"))
    return counted.withColumn("delta", F.col("n_a") - F.col("n_b"))


def side_by_side(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """One row for each rejected record: the reasons of both sides, and same, only A, only B or different.

    ``a`` and ``b`` are reject logs; alone ``a`` is a ``log`` of both sides.
    """
    both = paired(a if b is None else log(a=a, b=b), RECORD, ["reason"])
    status = (
        F.when(~F.col("in_b"), "only in A")
        .when(~F.col("in_a"), "only in B")
        .when(~F.col("reason_a").eqNullSafe(F.col("reason_b")), "different reason")
        .otherwise("same")
    )
    return both.select(*RECORD, "occurrence", "reason_a", "reason_b", status.alias("status"))


def reject_diff(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """Records on which the sides disagree; none is a pass."""
    return side_by_side(a, b).filter(F.col("status") != "same")


def agreement(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """One row: decisions, agreeing ones, their percentage; 100 without decisions."""
    one = side_by_side(a, b).agg(F.count("*").alias("decisions"), F.count_if(F.col("status") == "same").alias("agreeing"))
    share = F.when(F.col("decisions") == 0, F.lit(100).cast("decimal(20,2)")).otherwise(percentage(F.col("agreeing"), F.col("decisions"), 2))
    return one.withColumn("agreement_pct", share)


def disagreements_first(sides: DataFrame, at: str | None = None) -> DataFrame:
    """Disagreements, then the newest by ``at`` where the rows have it, then by record."""
    newest = [F.desc(at)] if at else []
    return sides.orderBy(F.col("status") == "same", *newest, "order_id", "line_no", "source_file", "occurrence")


def by_delta(counts: DataFrame) -> DataFrame:
    """The largest differences first."""
    return counts.orderBy(F.abs("delta").desc(), "reason")


def headline(decided: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Totals of a run, of settled files only if ``files`` is given, as (measure, value) rows."""
    rows = decided if files is None else decided.join(files.select("source_file"), "source_file", "left_semi")
    clean = F.col("reason").isNull()
    one = rows.agg(
        F.count("*").alias("lines"),
        F.count_if(clean).alias("loaded"),
        F.count_if(~clean).alias("rejected"),
        F.count_distinct(F.when(clean, F.col("order_id"))).alias("orders"),
        F.coalesce(F.sum(F.when(clean, F.col("line_total"))), F.lit(0)).alias("revenue"),
    )
    return one.select(*(F.col(c).cast("decimal(20,2)").alias(c) for c in one.columns)).unpivot([], one.columns, "measure", "value")


def capture(decided: DataFrame, alerts: DataFrame) -> dict[str, DataFrame]:
    """A run's summary: ``scalars``, ``histograms``, ``sets``."""
    rejects = histogram(decided.filter("reason is not null"), "reason").select(F.lit("reasons").alias("name"), F.col("reason").alias("label"), "n")
    kinds = histogram(alerts, "alert_type").select(F.lit("alerts").alias("name"), F.col("alert_type").alias("label"), "n")
    keys = F.concat(F.col("order_id"), F.lit("#"), F.col("line_no").cast("string"))
    loaded = decided.filter("reason is null").select(F.lit("loaded").alias("name"), keys.alias("member"))
    lost = decided.filter("reason is not null").select(F.lit("rejected").alias("name"), keys.alias("member"))
    return {"scalars": headline(decided), "histograms": rejects.unionByName(kinds), "sets": loaded.unionByName(lost).distinct()}


def diff_captures(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> DataFrame:
    """``part``, ``item``, ``a``, ``b``: scalars and bars that differ, and how many members only one side's sets have."""

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("decimal(20,2)").cast("string"), F.lit("0.00"))

    def values(part: str, x: DataFrame, y: DataFrame, item: Column, value: str) -> DataFrame:
        left, right = x.select(item.alias("item"), F.col(value).alias("va")), y.select(item.alias("item"), F.col(value).alias("vb"))
        rows = left.join(right, "item", "full_outer").select(F.lit(part).alias("part"), "item", text("va").alias("a"), text("vb").alias("b"))
        return rows.filter(F.col("a") != F.col("b"))

    bars = F.concat_ws(":", "name", "label")
    sets = set_members(a["sets"], b["sets"]).filter("only_a + only_b > 0")
    return (
        values("scalar", a["scalars"], b["scalars"], F.col("measure"), "value")
        .unionByName(values("histogram", a["histograms"], b["histograms"], bars, "n"))
        .unionByName(sets.select(F.lit("set").alias("part"), F.col("name").alias("item"), text("only_a").alias("a"), text("only_b").alias("b")))
    )


def write_capture(capture_: dict[str, DataFrame], path: str) -> None:
    """A capture to compare with later: a folder for each part."""
    for part, df in capture_.items():
        df.write.parquet(f"{path}/{part}")


def read_capture(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {part: spark.read.parquet(f"{path}/{part}") for part in ("scalars", "histograms", "sets")}


def set_members(a: DataFrame, b: DataFrame, samples: int = 5) -> DataFrame:
    """For each ``name``: how many distinct members only A has, only B has, both have, and the first members that one lacks."""
    sides = a.select("name", "member", F.lit(True).alias("a")).unionByName(b.select("name", "member", F.lit(False).alias("a")))
    has = sides.groupBy("name", "member").agg(F.bool_or("a").alias("in_a"), F.bool_or(~F.col("a")).alias("in_b"))
    only_a, only_b = F.col("in_a") & ~F.col("in_b"), F.col("in_b") & ~F.col("in_a")
    counts = has.groupBy("name").agg(
        F.count_if(only_a).alias("only_a"), F.count_if(only_b).alias("only_b"), F.count_if(F.col("in_a") & F.col("in_b")).alias("both")
    )
    first = rank_in_key(has.filter(only_a | only_b), ["name", "in_a"], ["member"], "n").filter(F.col("n") <= samples)
    shown = [F.array_join(F.array_sort(F.collect_list(F.when(side, F.col("member")))), ",").alias(n) for side, n in ((only_a, "sample_a"), (only_b, "sample_b"))]
    return counts.join(first.groupBy("name").agg(*shown), "name", "left").na.fill("", ["sample_a", "sample_b"])


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` that ``b`` lacks, null equal to null."""
    return a.subtract(b)


def set_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def vocabulary(rejects: DataFrame, declared: tuple[str, ...] = REASONS) -> DataFrame:
    """``reason``, ``finding``: undeclared reasons that occur, declared ones that don't."""
    spark = rejects.sparkSession
    known = spark.createDataFrame([(r,) for r in declared], "reason string")
    seen = rejects.select("reason").distinct()
    extra = seen.join(known, "reason", "left_anti").withColumn("finding", F.lit("undeclared"))
    return extra.unionByName(known.join(seen, "reason", "left_anti").withColumn("finding", F.lit("not seen")))


def loaded_and_rejected(items: DataFrame, rejects: DataFrame) -> DataFrame:
    """Lines that were loaded and, with the same payload, rejected for another reason than DUP_KEY."""
    columns = ("order_id", "line_no", "sku", "qty", "unit_price")
    left = items.select(*(F.col(c).cast("string").alias(c) for c in columns))
    right = rejects.filter("reason <> 'DUP_KEY'").select(*(F.col(c).cast("string").alias(c) for c in columns), "reason")
    return left.join(right, list(columns))


def conformance(items: DataFrame, rejects: DataFrame, alerts: DataFrame, orders: DataFrame, ledger: DataFrame, severities: dict[str, str]) -> DataFrame:
    """Six checks of a run: ``check_name``, ``violations``, ``pass``."""
    spark = items.sparkSession
    declared = spark.createDataFrame(list(severities.items()), "alert_type string, severity string")

    def n(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")

    keys = items.groupBy("order_id", "line_no").agg(F.count("*").alias("n")).filter("n > 1")
    order_keys = orders.groupBy("order_id").agg(F.count("*").alias("n")).filter("n > 1")
    checks = [
        n("reasons_declared", vocabulary(rejects).filter("finding = 'undeclared'")),
        n("order_keys_unique", order_keys),
        n("item_keys_unique", keys),
        n("alert_severities", alerts.select("alert_type", "severity").distinct().join(declared, ["alert_type", "severity"], "left_anti")),
        n("ledger_covers_orders", orders.join(ledger.select("source_file"), "source_file", "left_anti")),
        n("loaded_or_rejected", loaded_and_rejected(items, rejects)),
    ]
    return reduce(DataFrame.unionByName, checks).withColumn("pass", F.col("violations") == 0)


def replay_checks(loaded: DataFrame, again: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Checks of a run that was fed once more: no line loads again, and every reject keeps its payload."""
    keys = again.select("order_id", "line_no").join(loaded.select("order_id", "line_no"), ["order_id", "line_no"], "left_semi")
    bare = quarantined.filter(F.coalesce(F.trim("raw_payload"), F.lit("")) == "")
    checks = [df.agg(F.count("*").alias("violations")).withColumn("check_name", F.lit(n)) for n, df in (("replay_safe", keys), ("payload_kept", bare))]
    return reduce(DataFrame.unionByName, checks).withColumn("pass", F.col("violations") == 0)


def expected_vs_actual(rows: DataFrame, expected: str = "expected_reason", actual: str = "reason") -> DataFrame:
    """The confusion table of a run over rows of known outcome (null: clean)."""
    clean = F.lit("CLEAN")
    return rows.groupBy(F.coalesce(expected, clean).alias("expected"), F.coalesce(actual, clean).alias("actual")).agg(F.count("*").alias("n"))


def oracle_diff(expected: DataFrame, actual: DataFrame, key: str, side: str) -> DataFrame:
    """Row by row: missing, unexpected, on the wrong side, or on both sides."""
    act = actual.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(side)), "+").alias("got"), F.count("*").alias("n"))
    both = expected.select(F.col(key), F.col(side).alias("want")).join(act, key, "full_outer")
    finding = (
        F.when(F.col("got").isNull(), "missing")
        .when(F.col("want").isNull(), "unexpected")
        .when(F.contains("got", F.lit("+")), "both sides")
        .when(F.col("got") != F.col("want"), "wrong side")
    )
    return both.withColumn("finding", finding).filter("finding is not null").select(key, "want", "got", "finding")
