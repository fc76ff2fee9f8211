"""The reject ladder: ordered rules, one reason a row, in a single projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgate.contract import REQUIRED, Contract
from rowgate.functions.scalar import blank, parse_int, parse_long, parse_number


@dataclass(frozen=True)
class Rule:
    """``fails`` is true for a row to reject; null counts as false."""

    reason: str
    fails: Column
    detail: Column


def ladder(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``df`` with ``reason`` and ``detail`` of the first rule that fails; both null where none does."""
    reason = detail = None
    for r in rules:
        fails = F.coalesce(r.fails, F.lit(False))
        reason = F.when(fails, r.reason) if reason is None else reason.when(fails, r.reason)
        detail = F.when(fails, r.detail) if detail is None else detail.when(fails, r.detail)
    none = F.lit(None).cast("string")
    return df.withColumns({"reason": none if reason is None else reason, "detail": none if detail is None else detail})


def typed(df: DataFrame) -> DataFrame:
    """Raw text lines with ``line_no_v``, ``qty_v``, ``price_v``, ``ts_v`` and ``total_v``, null where they don't parse."""
    return df.withColumns(
        {
            "line_no_v": parse_int(F.col("line_no")),
            "qty_v": parse_int(F.col("qty")),
            "price_v": parse_number(F.col("unit_price")),
            "ts_v": parse_long(F.col("order_ts")),
            "total_v": parse_number(F.col("line_total")),
        }
    )


def missing_fields(fields: tuple[str, ...] = REQUIRED) -> Column:
    return F.array_compact(F.array(*(F.when(blank(F.col(f)), F.lit(f)) for f in fields)))


def wire_types(variant: str = "raw_line") -> Column:
    """Strict mode: whether the JSON types are the declared ones, without coercion (a quoted number isn't one)."""
    v = F.try_parse_json(variant)
    ok = F.lit(True)
    for name, kinds in (("line_no", ("BIGINT",)), ("qty", ("BIGINT",)), ("order_ts", ("BIGINT",)), ("unit_price", ("BIGINT", "DOUBLE", "DECIMAL"))):
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        ok = ok & F.coalesce(F.regexp_extract(kind, "^[A-Z]+", 0).isin(*kinds), F.lit(False))
    return ok


def order_rules(contract: Contract, as_of_ms: int, known_sku: Column, known_customer: Column, strict: Column | None = None) -> list[Rule]:
    """The ladder over ``typed`` lines. ``strict``, if given, holds where the wire types are the declared ones."""
    limits = contract.limits
    lines, qty, price, ts = (F.col(c) for c in ("line_no_v", "qty_v", "price_v", "ts_v"))
    window = limits.window_days * 86_400_000
    rules = [
        Rule("NULL_CRITICAL", F.size(missing_fields()) > 0, F.concat(F.lit("missing "), F.array_join(missing_fields(), ","))),
    ]
    if strict is not None:
        rules.append(Rule("PARSE_ERROR", ~strict, F.lit("value of another type than declared")))
    rules += [
        Rule("PARSE_ERROR", lines.isNull(), F.concat(F.lit("line_no "), F.coalesce("line_no", F.lit("is empty")))),
        Rule("PARSE_ERROR", qty.isNull(), F.concat(F.lit("quantity "), F.col("qty"))),
        Rule("RANGE_VIOLATION", ~qty.between(*limits.qty), F.concat(F.lit("quantity "), qty.cast("string"))),
        Rule("PARSE_ERROR", price.isNull(), F.concat(F.lit("unit_price "), F.col("unit_price"))),
        Rule(
            "RANGE_VIOLATION",
            ~price.between(*(float(x) for x in limits.price)) | F.isnan(price),
            F.concat(F.lit("unit_price "), F.col("unit_price")),
        ),
        Rule("UNKNOWN_SKU", ~known_sku, F.concat(F.lit("sku "), F.col("sku"), F.lit(" is in no catalogue"))),
        Rule("UNKNOWN_CUSTOMER", ~known_customer, F.concat(F.lit("customer "), F.col("customer_id"), F.lit(" is unknown"))),
        Rule("PARSE_ERROR", ts.isNull(), F.lit("order_ts is no epoch in milliseconds")),
        Rule("BAD_TIMESTAMP", F.abs(F.lit(as_of_ms) - ts) > window, F.format_string("order_ts %s is over %s days away", ts, F.lit(limits.window_days))),
        bad_currency(limits.currencies),
    ]
    return rules


def bad_currency(allowed: tuple[str, ...]) -> Rule:
    code = F.upper(F.trim(F.coalesce("currency", F.lit(""))))
    return Rule("BAD_CURRENCY", ~code.isin(*allowed), F.concat(F.lit("currency "), F.coalesce("currency", F.lit(""))))


def passed(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reason").isNull())


def rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reason").isNotNull())


def consistency(df: DataFrame, qty: str, price: str, total: str, tolerance: str = "0.02") -> DataFrame:
    """``quality_status`` (VALID or CLEANED), ``defects`` (JSON) and ``line_total_fixed`` where total isn't qty times price."""
    computed = F.round(F.col(qty).cast("decimal(10,0)") * F.col(price).cast("decimal(14,4)"), 2).cast("decimal(14,2)")
    off = F.abs(F.col(total).cast("decimal(14,2)") - computed) > F.lit(tolerance).cast("decimal(14,2)")
    off = F.coalesce(off, F.lit(True))
    note = F.array(F.concat(F.lit("line_total_fixed:"), computed.cast("string")))
    return df.withColumns(
        {
            "quality_status": F.when(off, "CLEANED").otherwise("VALID"),
            "defects": F.to_json(F.when(off, note).otherwise(F.array().cast("array<string>"))),
            "line_total_fixed": F.when(off, computed).otherwise(F.col(total).cast("decimal(14,2)")),
        }
    )


def alerts(df: DataFrame, contract: Contract) -> DataFrame:
    """A row for each alert that a line raises, in one scan: ``alert_type``, ``severity``, ``metric_value`` and the line."""
    raised = [
        F.when(
            F.col(a.metric).cast("decimal(14,2)") > F.lit(a.above).cast("decimal(14,2)"),
            F.struct(
                F.lit(a.name).alias("alert_type"),
                F.lit(a.severity).alias("severity"),
                F.col(a.metric).cast("decimal(14,2)").alias("metric_value"),
            ),
        )
        for a in contract.alerts
    ]
    return df.withColumn("__a", F.explode(F.array_compact(F.array(*raised)))).select("__a.*", *df.columns)


def normalise_text(df: DataFrame, upper: tuple[str, ...] = (), lower: tuple[str, ...] = (), trim: tuple[str, ...] = ()) -> DataFrame:
    """Trimmed text columns, upper or lower case where asked."""
    changed = {c: F.upper(F.trim(c)) for c in upper} | {c: F.lower(F.trim(c)) for c in lower} | {c: F.trim(c) for c in trim}
    return df.withColumns(changed)
