"""Faults with a known outcome, put into record lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fault, the column it spoils, and the reason that it must be rejected for.
FAULTS = (
    ("missing_field", "customer_id", "NULL_CRITICAL"),
    ("wrong_type", "qty", "PARSE_ERROR"),
    ("bad_values", "qty", "RANGE_VIOLATION"),
    ("unknown_sku", "sku", "UNKNOWN_SKU"),
    ("unknown_customer", "customer_id", "UNKNOWN_CUSTOMER"),
    ("late_timestamp", "order_ts", "BAD_TIMESTAMP"),
    ("unicode_currency", "currency", "BAD_CURRENCY"),
)


def seed(lines: DataFrame, percent: float, keys: list[str], random: int = 1) -> DataFrame:
    """Text lines of which so many percent get one fault each, by a hash of their keys, with ``fault`` and ``expected_reason``."""
    draw = F.pmod(F.xxhash64(*keys, F.lit(random)), F.lit(1_000_000))
    which = F.pmod(F.xxhash64(*keys, F.lit(random + 1)), F.lit(len(FAULTS)))
    hit = draw < int(percent * 10_000)

    def pick(i: int) -> F.Column:
        names = F.array(*(F.lit(f[i]) for f in FAULTS))
        return F.when(hit, F.element_at(names, which.cast("int") + 1))

    out = lines.withColumns({"fault": pick(0), "expected_reason": pick(2)})
    spoiled = {
        "customer_id": F.when(F.col("fault") == "missing_field", F.lit(None)).when(F.col("fault") == "unknown_customer", "CUST-none").otherwise(F.col("customer_id")),
        "qty": F.when(F.col("fault") == "wrong_type", "two").when(F.col("fault") == "bad_values", "0").otherwise(F.col("qty")),
        "sku": F.when(F.col("fault") == "unknown_sku", "SKU-none").otherwise(F.col("sku")),
        "order_ts": F.when(F.col("fault") == "late_timestamp", (F.col("order_ts").cast("long") + 10 * 365 * 86_400_000).cast("string")).otherwise(F.col("order_ts")),
        "currency": F.when(F.col("fault") == "unicode_currency", "₹").otherwise(F.col("currency")),
    }
    return out.withColumns(spoiled)


#: More ways to the same reasons: fault, column, what it becomes (None: nothing is there), reason.
VARIANTS = (
    ("missing_field", "customer_id", None, "NULL_CRITICAL"),
    ("missing_field", "sku", " ", "NULL_CRITICAL"),
    ("missing_field", "order_ts", None, "NULL_CRITICAL"),
    ("missing_field", "unit_price", "", "NULL_CRITICAL"),
    ("wrong_type", "qty", "1 dozen", "PARSE_ERROR"),
    ("wrong_type", "line_no", "first", "PARSE_ERROR"),
    ("wrong_type", "unit_price", "free", "PARSE_ERROR"),
    ("wrong_type", "order_ts", "soon", "PARSE_ERROR"),
    ("bad_values", "qty", "0", "RANGE_VIOLATION"),
    ("bad_values", "qty", "-4", "RANGE_VIOLATION"),
    ("bad_values", "qty", "1000", "RANGE_VIOLATION"),
    ("bad_values", "unit_price", "0.001", "RANGE_VIOLATION"),
    ("unknown_sku", "sku", "SKU-none", "UNKNOWN_SKU"),
    ("unknown_customer", "customer_id", "CUST-none", "UNKNOWN_CUSTOMER"),
    ("late_timestamp", "order_ts", "1", "BAD_TIMESTAMP"),
    ("late_timestamp", "order_ts", "9000000000000", "BAD_TIMESTAMP"),
    ("unicode_currency", "currency", "₹", "BAD_CURRENCY"),
    ("unicode_currency", "currency", None, "BAD_CURRENCY"),
)


def variants(lines: DataFrame, percent: float, keys: list[str], random: int = 1) -> DataFrame:
    """As ``seed``, with one of ``VARIANTS`` for each spoiled line."""
    hit = F.pmod(F.xxhash64(*keys, F.lit(random)), F.lit(1_000_000)) < int(percent * 10_000)
    which = F.when(hit, F.pmod(F.xxhash64(*keys, F.lit(random + 1)), F.lit(len(VARIANTS))))
    changed: dict[str, F.Column] = {}
    for n, (_, column, becomes, _) in enumerate(VARIANTS):
        value = F.lit(becomes).cast("string")
        changed[column] = (changed[column] if column in changed else F).when(F.col("__v") == n, value)
    named = {
        name: F.when(F.col("__v").isNotNull(), F.element_at(F.array(*(F.lit(v[i]) for v in VARIANTS)), F.col("__v").cast("int") + 1))
        for name, i in (("fault", 0), ("expected_reason", 3))
    }
    spoiled = {c: e.otherwise(F.col(c)) for c, e in changed.items()}
    return lines.withColumn("__v", which).withColumns(named | spoiled).drop("__v")


def replay(lines: DataFrame, percent: float, keys: list[str], random: int = 1) -> DataFrame:
    """So many percent of the lines, to be fed once more, marked ``replayed``."""
    hit = F.pmod(F.xxhash64(*keys, F.lit(random + 2)), F.lit(1_000_000)) < int(percent * 10_000)
    return lines.filter(hit).withColumn("replayed", F.lit(True))


def rebase(lines: DataFrame, shift_ms: int) -> DataFrame:
    """All order times moved by ``shift_ms``; what doesn't parse stays as it is."""
    moved = (F.col("order_ts").try_cast("bigint") + shift_ms).cast("string")
    return lines.withColumn("order_ts", F.coalesce(moved, F.col("order_ts")))
