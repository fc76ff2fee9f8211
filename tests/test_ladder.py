"""One fault, one reason; the first rule that fails decides."""

import json

import pytest
from pyspark.sql import functions as F

from rowgate.contract import Contract
from rowgate.operators.ladder import wire_types
from rowgate.plans.order_lines import decide, process
from rowgate.sources.files import parse_json_lines, stamp

AS_OF = 1_750_000_000_000
BASE = {
    "order_id": "ORD-1", "line_no": 1, "customer_id": "CUST-00001", "order_ts": AS_OF, "status": "PAID", "channel": "WEB",
    "payment_type": "CARD", "currency": "USD", "sku": "SKU-0001", "qty": 3, "unit_price": 10.5, "line_total": 31.5,
}
DAY = 86_400_000
#: Rule, in order: what is put into a clean record, one field or several at once, and the value or values that break the rule alone.
BROKEN = {
    "NULL_CRITICAL": [{f: v} for f in ("order_id", "sku", "customer_id", "qty", "unit_price", "order_ts") for v in (None, "", "   ")],
    "PARSE_ERROR": [
        *({"line_no": v} for v in ("", None, "one", "N/A", "3.0")), *({"qty": v} for v in ("a dozen", "7.0", "1_0", "0x1")),
        *({"unit_price": v} for v in ("free", "1.2.3")), *({"order_ts": v} for v in ("yesterday", "1e3s")),
    ],
    "RANGE_VIOLATION": [*({"qty": v} for v in (-2, 1000, "-999999")), *({"unit_price": v} for v in (0, "-0.01", 10_000, "NaN", "Infinity"))],
    "UNKNOWN_SKU": [{"sku": "NO-SUCH"}, {"sku": "sku 0001"}],
    "UNKNOWN_CUSTOMER": [{"customer_id": "nobody"}],
    "BAD_TIMESTAMP": [{"order_ts": AS_OF + 366 * DAY}, {"order_ts": AS_OF - 366 * DAY}, {"order_ts": 0}],
    "BAD_CURRENCY": [{"currency": v} for v in ("JPY", "", None, "US D", "€")],
}
ACCEPTED = [
    {}, {"currency": " gbp "}, {"qty": 999}, {"qty": "+1 "}, {"unit_price": "9,999.99"}, {"unit_price": 0.01}, {"line_no": " 12"},
    {"order_ts": AS_OF + 365 * DAY}, {"sku": " SKU-0001 "}, {"line_total": None}, {"status": None, "channel": "fax"},
]
#: Two rules broken at once, and the one that comes first.
BOTH = [
    ({"qty": "", "sku": "NO-SUCH"}, "NULL_CRITICAL"), ({"qty": 5000, "unit_price": "free"}, "RANGE_VIOLATION"), ({"unit_price": 0, "customer_id": "nobody"}, "RANGE_VIOLATION"),
    ({"sku": "NO-SUCH", "customer_id": "nobody"}, "UNKNOWN_SKU"), ({"customer_id": "nobody", "order_ts": "yesterday"}, "UNKNOWN_CUSTOMER"), ({"order_ts": 0, "currency": "JPY"}, "BAD_TIMESTAMP"),
]


@pytest.fixture(scope="module")
def references(spark):
    products = spark.createDataFrame([("SKU-0001", "toys", "9.99")], "sku string, category string, catalog_price string")
    return products.withColumn("catalog_price", F.col("catalog_price").cast("decimal(12,2)")), spark.createDataFrame([("CUST-00001",)], "customer_id string")


def lines(spark, texts, name="f.json"):
    rows = [(t, name, i + 1) for i, t in enumerate(texts)]
    return stamp(parse_json_lines(spark.createDataFrame(rows, "raw_line string, source_file string, source_line_no long"))).drop("ingest_ts")


def record(**change):
    return json.dumps(BASE | change)


def test_each_rule_rejects_what_breaks_it(spark, references):
    cases = [(change, reason) for reason, changes in BROKEN.items() for change in changes] + [(change, None) for change in ACCEPTED] + BOTH
    # the place in the file names the case, as any field may be spoiled
    raw = lines(spark, [record(**change) for change, _ in cases])
    got = {r.source_line_no: r.reason for r in decide(raw, *references, Contract(), AS_OF).collect()}
    assert [(change, got[n + 1]) for n, (change, _) in enumerate(cases)] == cases


def test_details_name_the_value(spark, references):
    raw = lines(spark, [record(qty=-5), record(sku=None, qty="")])
    details = [r.detail for r in decide(raw, *references, Contract(), AS_OF).orderBy("source_line_no").collect()]
    assert details == ["quantity -5", "missing sku,qty"]


def test_bad_lines_reject_alone(spark, references):
    raw = lines(spark, ["not json", "[1, 2]", record()])
    got = [(r.reason, r.detail) for r in decide(raw, *references, Contract(), AS_OF).orderBy("source_line_no").collect()]
    assert got == [("PARSE_ERROR", "invalid json line"), ("PARSE_ERROR", "json not an object"), (None, None)]


def test_strict_types(spark, references):
    raw = lines(spark, [record(qty="3"), record()])
    got = [r.reason for r in decide(raw, *references, Contract(), AS_OF, wire_types()).orderBy("source_line_no").collect()]
    assert got == ["PARSE_ERROR", None]


def test_duplicates_and_replay(spark, references):
    raw = lines(spark, [record(), record(), record(line_no=2, qty=60, unit_price=10, line_total=600), record(line_no=3, qty=0)])
    first = process(raw, *references, Contract(), AS_OF)
    assert {(r.order_id, r.line_no) for r in first.items.collect()} == {("ORD-1", 1), ("ORD-1", 2)}
    assert sorted(r.reason for r in first.rejects.collect()) == ["DUP_KEY", "RANGE_VIOLATION"]
    order = first.orders.collect()[0]
    assert (float(order.order_total), order.item_count) == (631.5, 63)
    assert sorted(r.alert_type for r in first.alerts.collect()) == ["HIGH_VALUE", "SUSPICIOUS_QTY"]
    again = process(raw, *references, Contract(), AS_OF, first.items.select("order_id", "line_no"))
    assert again.items.count() == 0 and again.alerts.count() == 0
    assert sorted(r.reason for r in again.rejects.collect()) == ["DUP_KEY", "DUP_KEY", "DUP_KEY", "RANGE_VIOLATION"]
    assert again.decided.count() == raw.count()


def test_split_files_load_the_same(spark, references):
    texts = [record(order_id=f"ORD-{i % 5}", line_no=i % 3) for i in range(30)]
    whole = process(lines(spark, texts), *references, Contract(), AS_OF)
    halves = lines(spark, texts[:15], "a.json").unionByName(lines(spark, texts[15:], "b.json"))
    split = process(halves, *references, Contract(), AS_OF)
    keys = ["order_id", "line_no"]
    assert sorted(whole.items.select(*keys).collect()) == sorted(split.items.select(*keys).collect())


def test_empty_batch(spark, references):
    out = process(lines(spark, []), *references, Contract(), AS_OF)
    assert (out.items.count(), out.rejects.count(), out.orders.count(), out.alerts.count()) == (0, 0, 0, 0)
