"""What the order-line plans deal over the executors: numbers, and lines once they are dealt by order stay there."""

import os
import re

import pytest
from pyspark.sql import functions as F

from rowgate.operators import flow, seedfaults, terms
from rowgate.plans import queries as q
from rowgate.plans.order_lines import decide, judge, judge_changed, judge_clean, process
from rowgate.sources.scratch import staged

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def deals(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return set(re.findall(r"hashpartitioning\(([A-Za-z_]+)", plan))


def test_lines_are_dealt_by_numbers_alone(no_broadcast):
    run = q.batch(no_broadcast, DATA)
    for df in (run.decided, run.items, run.orders, run.alerts):
        assert deals(df) == {"l_partkey", "l_orderkey", "o_orderkey", "o_custkey", "__k"}


@pytest.fixture
def small_broadcasts(spark):
    """Rows of bits may be broadcast, no table may."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2000b")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_are_dealt_once_where_bits_tell_the_known_keys(small_broadcasts):
    run = q.batch(small_broadcasts, DATA)
    for df in (run.decided.drop("category", "catalog_price", "segment"), run.orders, q.alerts(small_broadcasts, DATA)):
        assert deals(df) == {"l_orderkey", "o_orderkey", "_groupingexpression"}  # the last are the rows of bits
    assert deals(run.items.drop("segment")) == {"l_orderkey", "o_orderkey", "_groupingexpression", "l_partkey", "__k"}


def test_lookup_by_bits_is_the_lookup(small_broadcasts):
    numbers = [None, 0, 1, 63, 64, 65, -1, -64, -65, 2**62, -(2**63), 2**63 - 1, 7]
    df = small_broadcasts.createDataFrame([(x,) for x in numbers + numbers], "n bigint")
    reference = small_broadcasts.createDataFrame([(x, f"a{x}") for x in numbers[:-1:2] + [None, 63, 63]], "k bigint, name string")
    count = lambda df: sorted(map(str, df.groupBy(*df.columns).count().collect()))
    for returns in ([], ["name"]):
        bits = flow.number_lookup(df, reference, ("n", "k"), returns, "known")
        assert "BroadcastHashJoin" in bits._jdf.queryExecution().executedPlan().toString()
        plain = flow.marked_lookup(df, reference, [("n", "k")], returns, "known")
        assert count(bits.select(*plain.columns)) == count(plain)
    wide = small_broadcasts.range(0, 64 * 100, 64).withColumnRenamed("id", "k")  # 2,400 bytes
    assert "__bits" not in flow.number_lookup(df, wide, ("n", "k"), [])._jdf.queryExecution().analyzed().toString()


def test_lines_without_a_reason_are_the_clean_ones(spark):
    lines = seedfaults.seed(q.known_lines(spark, DATA), 3, ["order_id", "line_no", "l_partkey"])
    clean, want = judge_clean(lines, q.CONTRACT, q.AS_OF_MS), judge(lines, q.CONTRACT, q.AS_OF_MS).filter("reason is null")
    assert clean.columns == want.columns
    assert clean.exceptAll(want).count() == want.exceptAll(clean).count() == 0 < clean.count() < lines.count()


def test_rules_are_applied_before_the_tables_are_joined(no_broadcast):
    plan = q.batch(no_broadcast, DATA).alerts._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("l_orderkey#", plan.index("Join Inner")) :]
    assert {"XXX", "timestampdiff"} <= set(re.findall("XXX|timestampdiff", "".join(x for x in below.splitlines() if " Filter " in x)))


def test_files_are_added_up_where_their_lines_are(small_broadcasts):
    assert "order_id" not in deals(q.file_ledger(small_broadcasts, DATA)) and deals(q.file_ledger(small_broadcasts, DATA)) >= {"l_orderkey", "source_file"}


def test_a_loaded_run_is_met_where_the_lines_are(no_broadcast):
    loaded = q.batch(no_broadcast, DATA).items.filter("line_no % 2 = 0").select("order_id", "line_no", q.DEALT)
    again = q.batch(no_broadcast, DATA, loaded=loaded)
    assert not {d for d in deals(again.decided) if d.startswith("__o")}
    by_text = process(q.order_lines(no_broadcast, DATA), q.products(no_broadcast, DATA), q.customers(no_broadcast, DATA), q.CONTRACT, q.AS_OF_MS, loaded.drop(q.DEALT), q.TOTAL_ORDER)
    key = ["order_id", "line_no", "reason", *q.TOTAL_ORDER]
    assert sorted(map(str, again.decided.select(*key).collect())) == sorted(map(str, by_text.decided.select(*key).collect()))
    assert again.items.count() == by_text.items.count() > 0


def test_lookup_by_numbers_is_the_lookup_by_texts(spark):
    by_text = decide(q.order_lines(spark, DATA), q.products(spark, DATA), q.customers(spark, DATA), q.CONTRACT, q.AS_OF_MS)
    names = sorted(by_text.columns)
    assert sorted(q.decided(spark, DATA).columns) == names
    own = q.decided(spark, DATA).select(*names)
    assert own.exceptAll(by_text.select(*names)).count() == by_text.select(*names).exceptAll(own).count() == 0


def test_changed_lines_alone_are_looked_up_again(spark):
    lines = seedfaults.seed(q.known_lines(spark, DATA), 30, ["order_id", "line_no", "l_partkey"])
    references = q.products(spark, DATA), q.customers(spark, DATA)
    fast = judge_changed(lines, F.col("fault").isNotNull(), *references, q.CONTRACT, q.AS_OF_MS)
    slow = decide(lines.drop(*q._MARKS), *references, q.CONTRACT, q.AS_OF_MS)
    count = lambda df: sorted(map(str, df.groupBy("fault", "reason", "known_sku", "known_customer").count().collect()))
    assert count(fast) == count(slow)


def test_two_captures_read_the_lines_once(spark, monkeypatch):
    read, table = [], q.table
    monkeypatch.setattr(q, "table", lambda s, d, name: read.append(name) or table(s, d, name))
    q.capture_diff(spark, DATA)
    assert read.count("lineitem") == 1


def test_outcomes_under_several_contracts_are_those_of_each(spark):
    for run, contract in zip(q.kept_each(spark, DATA, a=q.CONTRACT, b=q.OTHER).values(), (q.CONTRACT, q.OTHER), strict=True):
        alone = q.kept(spark, DATA, contract)
        for many, one in ((run.decided, alone.decided.drop("detail")), (run.items, alone.items), (run.alerts, alone.alerts), (run.orders, alone.orders)):
            names = sorted(one.columns)
            assert sorted(many.columns) == names
            many, one = many.select(*names), one.select(*names)
            assert many.exceptAll(one).count() == one.exceptAll(many).count() == 0 < one.count()


def test_phrases_are_dealt_by_term_alone(spark):
    df = spark.createDataFrame([("a b a b c",), ("a b",), (None,)], "s string")
    found = terms.phrases(df, "s", 2, (), 1, 2)
    assert deals(found) == {"term"}
    assert {r.term: (r.n, r.rows) for r in found.collect()} == {"a b": (3, 2), "b a": (1, 1), "b c": (1, 1)}


def test_scratch_tables_are_packed(spark):
    assert all(f.endswith(".zstd.parquet") for f in staged(spark.range(10)).inputFiles())


def test_lookup_of_codes_by_bits_is_the_lookup(small_broadcasts):
    texts = [None, "", "SKU-1", "SKU-01", "SKU-64", "SKU-63", "sku-1", "SKU-", "7", "07", "é9", "A" + "9" * 18, "A" + "9" * 19, "A" + "0" * 18, "٣", "x 1 "]
    df = small_broadcasts.createDataFrame([(x,) for x in texts + texts], "n string")
    reference = small_broadcasts.createDataFrame([(x, f"a{x}") for x in texts[::2] + [None, "SKU-1"]], "k string, name string")
    count = lambda df: sorted(map(str, df.groupBy(*df.columns).count().collect()))
    for returns in ([], ["name"]):
        bits = flow.text_lookup(df, reference, (F.col("n"), "k"), returns, "known")
        assert "__bits" in bits._jdf.queryExecution().analyzed().toString()
        plain = flow.marked_lookup(df, reference, [("n", "k")], returns, "known")
        assert bits.columns == plain.columns and count(bits) == count(plain)
    codes = small_broadcasts.range(20 * 64).selectExpr("concat('SKU-', id + 1000) AS k")  # 21 rows of bits
    assert "__bits" in flow.text_lookup(df, codes, (F.col("n"), "k"), [])._jdf.queryExecution().analyzed().toString()
    wide = small_broadcasts.range(40).selectExpr("concat('SKU-', id * 64) AS k")
    assert "__bits" not in flow.text_lookup(df, wide, (F.col("n"), "k"), [])._jdf.queryExecution().analyzed().toString()


def test_lines_alone_are_told_where_they_are_dealt(no_broadcast):
    lines, own = q.order_lines(no_broadcast, DATA), q.lines_alone(no_broadcast, DATA)
    assert deals(own) == {"l_orderkey", "o_orderkey"}
    want = lines.join(lines.groupBy("order_id", "line_no").count().filter("count = 1"), ["order_id", "line_no"], "left_semi").select(*lines.columns)
    assert sorted(map(str, own.collect())) == sorted(map(str, want.collect())) and 0 < own.count() < lines.count()
