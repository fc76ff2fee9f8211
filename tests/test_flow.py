import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from rowgate.functions import scalar as S
from rowgate.functions.types import convert, spark_type
from rowgate.operators import compare, flow, fuzzy, rollup, seedfaults, terms, warehouse
from rowgate.plans import file_queries


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_two_lookups_account_for_all(spark):
    currency = spark.createDataFrame([("GBP", 36), ("EUR", 39), ("USD", 98)], "code string, key int")
    dates = spark.createDataFrame([(f"2014-01-{d:02d}", d) for d in range(1, 13)], "day string, dkey int")
    batch = [("GBP", "2014-01-02"), ("EUR", "2014-01-03"), ("USD", "2014-01-12")] * 2 + [("XXX", "2014-01-02")] * 3 + [("GBP", "2020-01-01")] * 3
    df = spark.createDataFrame(batch, "currency string, day string")
    chain = flow.lookup_chain(df, [("currency", currency, [("currency", "code")], ["key"]), ("date", dates, [("day", "day")], ["dkey"])])
    assert rows(chain.groupBy("rejected_at").count()) == [("currency", 3), ("date", 3), (None, 6)]


def test_lookup_outputs(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id int, k string")
    ref = spark.createDataFrame([("a", 10, "old"), ("a", 9, "older")], "k string, v int, k2 string")
    out = flow.lookup(df, ref, [("k", "k")], ["v"])
    assert rows(out["match"]) == [(1, "a", 9)]
    assert rows(out["no_match"]) == [(2, None), (3, "z")]
    assert flow.lookup(df, ref, [("k", "k")], ["v"], "ignore")["match"].count() == 3
    with pytest.raises(Exception, match="no match"):
        flow.lookup(df, ref, [("k", "k")], ["v"], "fail")["match"].collect()


def test_split_sends_null_to_the_default(spark):
    df = spark.createDataFrame([(1,), (None,), (30,)], "q int")
    out = flow.conditional_split(df, [("small", F.col("q") < 10), ("any", F.col("q") > 0)])
    assert {k: v.count() for k, v in out.items()} == {"small": 1, "any": 1, "default": 1}
    both = flow.conditional_split(df, [("small", F.col("q") < 10), ("any", F.col("q") > 0)], independent=True)
    assert {k: v.count() for k, v in both.items()} == {"small": 1, "any": 2, "default": 1}
    assert flow.accounted(df, out).collect()[0]["pass"]


def test_derive_refuses_replacement(spark):
    with pytest.raises(ValueError):
        flow.derive(spark.range(1), {"id": F.lit(1)})


def test_scalar_semantics(spark):
    df = spark.createDataFrame([(" 12 ", "-7", "1,000.5", "a.b.json", "")], "i string, n string, d string, f string, e string")
    got = df.select(
        S.parse_int(F.col("i")), S.parse_int(F.col("d")), S.parse_number(F.col("d")), S.file_stem(F.col("f")), S.fallback(F.col("e"), F.lit("x")),
        S.divide(F.lit(-7), F.lit(2), True), S.divide(F.lit(1), F.lit(0), True), S.percentage(F.lit(1), F.lit(3)), S.percentage(F.lit(1), F.lit(0)),
    ).first()
    assert [str(x) for x in got] == ["12", "None", "1000.5", "a.b", "x", "-3", "None", "33.3", "0.0"]


def test_convert_splits_bad_values(spark):
    good, bad = convert(spark.createDataFrame([("1",), ("x",), (None,)], "v string"), {"v": "i4"})
    assert rows(good) == [(1,), (None,)] and rows(bad) == [("x",)]
    assert spark_type("numeric", 10, 2).simpleString() == "decimal(10,2)"
    with pytest.raises(ValueError):
        spark_type("nope")


def test_customer_versions(spark):
    data = [("A@x ", "A", "2020-01-01"), ("a@x", "B", "2020-02-01"), ("a@x", "B", "2020-03-01"), ("a@x", "C", "2020-04-01"), ("", "D", "2020-01-01"), (None, "E", "2020-01-01")]
    df = spark.createDataFrame(data, "customer_email string, customer_name string, order_date string").withColumn("order_date", F.to_date("order_date"))
    got = warehouse.customer_versions(None, df).orderBy("valid_from").collect()
    assert [(r.customer_name, str(r.valid_to), r.is_current) for r in got] == [("A", "2020-02-01", False), ("B", "2020-04-01", False), ("C", "None", True)]
    more = spark.createDataFrame([("a@x", "C", "2020-05-01"), ("a@x", "D", "2020-06-01"), ("n@x", "N", "2020-01-01")], "customer_email string, customer_name string, order_date string")
    second = warehouse.customer_versions(warehouse.customer_versions(None, df), more.withColumn("order_date", F.to_date("order_date")))
    assert [(r.customer_id, r.customer_name, r.is_current) for r in second.orderBy("customer_id", "valid_from").collect()] == [
        ("a@x", "A", False), ("a@x", "B", False), ("a@x", "C", False), ("a@x", "D", True), ("n@x", "N", True),
    ]


def test_upsert_replaces_whole_rows(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert rows(warehouse.upsert(old, new, ["k"], ["v"])) == [(1, "a"), (2, "d"), (3, "e")]


def test_surrogate_keys_are_dense(spark):
    df = spark.range(1000).select(F.format_string("k%04d", "id").alias("k")).repartition(7)
    got = warehouse.surrogate(df, "k", "key", 5).orderBy("k").collect()
    assert [r.key for r in got] == list(range(6, 1006))


def test_paired_logs_keep_repeated_and_null_keys(spark):
    schema = "source_file string, order_id string, line_no string, reason string"
    a = spark.createDataFrame([("f", None, "1", "X"), ("f", "o", "1", "X"), ("f", "o", "1", "Y")], schema)
    b = spark.createDataFrame([("f", None, "1", "X"), ("f", "o", "1", "X"), ("f", "p", "1", "X")], schema)
    got = sorted(r.status for r in compare.side_by_side(a, b).collect())
    assert got == ["only in A", "only in B", "same", "same"]
    assert compare.reject_diff(a, a).count() == 0
    assert str(compare.agreement(a.limit(0), b.limit(0)).first().agreement_pct) == "100.00"


def test_vocabulary_and_oracle_diff(spark):
    seen = spark.createDataFrame([("DUP_KEY",), ("ODD",)], "reason string")
    found = {(r.reason, r.finding) for r in compare.vocabulary(seen).collect()}
    assert ("ODD", "undeclared") in found and ("DUP_KEY", "not seen") not in found
    want = spark.createDataFrame([(1, "in"), (2, "in"), (3, "out"), (4, "in")], "k int, side string")
    got = spark.createDataFrame([(1, "in"), (2, "out"), (4, "in"), (4, "out"), (5, "in")], "k int, side string")
    diff = {r.k: r.finding for r in compare.oracle_diff(want, got, "k", "side").collect()}
    assert diff == {2: "wrong side", 3: "missing", 4: "both sides", 5: "unexpected"}


def test_seeded_faults_repeat(spark):
    columns = ("customer_id", "qty", "sku", "order_ts", "currency")
    df = spark.range(2000).select("id", F.lit("C").alias("customer_id"), F.lit("1").alias("qty"), F.lit("S").alias("sku"), F.lit("5").alias("order_ts"), F.lit("USD").alias("currency"))
    once, twice = (seedfaults.seed(df, 10, ["id"]).filter("fault is not null").select("id", "fault").collect() for _ in range(2))
    assert sorted(once) == sorted(twice) and 120 < len(once) < 280 and len({r.fault for r in once}) == len(seedfaults.FAULTS)
    assert set(columns) <= set(df.columns)


def test_feed_profile_and_fuzzy(spark):
    df = spark.createDataFrame([("o1", 1, 5), ("o1", 1, 0), ("o2", 1, 7)], "o string, l int, q int")
    one = rollup.feed_profile(df, {"zero": F.col("q") == 0}, ["o", "l"], "o").first()
    assert (one.lines, one.orders, one.dup_keys, one.most_lines_of_an_order, one.zero) == (3, 2, 1, 2, 1)
    names = spark.createDataFrame([("Jon Smith",), ("Unrelated",)], "n string")
    ref = spark.createDataFrame([("John Smith",), ("Joan Smythe",)], "r string")
    assert {r.n: r.matched for r in fuzzy.fuzzy_lookup(names, ref, "n", "r").collect()} == {"Jon Smith": "John Smith", "Unrelated": None}


def test_fuzzy_finds_all_within_the_distance(spark):
    names = spark.createDataFrame([("IR#N",), ("cut",), ("xmiddley",), ("",), (None,), ("ab",), ("Customer#12",), ("abcdef",)], "n string")
    ref = spark.createDataFrame([("IRAN",), ("cat",), ("amiddleb",), ("Customer#1",), ("fedcba",), (None,)], "r string")
    got = {r.n: (r.matched, r.edits) for r in fuzzy.fuzzy_lookup(names, ref, "n", "r").collect()}
    assert got == {
        "IR#N": ("IRAN", 1), "cut": ("cat", 1), "xmiddley": ("amiddleb", 2), "": (None, None), None: (None, None),
        "ab": ("cat", 2), "Customer#12": ("Customer#1", 1), "abcdef": (None, None),
    }


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_fuzzy_against_all_pairs(spark, most):
    rng = random.Random(most)
    texts = {"".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in range(60)}
    left, right = sorted(texts)[::2], sorted(texts)[1::2]
    df = spark.createDataFrame([(t,) for t in left], "n string")
    ref = spark.createDataFrame([(t,) for t in right], "r string")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    want = {a: min(((edits(a, b), b) for b in right if edits(a, b) <= most), default=(None, None)) for a in left}
    assert {r.n: (r.edits, r.matched) for r in fuzzy.fuzzy_lookup(df, ref, "n", "r", most).collect()} == want


def test_fuzzy_of_long_texts(spark):
    long = "".join(random.Random(1).choices("abcdef", k=30_000))
    df = spark.createDataFrame([(long[:5000] + "##" + long[5000:],), (long[:29_000],)], "n string")
    got = fuzzy.fuzzy_lookup(df, spark.createDataFrame([(long,)], "r string"), "n", "r", 2)
    assert sorted(str(r.edits) for r in got.collect()) == ["2", "None"]


def test_similar_by_words_against_all_pairs(spark):
    rng = random.Random(4)
    make = lambda: " ".join(rng.choices(["the", "the", "red", "blue", "old", "ring", "bolt", "nut", "x1", "x2"], k=rng.randint(0, 7)))
    left, right = [make() for _ in range(80)] + [None], [make().upper() for _ in range(60)] + [None, ""]
    df, ref = (spark.createDataFrame([(t,) for t in texts], "n string") for texts in (left, right))
    for least in (0.34, 0.8, 1.0):
        def best(a):
            a = set((a or "").split())
            scored = [(-len(a & b) / len(a | b), t) for t in right if t and a and (b := set(t.lower().split())) and len(a & b) / len(a | b) >= least]
            by_set = {}
            for s, t in scored:
                key = frozenset(t.lower().split())
                by_set[key] = min(by_set.get(key, (s, t)), (s, t))
            return min(by_set.values(), default=(None, None))

        got = sorted(((r.n, -r.score if r.score else None, r.matched) for r in fuzzy.similar_lookup(df, ref, "n", "n", least).collect()), key=str)
        assert got == sorted(((a, *best(a)) for a in left), key=str)
    with pytest.raises(ValueError):
        fuzzy.similar_lookup(df, ref, "n", "n", 0)


def test_phrases_and_lookup(spark):
    df = spark.createDataFrame([(1, "The red ring, the RED ring!"), (2, "a red  bolt of steel"), (3, None), (4, "")], "k int, s string")
    got = {r.term: (r.n, r.rows, round(r.score, 4)) for r in terms.phrases(df, "s", 2, ("the", "of", "a")).collect()}
    assert got == {"red": (3, 2, round(3 * math.log(2), 4)), "ring": (2, 1, round(2 * math.log(4), 4)), "red ring": (2, 1, round(2 * math.log(4), 4))}
    wanted = spark.createDataFrame([("Red Ring",), ("bolt of steel",), ("ring",), (None,), ("...",), ("missing words here",)], "term string")
    found = sorted((r.k, r.term, r.n) for r in terms.term_lookup(df, "s", wanted).collect())
    assert found == [(1, "red ring", 2), (1, "ring", 2), (2, "bolt of steel", 1)]
    assert terms.term_lookup(df, "s", wanted.limit(0)).columns == ["k", "s", "term", "n"]


def test_keys_of_a_fuzzy_lookup_are_never_broadcast(spark):
    texts = spark.createDataFrame([("abc",), ("abd",)], "name string")
    plan = fuzzy.fuzzy_lookup(texts, texts, "name", "name", 1)._jdf.queryExecution().executedPlan().toString()
    pairs = plan[plan.index("levenshtein"):]
    assert "SortMergeJoin" in pairs and "BroadcastHashJoin" not in pairs


def test_wide_division(spark):
    product = F.lit(9_000_000).cast("decimal(19,0)") * F.lit(1 << 40).cast("decimal(13,0)")  # beyond eight bytes
    one = spark.range(1).select(S.divide_wide(product, F.lit(-3)), S.divide_wide(product, F.lit(1)), S.divide_wide(product, F.lit(0)), S.divide_wide(F.lit(-7), F.lit(2))).first()
    assert tuple(one) == (-(9_000_000 * (1 << 40) // 3), None, None, -3)


def test_scalar_functions_of_large_keys(spark, tmp_path):
    row = [(9_000_000, 1, "O", 1.25, datetime.datetime(1998, 1, 1), "1-URGENT")]
    made = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame(row, made).write.parquet(str(tmp_path / "orders.parquet"))
    assert file_queries.scalar_functions(spark, str(tmp_path)).first().third == -(9_000_000 * (1 << 40) // 3)


def test_fuzzy_texts_with_names_in_common_seldom_meet(spark):
    mark = F.concat(F.left(F.md5(F.col("id").cast("string").cast("binary")), F.lit(9)), F.lit(" "), F.element_at(F.array(F.lit("large ring"), F.lit("hot bolt")), (F.col("id") % 2 + 1).cast("int")))
    marks = spark.range(2000).select(mark.alias("u")).cache()
    wrong = marks.select(F.concat(F.left("u", F.lit(3)), F.lit("#"), F.substring("u", F.lit(5), F.lit(99))).alias("t")).cache()
    assert fuzzy._met(wrong, marks, 2).distinct().count() < 2000 * 40  # one segment of three is a name that half of all have: 2,000,000
    got = fuzzy.fuzzy_lookup(wrong, marks.limit(1500), "t", "u", 2)
    want = wrong.join(marks.limit(1500), F.levenshtein("t", "u") <= 2).groupBy("t").agg(F.min(F.struct(F.levenshtein("t", "u"), "u").alias("m")).alias("m"))
    assert sorted((r.t, r.edits, r.matched) for r in got.filter("matched is not null").collect()) == sorted((r.t, *r.m) for r in want.collect())
    assert want.count() >= 1500


@pytest.mark.parametrize(("most", "parts"), [(0, 2), (1, 4), (2, 4), (2, 5), (3, 5)])
def test_fuzzy_keys_of_any_number_of_segments_find_all(spark, most, parts):
    rng = random.Random(parts)
    texts = sorted({"".join(rng.choices("ab", k=rng.randint(0, 9))) for _ in range(80)})
    left, right = spark.createDataFrame([(t,) for t in texts[::2]], "t string"), spark.createDataFrame([(t,) for t in texts[1::2]], "u string")
    near = F.levenshtein("t", "u") <= most
    found = fuzzy._probes(left, "t", most, parts).join(fuzzy._segments(right, "u", most, parts), "k").select("t", "u").filter(near).distinct()
    assert sorted(found.collect()) == sorted(left.crossJoin(right).filter(near).collect())
