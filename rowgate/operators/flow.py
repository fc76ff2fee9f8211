"""Data flow transforms. What splits rows returns a dict of named outputs, so that no output is lost."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def derive(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Computed columns; an existing name is an error."""
    taken = set(columns) & set(df.columns)
    if taken:
        raise ValueError(f"columns exist already: {sorted(taken)}")
    return df.withColumns(columns)


def composite_key(*parts: str) -> Column:
    """``a#b``; null if a part is."""
    pieces: list[Column] = []
    for p in parts:
        pieces += [F.lit("#"), F.col(p).cast("string")]
    return F.concat(*pieces[1:])


def branch(df: DataFrame, cases: list[tuple[str, Column]], default: str = "default", name: str = "branch") -> DataFrame:
    """``df`` with the name of the first case that holds; a null predicate doesn't hold."""
    label = None
    for case, holds in cases:
        holds = F.coalesce(holds, F.lit(False))
        label = F.when(holds, case) if label is None else label.when(holds, case)
    return df.withColumn(name, F.lit(default) if label is None else label.otherwise(default))


def conditional_split(df: DataFrame, cases: list[tuple[str, Column]], default: str = "default", independent: bool = False) -> dict[str, DataFrame]:
    """One output for each case and the default; each row is in one, or, if ``independent``, in all whose case holds."""
    if default in dict(cases) or len(dict(cases)) < len(cases):
        raise ValueError("output names must differ, and there is one default")
    if independent:
        holds = {n: F.coalesce(c, F.lit(False)) for n, c in cases}
        none = ~reduce(lambda a, b: a | b, holds.values(), F.lit(False))
        return {n: df.filter(c) for n, c in holds.items()} | {default: df.filter(none)}
    labelled = branch(df, cases, default, "__branch")
    return {n: labelled.filter(F.col("__branch") == n).drop("__branch") for n in [*dict(cases), default]}


def marked_lookup(df: DataFrame, reference: DataFrame, on: list[tuple[str | Column, str]], returns: list[str], hit: str = "__hit") -> DataFrame:
    """``df`` with the reference's ``returns`` and whether a reference row was found; one row out for each row in.

    ``on`` pairs a column of ``df`` (or what is computed of its columns) with one of the reference. Of reference rows with equal keys the smallest
    counts. Returned names that ``df`` has replace its columns. Spark broadcasts the reference if its measured size allows.
    """
    keys = [f"__k{i}" for i in range(len(on))]
    columns = [F.col(r).alias(k) for k, (_, r) in zip(keys, on, strict=True)]
    slim = reference.select(*columns, F.struct(F.lit(True).alias("found"), *returns).alias("__r"))
    slim = slim.groupBy(*keys).agg(F.min("__r").alias("__r"))
    condition = reduce(lambda a, b: a & b, ((F.col(d) if isinstance(d, str) else d) == F.col(k) for k, (d, _) in zip(keys, on, strict=True)))
    joined = df.join(slim, condition, "left").withColumn(hit, F.col("__r").isNotNull())
    return joined.withColumns({r: F.col("__r")[r] for r in returns}).drop("__r", *keys)


def _broadcast_limit(spark) -> int:
    """Spark's limit of broadcasts in bytes, negative where it may not broadcast."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)i?b?", spark.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def number_lookup(df: DataFrame, reference: DataFrame, on: tuple[str, str], returns: list[str], hit: str = "__hit") -> DataFrame:
    """``marked_lookup`` by one whole number.

    Whether the reference has it is told by a row of bits for every 64 numbers in succession, as long as Spark may broadcast those rows (they are
    counted here). Then rows are dealt by the number only if a plan uses the ``returns``: else Spark leaves that join out.
    """
    column, key = (F.col(c).cast("bigint") for c in on)
    word, bit = (lambda c: F.shiftright(c, 6)), (lambda c: c.bitwiseAND(F.lit(63)).cast("int"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(key))
    words = reference.filter(key.isNotNull()).groupBy(word(key).alias("__w")).agg(F.bit_or(one).alias("__bits"))
    if words.count() * 24 > _broadcast_limit(df.sparkSession):
        return marked_lookup(df, reference, [on], returns, hit)
    marked = df.join(F.broadcast(words), word(column) == F.col("__w"), "left")
    marked = marked.withColumn(hit, F.coalesce(F.getbit("__bits", bit(column)) == 1, F.lit(False))).drop("__w", "__bits")
    return marked_lookup(marked, reference, [on], returns, "__found").drop("__found") if returns else marked


def _numbered(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with a text as what stands before its last digits (``__head``), how many those are (``__digits``), and their number as a word and a bit of it.

    A text with over 18 last digits is taken whole. Each step is a column, so that it is worked out once a row.
    """
    df = df.withColumn("__x", text).withColumn("__head", F.rtrim("__x", F.lit("0123456789")))
    df = df.withColumn("__digits", F.length("__x") - F.length("__head")).withColumn("__fits", F.col("__digits").between(1, 18))
    df = df.withColumn("__no", F.when(F.col("__fits"), F.right("__x", F.col("__digits")).try_cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    whole = {"__head": F.when(F.col("__fits"), F.col("__head")).otherwise(F.col("__x")), "__digits": F.when(F.col("__fits"), F.col("__digits")).otherwise(0)}
    return df.withColumns(whole | {"__w": F.shiftright("__no", 6), "__bit": F.col("__no").bitwiseAND(F.lit(63)).cast("int")}).drop("__x", "__fits", "__no")


def text_lookup(df: DataFrame, reference: DataFrame, on: tuple[Column, str], returns: list[str], hit: str = "__hit") -> DataFrame:
    """``marked_lookup`` by one text.

    Codes that differ in their last digits are told by a row of bits for every 64 numbers in succession, as in ``number_lookup``; other texts
    have a row each. Where those rows are too many to broadcast, both tables are dealt by the text.
    """
    text, key = on
    names = ["__head", "__digits", "__w"]
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("__bit"))
    words = _numbered(reference.filter(F.col(key).isNotNull()), F.col(key)).groupBy(*names).agg(F.bit_or(one).alias("__bits"))
    rows, letters = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("__head")), F.lit(0))).first()
    if rows * 64 + letters > _broadcast_limit(df.sparkSession):
        return marked_lookup(df, reference, [on], returns, hit)
    marked = _numbered(df, text).join(F.broadcast(words), names, "left")
    marked = marked.withColumn(hit, F.coalesce(F.getbit("__bits", "__bit") == 1, F.lit(False))).drop(*names, "__bit", "__bits")
    return marked_lookup(marked, reference, [on], returns, "__found").drop("__found") if returns else marked


def lookup(
    df: DataFrame, reference: DataFrame, on: list[tuple[str, str]], returns: list[str], on_miss: str = "redirect"
) -> dict[str, DataFrame]:
    """Outputs ``match`` and ``no_match``. ``on_miss="ignore"`` keeps misses in ``match`` with null returns; ``"fail"`` fails the job on one."""
    marked = marked_lookup(df, reference, on, returns)
    if on_miss == "ignore":
        return {"match": marked.drop("__hit"), "no_match": df.limit(0)}
    if on_miss == "fail":
        sure = F.when(F.assert_true("__hit", F.lit("a row found no match")).isNull(), F.lit(True))
        return {"match": marked.filter(sure).drop("__hit"), "no_match": df.limit(0)}
    if on_miss != "redirect":
        raise ValueError(f"on_miss: {on_miss!r}")
    return {"match": marked.filter("__hit").drop("__hit"), "no_match": marked.filter("not __hit").select(*df.columns)}


def lookup_chain(df: DataFrame, steps: list[tuple[str, DataFrame, list[tuple[str, str]], list[str]]]) -> DataFrame:
    """Lookups one after the other, with ``rejected_at``: the name of the first that missed, null if none did."""
    out = df.withColumn("rejected_at", F.lit(None).cast("string"))
    for name, reference, on, returns in steps:
        out = marked_lookup(out, reference, on, returns)
        miss = F.when(~F.col("__hit"), name)
        out = out.withColumn("rejected_at", F.coalesce("rejected_at", miss)).drop("__hit")
    return out


def rank_in_key(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "occurrence") -> DataFrame:
    """``df`` with the row's place among those of its key. The order should be total, or ties fall by chance."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def dedupe(df: DataFrame, keys: list[str], order: list[Column | str]) -> dict[str, DataFrame]:
    """``first``: the first row of each key; ``duplicate``: all others."""
    ranked = rank_in_key(df, keys, order, "__n")
    return {"first": ranked.filter("__n = 1").drop("__n"), "duplicate": ranked.filter("__n > 1").drop("__n")}


def replayed(df: DataFrame, loaded: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """``new`` and ``replay`` rows, by whether the key is loaded already."""
    known = loaded.select(*keys)
    return {"new": df.join(known, keys, "left_anti"), "replay": df.join(known, keys, "left_semi")}


AGGREGATES = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "avg": F.avg,
    "count_distinct": F.count_distinct,
}


def aggregate(df: DataFrame, by: list[str], measures: dict[str, tuple[str, str]]) -> DataFrame:
    """``measures``: name to (function, column or ``*``). SQL's rules for nulls."""
    columns = [(F.count(F.lit(1)) if c == "*" else AGGREGATES[f](c)).alias(n) for n, (f, c) in measures.items()]
    return df.groupBy(*by).agg(*columns)


def sort(df: DataFrame, by: list[Column | str], unique_on: list[str] | None = None) -> dict[str, DataFrame]:
    """Sorted rows, and with ``unique_on`` the dropped duplicates as an output of their own."""
    if unique_on is None:
        return {"sorted": df.orderBy(*by), "dropped": df.limit(0)}
    parts = dedupe(df, unique_on, by)
    return {"sorted": parts["first"].orderBy(*by), "dropped": parts["duplicate"]}


def union_all(*frames: DataFrame) -> DataFrame:
    """By name; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_sorted(a: DataFrame, b: DataFrame, by: list[Column | str]) -> DataFrame:
    return a.unionByName(b).orderBy(*by)


def merge_join(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    return a.join(b.hint("merge"), on, how)


def sample_rows(df: DataFrame, keys: list[str], percent: float, seed: int = 0) -> dict[str, DataFrame]:
    """A repeatable sample by a hash of the keys, and the rest."""
    inside = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1_000_000)) < int(percent * 10_000)
    return {"selected": df.filter(inside), "rest": df.filter(~inside)}


def sample_n(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """A repeatable sample of ``n`` rows: those with the smallest hashes of their keys."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)


def character_map(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """In-place ``upper``, ``lower``, ``reverse`` or ``trim``."""
    how = {"upper": F.upper, "lower": F.lower, "reverse": F.reverse, "trim": F.trim}
    return df.withColumns({c: how[k](c) for c, k in columns.items()})


def pivot(df: DataFrame, by: list[str], column: str, values: list, measure: Column) -> DataFrame:
    return df.groupBy(*by).pivot(column, values).agg(measure)


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, values, name, value)


def audit(df: DataFrame, package: str, batch_id: str) -> DataFrame:
    return df.withColumns({"audit_package": F.lit(package), "audit_batch": F.lit(batch_id)})


def since(df: DataFrame, column: str, mark) -> DataFrame:
    """Incremental reads: rows past a high-water mark (all if there is none)."""
    return df if mark is None else df.filter(F.col(column) > F.lit(mark))


def describe_codes(df: DataFrame, codes: DataFrame, column: str, name: str = "description") -> DataFrame:
    """A static map as a lookup: the text of a code, null for one it doesn't have; no row is lost."""
    return marked_lookup(df, codes.select("code", F.col("text").alias(name)), [(column, "code")], [name]).drop("__hit")


def pack(df: DataFrame, columns: list[str], name: str = "notes") -> DataFrame:
    """Columns that a table has no place for, as one JSON text; nulls are left out of it."""
    return df.withColumn(name, F.to_json(F.struct(*columns))).drop(*columns)


def unpack(df: DataFrame, schema: str, name: str = "notes") -> DataFrame:
    """The columns of ``schema`` back from their JSON text."""
    return df.withColumn("__notes", F.from_json(name, schema)).select(*(c for c in df.columns if c != name), "__notes.*")


def cached(df: DataFrame) -> DataFrame:
    """A reference that several lookups share; the caller unpersists it."""
    return df.persist()


def statement(sql: str, **tables: DataFrame) -> DataFrame:
    """An SQL statement over frames that it names in braces."""
    return next(iter(tables.values())).sparkSession.sql(sql, **tables)


def accounted(source: DataFrame, outputs: dict[str, DataFrame]) -> DataFrame:
    """One row: rows in, rows in all outputs, and whether they are as many."""
    total = union_all(*(o.select(F.lit(1).alias("one")) for o in outputs.values())).agg(F.count("*").alias("rows_out"))
    return source.agg(F.count("*").alias("rows_in")).crossJoin(total).withColumn("pass", F.col("rows_in") == F.col("rows_out"))
