"""Term extraction and lookup: words and phrases, counted, scored and found again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BETWEEN = r"[^\p{L}\p{Nd}]+"


def words_of(text: str) -> Column:
    """The lower-cased words of a text: runs of letters and digits."""
    return F.filter(F.split(F.lower(text), _BETWEEN), lambda w: w != "")


def _grams(words: Column, size: int) -> Column:
    """All phrases of ``size`` neighbouring words."""
    last = F.size(words) - (size - 1)
    at = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(words, i, size), " "))


def terms(df: DataFrame, text: str) -> DataFrame:
    """``term`` and ``n``: the words of all rows."""
    return df.select(F.explode(words_of(text)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def phrases(df: DataFrame, text: str, longest: int = 3, stop: tuple[str, ...] = (), at_least: int = 2, shortest: int = 1) -> DataFrame:
    """Term extraction: phrases of ``shortest`` to ``longest`` words that come up ``at_least`` times, with ``n``, ``rows`` that have one, and ``score``.

    ``score`` is n * ln(all rows / rows), so a phrase that every row has scores 0. Phrases that start or end with a word of ``stop`` are left
    out, and no phrase crosses what isn't a letter, a digit or a blank's kind of gap between two words. Null texts have none.
    """
    found = F.flatten(F.array(*(_grams(F.col("w"), size) for size in range(shortest, longest + 1))))
    # sorted within the row, so that a row's first of a term is told by the one before it, and nothing is dealt by row
    sorted_ = df.select(words_of(text).alias("w")).select(F.sort_array(found).alias("g"))
    pairs = F.arrays_zip("g", F.concat(F.array(F.lit(None).cast("string")), "g")).cast("array<struct<term: string, before: string>>")
    term = F.col("term")
    each = sorted_.select(F.explode(pairs).alias("p")).select("p.term", "p.before").filter("term is not null")
    if stop:
        ends = F.array(*(F.lit(s) for s in stop))
        each = each.filter(~F.array_contains(ends, F.substring_index(term, " ", 1)) & ~F.array_contains(ends, F.substring_index(term, " ", -1)))
    first = ~term.eqNullSafe(F.col("before"))
    counted = each.groupBy("term").agg(F.count("*").alias("n"), F.count_if(first).alias("rows")).filter(F.col("n") >= at_least)
    total = df.agg(F.count("*").alias("total"))  # one row
    score = F.col("n") * F.log(F.col("total") / F.col("rows"))
    return counted.crossJoin(total).select("term", "n", "rows", score.alias("score"))


def term_lookup(df: DataFrame, text: str, wanted: DataFrame, longest: int | None = None) -> DataFrame:
    """Rows that have a wanted term (a word or a phrase), with the ``term`` and how often, ``n``.

    Terms are compared by their words, so case and what stands between words don't matter. ``longest`` is the most words of a term; without
    it the list is asked. Terms may overlap. Each row is looked up with its own phrases, whatever the length of the list.
    """
    clean = wanted.select(words_of("term").alias("w")).filter("size(w) > 0").select(F.array_join("w", " ").alias("term"), F.size("w").alias("size")).distinct()
    sizes = [r.size for r in clean.select("size").distinct().collect() if longest is None or r.size <= longest]
    if not sizes:
        return df.limit(0).withColumns({"term": F.lit(None).cast("string"), "n": F.lit(0).cast("bigint")})
    found = F.flatten(F.array(*(_grams(words_of(text), s) for s in sorted(sizes))))
    each = df.withColumn("__row", F.monotonically_increasing_id()).withColumn("term", F.explode(found))
    kept = each.join(clean.select("term"), "term", "left_semi")
    counted = kept.groupBy("__row", *df.columns, "term").agg(F.count("*").alias("n"))
    return counted.drop("__row")
