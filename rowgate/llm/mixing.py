"""Mixing sources to target weights: repetition rates by source, then repeated and sampled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgate.llm.common import WORD, running_sums, stored

WEIGHTS = (3, 1, 2)
#: The mix's size as a part of all sizes, and the most a source or document is repeated.
TOTAL = 1.5
MOST = 2.0


def rates(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """``source``, ``source_size``, ``target``, ``rate`` from ``source``, ``size``.

    Sources take the weights in turn by code point, null last. A target stops at ``most`` times
    the source's size; what is over goes to the others by weight until none is above: the
    level is found by ranking sources by the level at which they are full. Sources
    without words have target and rate 0.
    """
    source = F.col("source").asc_nulls_last()
    sizes = stored(docs.groupBy("source").agg(F.sum("size").alias("source_size")))
    sizes = running_sums(sizes, [source], {"at": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod("at", F.lit(len(weights))).cast("int") + 1).cast("double")
    sizes = sizes.withColumn("weight", weight).drop("at")
    sizes = sizes.withColumn("full_at", F.lit(most) * F.col("source_size") / F.col("weight"))
    spent = {"spent": F.lit(most) * F.col("source_size"), "weighed": F.col("weight")}
    sizes = stored(running_sums(sizes, [F.col("full_at").asc(), source], spent))
    whole = sizes.agg((F.lit(total) * F.sum("source_size")).alias("budget"), F.sum("weight").alias("weights"))
    levelled = sizes.crossJoin(whole).withColumn("level", (F.col("budget") - F.col("spent")) / (F.col("weights") - F.col("weighed")))
    # the first source, in the order of filling, that is not full at its level fixes the level of all
    first = levelled.agg(F.min(F.when(F.col("level") < F.col("full_at"), F.struct("full_at", "level"))).alias("first"))
    cap = F.lit(most) * F.col("source_size")
    target = F.coalesce(F.least(cap, F.col("weight") * F.col("first.level")), cap)
    return sizes.crossJoin(first).select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    )


def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: str, seed: str) -> F.Column:
    """A number in [0, 1) fixed by the document's id and the seed."""
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(":" + seed)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def copies(docs: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target``, ``mix_copies``: how often the mix takes each row.

    A row is taken floor(rate) times and once more with probability rate - floor(rate), decided
    by a hash of its id and the seed: reruns agree, and rows with one id share their fate. Null and
    empty texts have size 0 and follow their source's rate. No rows give no rows.
    """
    sized = docs.withColumn("mix_size", word_count("text"))
    # one row for each source, written first: where its known size is small, the documents need no shuffle
    by_source = stored(
        rates(sized.select("source", F.col("mix_size").alias("size")), **how).select(
            F.col("source").alias("mix_source"),
            F.col("source_size").alias("mix_source_size"),
            F.col("target").alias("mix_target"),
            F.col("rate").alias("mix_rate"),
        )
    )
    joined = sized.join(by_source, sized["source"].eqNullSafe(by_source["mix_source"]))
    extra = F.when(uniform("doc_id", seed) < F.col("mix_rate") - F.floor("mix_rate"), 1).otherwise(0)
    return joined.withColumn("mix_copies", F.floor("mix_rate") + extra).drop("mix_source", "mix_rate")


def mix(docs: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, columns unchanged."""
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("mix_row"))
    taken = copies(rows, seed, **how).filter("mix_copies > 0")
    again = F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))
    return taken.select("mix_row", again.alias("mix_copy")).select("mix_row.*")
