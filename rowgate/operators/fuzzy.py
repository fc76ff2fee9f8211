"""Fuzzy lookup and grouping: by edits, through shared segments, and by common words, through rare ones."""

from __future__ import annotations

from itertools import combinations, count, product
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgate.operators.graph import components
from rowgate.sources.scratch import staged


def _clean(column: str) -> Column:
    return F.lower(F.trim(F.col(column)))


def _segment(length: Column, n: int, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment ``n`` of ``parts`` that are as even as can be, the longer ones last."""
    short = F.floor(length / parts).cast("int")
    longer = F.pmod(length, F.lit(parts))
    before = F.greatest(longer - (parts - n), F.lit(0))  # longer ones before this one
    return F.lit(n) * short + before + 1, short + F.when(F.lit(n) >= parts - longer, 1).otherwise(0)


def _segments(texts: DataFrame, text: str, most: int, parts: int) -> DataFrame:
    """``texts`` with ``k``, keys of all but ``most`` of a text's ``parts`` disjoint segments: so many edits leave one key as it was."""
    length = F.length(text)
    pieces = [F.xxhash64(F.substring(F.col(text), *_segment(length, n, parts))) for n in range(parts)]
    cut = texts.withColumn("__h", F.array(*pieces))
    keys = [F.xxhash64(length, F.lit(str(left)), *(F.col("__h")[n] for n in left)) for left in combinations(range(parts), parts - most)]
    return cut.select(text, F.explode(F.array_distinct(F.array(*keys))).alias("k"))


def _ways(most: int, parts: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """How ``most`` edits may leave segments untouched: what they add to the length, and the untouched segments with how far each has moved.

    What is added between two segments counts to the later one, at the end to the last. So an untouched segment has moved by what was added
    to or taken from the touched ones before it, and the rest of the difference in length comes after it.
    """
    ways = set()
    for touched in combinations(range(parts), most):
        for added in product(range(-most, most + 1), repeat=most):
            if sum(map(abs, added)) <= most:
                left = [n for n in range(parts) if n not in touched]
                ways.add((sum(added), tuple((n, sum(x for i, x in zip(touched, added, strict=True) if i < n)) for n in left)))
    return sorted(ways)


def _probes(texts: DataFrame, text: str, most: int, parts: int) -> DataFrame:
    """``texts`` with ``k``, keys under which the segments of every text within ``most`` edits are: as many whatever the length."""
    length, ways = F.length(text), _ways(most, parts)
    places = {place: i for i, place in enumerate(sorted({(longer, n, moved) for longer, left in ways for n, moved in left}))}
    pieces = []
    for longer, n, moved in places:  # the text has so many letters more than the other
        other = length - longer
        at, size = _segment(other, n, parts)
        inside = (other >= 0) & (at + moved >= 1) & (at + moved + size <= length + 1)
        pieces.append(F.when(inside, F.xxhash64(F.substring(F.col(text), at + moved, size))))
    cut, keys = texts.withColumn("__h", F.array(*pieces)), []
    for longer, left in ways:
        own = [F.col("__h")[places[longer, n, moved]] for n, moved in left]
        whole = ~F.array_contains(F.transform(F.array(*own), lambda h: h.isNull()), True)
        keys.append(F.when(whole, F.xxhash64(length - longer, F.lit(str(tuple(n for n, _ in left))), *own)))
    return cut.select(text, F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("k"))


def _parts(texts: DataFrame, text: str, most: int) -> int:
    """The number of segments with the least work: a key for each way of the edits, and the texts that share a key by chance.

    Few segments make few keys; but where texts have much in common (a prefix, one of a few names), only keys of more of the text are rare.
    """
    work = {}
    for parts in count(most + 1):
        ways = len(_ways(most, parts))
        # keys alone cost more than the least so far, or are too many for one row
        if work and (ways + comb(parts, most) >= min(work.values()) or ways > 400):
            return min(work, key=work.get)
        met = _segments(texts, text, most, parts).groupBy("k").agg(F.count("*").alias("n")).agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("n")).first().n
        work[parts] = ways + comb(parts, most) * (met or 0)
        if most == 0:
            return parts


def _met(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """``t``, ``u`` of all texts of ``left`` (``t``) and ``right`` (``u``) that share a key; the fewer texts have the more keys. Both are read several times."""
    if right.count() < left.count():
        parts = _parts(left, "t", most)
        a, b = _segments(left.select("t"), "t", most, parts), _probes(right.select("u"), "u", most, parts)
    else:
        parts = _parts(right, "u", most)
        a, b = _probes(left.select("t"), "t", most, parts), _segments(right.select("u"), "u", most, parts)
    # the keys are many times what they are made of, which is what Spark would judge a broadcast by
    return a.join(b.hint("merge"), "k").select("t", "u")


def _pairs(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """``t``, ``u``, ``edits`` of all texts of ``left`` (``t``) and ``right`` (``u``) within ``most`` edits, each pair once."""
    edits = F.levenshtein("t", "u", most)  # -1 beyond it, and no more work than up to it
    return _met(left, right, most).select("t", "u", edits.alias("edits")).filter("edits >= 0").distinct()


def fuzzy_lookup(df: DataFrame, reference: DataFrame, column: str, ref_column: str, most: int = 2) -> DataFrame:
    """``df`` with the closest reference text within ``most`` edits, ``matched``, and its ``edits``; the smallest of several.

    One row out for each row in; nulls and texts without a match get nulls. Case and outer blanks don't count. Texts are
    compared once each, however many rows have them. Texts meet by segments that no edit touched, so all within the distance are
    found; a text costs as many keys whatever its length. The more texts share in one place (a common prefix of all
    codes), the more segments a key has.
    """
    texts = staged(df.select(_clean(column).alias("t")).filter("t is not null").distinct())
    others = reference.select(_clean(ref_column).alias("u"), F.col(ref_column).alias("name")).filter("u is not null")
    names = staged(others.groupBy("u").agg(F.min("name").alias("name")))
    close = _pairs(texts, names.select("u"), most).join(names.hint("merge"), "u")
    best = close.groupBy("t").agg(F.min(F.struct("edits", "name")).alias("m")).withColumnRenamed("t", "__t")
    joined = df.withColumn("__t", _clean(column)).join(best, "__t", "left")
    return joined.select(*df.columns, F.col("m.name").alias("matched"), F.col("m.edits").alias("edits"))


def fuzzy_groups(df: DataFrame, column: str, most: int = 1) -> DataFrame:
    """``df`` with ``group``: texts that at most so many edits link, over any number of others, share the smallest of them.

    Case and outer blanks don't count. A null text has no group.
    """
    named = df.withColumn("__t", _clean(column))
    texts = staged(named.select(F.col("__t").alias("t")).filter("t is not null").distinct())
    links = _pairs(texts, texts.select(F.col("t").alias("u")), most).filter("t < u")
    roots = components(links, "t", "u").withColumnsRenamed({"node": "__t", "root": "__r"})
    return named.join(roots, "__t", "left").withColumn("group", F.coalesce("__r", "__t")).drop("__t", "__r")


# --- common words ---


def _words(column: str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(column), r"[^\p{L}\p{Nd}]+"), lambda w: w != ""))


def _rare(sets: DataFrame, rank: DataFrame, least: float) -> DataFrame:
    """``key`` (a word), ``id``: of each set its rarest words, one more than it may lack of a set that is similar enough."""
    ranked = sets.select("id", "n", F.explode("words").alias("key")).join(rank, "key")
    order = F.sort_array(F.collect_list(F.struct("rank", "key")))
    some = F.floor(F.col("n") * (1 - F.lit(least)) + 1e-9).cast("int") + 1
    rare = ranked.groupBy("id", "n").agg(order.alias("o")).select("id", F.explode(F.slice("o", F.lit(1), some)).alias("r"))
    return rare.select("id", F.col("r.key").alias("key"))


def similar_lookup(df: DataFrame, reference: DataFrame, column: str, ref_column: str, least: float = 0.5) -> DataFrame:
    """``df`` with the reference text of the most common words, ``matched``, and ``score``: words in common over words in either.

    One row out for each row in; without a text of a score of ``least`` (over 0) or more both are null, and of equal scores the smallest
    text counts. Order, case and repeats of words don't matter. Sets that similar share one of the rarest words of each, rarest by
    both tables' counts, so all are found and few others meet.
    """
    if not 0 < least <= 1:
        raise ValueError("least is over 0, and 1 at most")
    named = df.withColumn("__w", F.sort_array(_words(column)))
    both = [
        staged(rows.filter("size(words) > 0").groupBy("words").agg(F.min("name").alias("name")).select(
            F.xxhash64("words").alias("id"), "words", F.size("words").alias("n"), "name"))
        for rows in (named.select(F.col("__w").alias("words"), F.col(column).alias("name")),
                     reference.select(F.sort_array(_words(ref_column)).alias("words"), F.col(ref_column).alias("name")))
    ]
    own, other = both
    rank = own.select("words").unionByName(other.select("words")).select(F.explode("words").alias("key")).groupBy("key").agg(F.count("*").alias("rank"))
    rank = staged(rank)
    met = _rare(own, rank, least).join(_rare(other, rank, least).withColumnRenamed("id", "ref"), "key").select("id", "ref").distinct()
    a = own.select("id", "words", "n")
    b = other.select(F.col("id").alias("ref"), F.col("words").alias("ref_words"), F.col("n").alias("ref_n"), "name")
    common = F.size(F.array_intersect("words", "ref_words"))
    score = common / (F.col("n") + F.col("ref_n") - common)
    close = met.join(a, "id").join(b, "ref").select("id", "name", score.alias("score")).filter(F.col("score") >= least)
    best = close.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "name")).alias("m")).withColumnRenamed("id", "__id")
    joined = named.withColumn("__id", F.xxhash64("__w")).join(best, "__id", "left")
    return joined.select(*df.columns, F.col("m.name").alias("matched"), (-F.col("m.s")).alias("score"))
