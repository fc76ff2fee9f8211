"""URL filters: rules, host word segmentation, multinomial naive Bayes over host and path tokens.

Concatenated host names are split by a unigram Viterbi pass whose word counts come from all pages'
texts. There are no labels, so naive Bayes learns from pages whose segmented host has a seed word (blocked) or not. The seed
words themselves aren't among what it learns from: it learns what else goes with them, and judges hosts without any by that. A
seed word weighs as if it had been seen ``SEED_COUNT`` times on blocked pages.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgate.llm.common import joined_by_count, stored

#: (host, path, verdict): fits the host and its subdomains if the path starts with the rule's.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Host words that mark a page as blocked when the classifier learns.
SEEDS = ("ads", "adult", "bet", "bets", "casino", "cheap", "clickbait", "escort", "loans", "lottery", "malware", "pills", "porn", "spam", "track", "viagra", "xxx")
SEED_COUNT = 10.0
#: Letters of a word at most, and of a run of letters that is split at once (a label of a host name has 63 at most); longer runs are cut.
WORD_MOST, NAME_MOST = 24, 256


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; without it empty."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host`` + ``path``, and its verdict; null where none does."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return name, verdict


def _letters(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def _names(host: Column) -> Column:
    cut = F.transform(_letters(host), lambda w: F.regexp_extract_all(w, F.lit(f"(.{{1,{NAME_MOST}}})"), F.lit(1)))
    return F.flatten(cut)


def word_counts(pages: DataFrame) -> DataFrame:
    """``word``, ``n`` over the visible texts of all pages."""
    visible = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<[^>]*>|&[#\w]+;", " ")
    words = pages.select(F.explode(_letters(visible)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def viterbi(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest split of ``name``; a stretch that isn't a word costs more the longer it is."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        choices = []
        for start in range(max(0, end - WORD_MOST), end):
            word = name[start:end]
            n = counts.get(word)
            # what no text has: as likely as ten counts, ten times less for each letter
            p = math.log(n / total) if n else math.log(10 / total) - math.log(10) * len(word)
            choices.append((best[start][0] + p, start))
        best.append(max(choices, key=lambda c: (c[0], -c[1])))
    out, at = [], len(name)
    while at:
        out.append(name[best[at][1] : at])
        at = best[at][1]
    return out[::-1]


def segment(names: DataFrame, counts: DataFrame) -> DataFrame:
    """``name``, ``words`` for each distinct ``name`` (letters only).

    A name meets only the counts of its own substrings, by a join: no worker holds the vocabulary.
    """
    total = counts.agg(F.sum("n")).first()[0] or 1
    names = names.select("name").distinct()
    starts = F.sequence(F.lit(1), F.length("name"))
    parts = F.flatten(
        F.transform(
            starts,
            lambda i: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(WORD_MOST), F.length("name") - i + 1)), lambda k: F.substring("name", i, k)
            ),
        )
    )
    pieces = names.filter("name <> ''").select("name", F.explode(F.array_distinct(parts)).alias("word"))
    known = pieces.join(counts, "word").groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("known"))

    @F.pandas_udf("array<string>")
    def split(name: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([viterbi(n, dict(k) if k is not None else {}, total) for n, k in zip(name, known, strict=True)])

    return names.filter("name <> ''").join(known, "name", "left").select("name", split("name", "known").alias("words"))


def classify(urls: DataFrame, counts: DataFrame, seeds: tuple[str, ...] = SEEDS, smoothing: float = 1.0) -> DataFrame:
    """``url``, ``tokens``, ``block_log_odds`` for each distinct ``url`` (with ``host``, ``path``).

    Tokens are the words of the segmented host and the letter runs of the path; one that comes up again in a url counts once.
    """
    urls = stored(urls.select("url", "host", "path", F.lit(1).alias("one")).groupBy("url", "host", "path").agg(F.sum("one").alias("n")))
    pieces = urls.select("host").distinct().select("host", F.posexplode(_names(F.col("host"))).alias("pos", "name"))
    words = segment(pieces, counts)
    hosts = pieces.join(words, "name").groupBy("host").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "words"))), lambda x: x["words"])).alias("host_words")
    )
    seeded = F.arrays_overlap("host_words", F.lit(list(seeds)))
    hosts = hosts.withColumn("seeded", seeded)
    path_words = F.transform(_letters(F.col("path")), lambda w: F.concat(F.lit("/"), w))
    named = stored(urls.groupBy("host").agg(F.count("*").alias("urls")).join(hosts, "host", "left"))
    bags = joined_by_count(urls, named, ["host"], "urls").select(
        "url",
        F.md5(F.coalesce("url", F.lit(""))).alias("key"),  # a long url doesn't go with each of its tokens
        "n",
        F.coalesce("seeded", F.lit(False)).alias("seeded"),
        F.concat(F.coalesce("host_words", F.array().cast("array<string>")), path_words).alias("tokens"),
    )
    bags = stored(bags)
    occurrences = bags.select("key", "n", "seeded", F.explode(F.array_distinct("tokens")).alias("token"))
    is_seed = F.col("token").isin(*seeds)
    bad, good = F.when(F.col("seeded"), F.col("n")).otherwise(0), F.when(F.col("seeded"), 0).otherwise(F.col("n"))
    by_token = occurrences.groupBy("token").agg(F.sum(bad).alias("bad"), F.sum(good).alias("good"), F.count("*").alias("rows"))
    by_token = stored(
        by_token.select(
            "token", "rows", F.when(is_seed, SEED_COUNT).otherwise(F.col("bad")).alias("bad"), F.when(is_seed, 0.0).otherwise(F.col("good")).alias("good")
        )
    )
    sums = by_token.agg(F.sum("bad"), F.sum("good"), F.count("*")).first()
    classes = bags.agg(F.sum(F.when(F.col("seeded"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("seeded"), 0).otherwise(F.col("n")))).first()
    bad, good, kinds = (float(x or 0) for x in sums)
    prior = math.log(((classes[0] or 0) + smoothing) / ((classes[1] or 0) + smoothing))
    base = math.log((good + smoothing * max(1.0, kinds)) / (bad + smoothing * max(1.0, kinds)))
    odds = F.log((F.col("bad") + smoothing) / (F.col("good") + smoothing)) + F.lit(base)
    scored = joined_by_count(occurrences, by_token.select("token", "rows", odds.alias("odds")), ["token"], "rows").groupBy("key").agg(F.sum("odds").alias("odds"))
    return bags.join(scored, "key", "left").select("url", "tokens", (F.coalesce("odds", F.lit(0.0)) + F.lit(prior)).alias("block_log_odds"))


def judge(pages: DataFrame, rules: tuple = RULES, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """One row for each row of ``pages``: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``block_log_odds``, ``tokens``.

    A rule decides; without one, a page is blocked if its tokens are likelier under blocked than under
    other pages. A null url, or one without ``://``, has empty host and path, no tokens, and the prior's verdict.
    Null html adds no words. No rows give no rows.
    """
    own = pages.select("page_id", "url", "html")
    own = own.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    counts = stored(word_counts(own))
    judged = classify(own, counts, seeds).withColumnRenamed("url", "judged_url")
    rule, fixed = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("block_log_odds") > 0, "block").otherwise("allow")
    return (
        own.drop("html")
        .join(judged, F.col("url").eqNullSafe(F.col("judged_url")))
        .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(fixed, method).alias("verdict"), "block_log_odds", "tokens")
    )
