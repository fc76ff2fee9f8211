"""Order MinHash fingerprints, and documents paired with the next by id.

A text's tokens are its code points, and a k-mer of ``K`` ends at each of them (blanks stand before the first), numbered
by its occurrence.
For each of ``SKETCHES`` hash functions the two smallest are selected, put back in text order and
hashed as a tuple; signatures of two texts agree in a position if both selections agree in
content and order, so likeness falls with edit distance, not only with lost content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgate.llm.common import utf8

K = 5
#: k-mers that are hashed at once, so that working arrays stay in the cache.
BLOCK = 4096
SKETCHES = 64
_RNG = np.random.default_rng(20_240_607)
_MULTIPLY = _RNG.integers(0, 2**63, SKETCHES, np.uint64) * np.uint64(2) + np.uint64(1)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbered(kmers: np.ndarray) -> np.ndarray:
    """k-mer hashes made different by the number of their occurrence."""
    order = np.argsort(kmers, kind="stable")
    sorted_ = kmers[order]
    new = np.ones(len(kmers), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    if new.all():
        return _mixed(kmers)
    first = np.maximum.accumulate(np.where(new, np.arange(len(kmers)), 0))
    out = np.empty_like(kmers)
    out[order] = _mixed(sorted_ + (np.arange(len(kmers)) - first).astype(np.uint64) * _PRIME)
    return out


def word_hashes(text: bytes) -> np.ndarray:
    """The code points."""
    return np.frombuffer(text.decode().encode("utf-32-le"), np.uint32).astype(np.uint64)


def signature(words: np.ndarray) -> np.ndarray:
    """SKETCHES 16-bit values; of a text without code points a constant."""
    padded = np.concatenate((np.zeros(K - 1, np.uint64), words + np.uint64(1)))
    kmers = padded[: len(words)].copy()
    for i in range(1, K):
        kmers = kmers * _PRIME + padded[i : len(words) + i]
    kmers = _numbered(_mixed(kmers)) if len(words) else np.zeros(1, np.uint64)
    # the two smallest of each block, then of all blocks
    blocks = -(-len(kmers) // BLOCK)
    at = np.empty((SKETCHES, 2 * blocks), np.int64)
    least = np.empty((SKETCHES, 2 * blocks), np.uint64)
    rows = np.arange(8)
    for n in range(blocks):
        part = kmers[n * BLOCK : (n + 1) * BLOCK]
        for i in range(0, SKETCHES, 8):
            h = part[None, :] * _MULTIPLY[i : i + 8, None]
            for k in (2 * n, 2 * n + 1):
                j = h.argmin(1)
                at[i : i + 8, k], least[i : i + 8, k] = j + n * BLOCK, h[rows, j]
                h[rows, j] = np.uint64(0xFFFFFFFFFFFFFFFF)
    first = np.argsort(least, axis=1, kind="stable")[:, :2]
    picked = np.sort(np.take_along_axis(at, first, 1), axis=1)
    pairs = kmers[picked]
    return (_mixed(pairs[:, 0] * _PRIME + pairs[:, 1]) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def neighbours(docs: DataFrame, partitions: int) -> DataFrame:
    """(doc_id, text, bucket, again): range buckets by doc_id; each bucket also gets the next one's first row, again = true.

    The last bucket is followed by the first document of all. Only the buckets' bounds, one id
    each, pass through the driver. Rows of one id and equal text are neighbours in any order.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    at = [i / partitions for i in range(1, partitions)]
    cuts = ids.agg(F.percentile_approx("doc_id", at, 4 * partitions)).first()[0] if at else None
    cuts = sorted(set(cuts or []))
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bucket = F.lit(0)
    if cuts:
        bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(
            F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c <= F.col("doc_id")))
        )
    numbered = numbered.withColumn("bucket", bucket.cast("int"))
    key = F.struct("doc_id", F.xxhash64("text").alias("t"))
    firsts = [r for r in numbered.groupBy("bucket").agg(F.min(key).alias("k")).collect()]
    if not firsts:
        return numbered.withColumn("again", F.lit(False))
    have = sorted((r["bucket"], r["k"]["doc_id"], r["k"]["t"]) for r in firsts)
    follows = [(have[i - 1][0], d, t) for i, (_, d, t) in enumerate(have)]
    spark = docs.sparkSession
    heads = F.broadcast(spark.createDataFrame(follows, "before int, d long, t long"))
    again = (
        numbered.join(heads, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("t")))
        .select("doc_id", "text", F.col("before").alias("bucket"))
        .dropDuplicates(["doc_id", "bucket"])
        .withColumn("again", F.lit(True))
    )
    return numbered.withColumn("again", F.lit(False)).unionByName(again)


def fingerprint_pairs(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprints of each document and of its edited text, and how alike they are.

    The edited text has the last half of the code points replaced by as many of the next
    document's first ones (fewer if that is shorter); after the last document comes the first.
    One row for each row of ``docs``; rows of one id follow each other by the texts' hash. Null
    texts are empty, a null id sorts first. No rows give no rows; a single document is its own next.
    """
    partitions = partitions or max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("bucket", "again", "doc_id"))
            for bucket, again, doc_id, raw in zip(*columns, utf8(batch.column("text")), strict=True):
                raw = raw or b""
                words = word_hashes(raw)
                new = (bucket, again, doc_id, raw, words, signature(words))
                if held is not None and held[0] == bucket:
                    rows.append(_compared(held, new))
                held = None if again else new
            yield _batch(rows)

    pairs = neighbours(docs, partitions)
    order = ["bucket", "again", "doc_id", F.xxhash64("text")]
    dealt = pairs.repartitionByRange(partitions, "bucket").sortWithinPartitions(*order)
    return dealt.mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def _compared(mine: tuple, following: tuple) -> tuple:
    _, _, doc_id, raw, words, own = mine
    text, n = raw.decode(), 0
    n = len(text)
    kept = text[: n - n // 2]
    # n // 2 code points take at most four bytes each
    head = following[3][: 4 * (n // 2)].decode(errors="ignore")[: n // 2]
    edited = (kept + head).encode()
    theirs = own if edited == raw else signature(word_hashes(edited))
    return (
        doc_id,
        n,
        hashlib.sha256(edited).hexdigest(),
        own.byteswap().tobytes().hex(),
        theirs.byteswap().tobytes().hex(),
        likeness(own, theirs),
        likeness(own, following[5]),
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
