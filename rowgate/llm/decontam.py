"""Benchmark decontamination: item-sized SimHash windows, a multi-index of Hamming blocks, exact shingle similarity.

Texts are lower-cased words without ASCII punctuation, shingles five words (a shorter item is one shingle). A window has as
many words as the items it is held against. The 64-bit SimHashes of those items stand in an index of four tables, one for
each block of 16 bits: two fingerprints within ``RADIUS`` differ in at most ``REACH`` bits in one of the blocks, so a window
meets the items in the slots that near its own. What meets and is within the radius is a candidate, and the similarity of
the two multisets of shingles (sum of smaller by sum of larger counts) decides. A window that has no shingle of any item has
similarity 0 to all and isn't hashed.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgate.llm.common import row_key, slices, stored, utf8
from rowgate.llm.simhash import majority

SHINGLE = 5
SIMILARITY = 0.8
#: Shingle sets of similarity 0.8 differ in 9.7 bits on average, with a deviation of 2.9.
RADIUS = 18
#: Blocks of 16 bits, and how far one of them must near the item's: were each further off, RADIUS would be passed.
BLOCKS = 4
REACH = RADIUS // BLOCKS
#: Bytes of items that are held against documents at once; a larger benchmark takes more steps.
BLOCK_BYTES = 16 << 20
#: Documents that meet a block in one task.
DEAL = 20_000
#: Bits of the filter by which a benchmark of several blocks picks the documents that have any of its shingles.
FILTER_BITS = 1 << 27
#: Windows that are hashed at once, pairs of windows and items that are looked at at once.
STRETCH = 8192
PAIRS = 1 << 20
_PLAIN = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").decode(errors="replace").lower().encode().translate(_PLAIN).split()


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _hash(words: list[bytes], start: int, end: int, size: int) -> np.ndarray:
    """Hashes of the shingles that start in [start, end)."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(words[i : i + size]), 42) for i in range(start, end)), np.uint64, end - start)


def window_fingerprints(hashes: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every ``size`` shingles in a row: the first window's bits, then what comes in and goes out."""
    first = np.zeros(64, np.int32)
    for at in range(0, size, STRETCH):
        first += _bits(hashes[at : min(at + STRETCH, size)]).sum(0, dtype=np.int32)
    ones = np.empty((len(hashes) - size + 1, 64), np.int32)
    ones[0] = first
    ones[1:] = _bits(hashes[size:])
    ones[1:] -= _bits(hashes[: len(hashes) - size])
    np.cumsum(ones, axis=0, out=ones)
    return np.packbits(ones * 2 > size, axis=1, bitorder="little").view(np.uint64)[:, 0]


class Index:
    """Fingerprints of the items of one size, by the values of their blocks."""

    def __init__(self, fps: np.ndarray) -> None:
        self.fps = fps
        self.tables = []
        for b in range(BLOCKS):
            value = fps.view(np.uint16).reshape(-1, 4)[:, b]
            order = np.argsort(value, kind="stable").astype(np.int32)
            slots, first = np.unique(value[order], return_index=True)
            self.tables.append((slots, np.append(first, len(order)), order))

    def near(self, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, item) pairs within the radius, in pieces."""
        values = fps.view(np.uint16).reshape(-1, 4)
        for b, (slots, edge, order) in enumerate(self.tables):
            # windows in a row have few different values in a block
            asked, back = np.unique(values[:, b], return_inverse=True)
            by_value = np.argsort(back, kind="stable")
            bounds = np.searchsorted(back[by_value], np.arange(len(asked) + 1))
            for k, v in enumerate(asked.tolist()):
                hit = np.flatnonzero(np.bitwise_count(slots ^ np.uint16(v)) <= REACH)
                if not len(hit):
                    continue
                items = np.concatenate([order[edge[i] : edge[i + 1]] for i in hit.tolist()])
                mine = by_value[bounds[k] : bounds[k + 1]]
                step = max(1, PAIRS // len(mine))
                for at in range(0, len(items), step):
                    some = items[at : at + step]
                    differ = fps[mine][:, None] ^ self.fps[some][None, :]
                    i, j = np.nonzero(np.bitwise_count(differ) <= RADIUS)
                    # a pair that an earlier block brought together has been looked at
                    new = np.ones(len(i), bool)
                    blocks = differ[i, j].view(np.uint16).reshape(-1, 4)
                    for earlier in range(b):
                        new &= np.bitwise_count(blocks[:, earlier]) > REACH
                    if new.any():
                        yield mine[i[new]], some[j[new]]


class Items:
    """The items of one block, in arrays."""

    def __init__(self, rows: list[tuple[int, bytes]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[int] = []
        fps, sizes, hashes = [], [], []
        keys: dict[int, list[np.ndarray]] = defaultdict(list)
        owners: dict[int, list[np.ndarray]] = defaultdict(list)
        for item_id, text in rows:
            words = words_of(text)
            if not words:
                continue
            width = min(SHINGLE, len(words))
            own = _hash(words, 0, len(words) - width + 1, width)
            numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint64)
            keys[width].append(_keys(numbers, width))
            owners[width].append(np.full(len(own), len(words), np.int64))
            self.ids.append(item_id)
            sizes.append(len(words))
            hashes.append(own)
            fps.append(majority(own))
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.edge = np.concatenate(([0], np.cumsum([len(h) for h in hashes]))).astype(np.int64)
        #: For each shingle width: the keys of all item shingles, sorted, and the sizes of the items that have them.
        self.shingles: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width, parts in keys.items():
            pairs = np.unique(np.stack((np.concatenate(parts), np.concatenate(owners[width]).astype(np.uint64))), axis=1)
            found, first = np.unique(pairs[0], return_index=True)
            self.shingles[width] = found, np.append(first, pairs.shape[1]), pairs[1].astype(np.int64)
        self.by_size: dict[int, tuple[np.ndarray, Index]] = {}
        size, fp = np.array(sizes, np.int64), np.array(fps, np.uint64)
        order = np.argsort(size, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else []:
            self.by_size[int(size[own[0]])] = own, Index(fp[own])

    def counts(self, n: int) -> Counter:
        return Counter(self.hashes[self.edge[n] : self.edge[n + 1]].tolist())

    def matches(self, text: bytes | None) -> Iterator[tuple[int, float, int]]:
        """(item, similarity, first word) of the best window of each item that is reached."""
        words = words_of(text)
        get = self.vocabulary.get
        numbers = np.fromiter([get(w, 0) for w in words], np.uint64, len(words))
        for width, (keys, edge, sizes) in self.shingles.items():
            if len(words) < width:
                continue
            known = numbers != 0
            whole = np.flatnonzero(np.logical_and.reduce([known[i : len(words) - width + 1 + i] for i in range(width)]))
            if not len(whole):
                continue
            mine = _keys(numbers, width)[whole]
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            hit = keys[at] == mine
            if not hit.any():
                continue
            positions: dict[int, list[int]] = defaultdict(list)
            for position, k in zip(whole[hit].tolist(), at[hit].tolist(), strict=True):
                for size in sizes[edge[k] : edge[k + 1]].tolist():
                    positions[size].append(position)
            for size, found in positions.items():
                yield from self._windows(words, width, size, found)

    def _windows(self, words: list[bytes], width: int, size: int, positions: list[int]) -> Iterator[tuple[int, float, int]]:
        """``positions`` are those of known shingles, ascending."""
        own, index = self.by_size[size]
        shingles = size - width + 1
        starts = len(words) - size + 1
        if starts <= 0:  # the document is shorter than the item: its one window is the whole text
            shingles, starts = len(words) - width + 1, 1
        spans: list[list[int]] = []
        for p in positions:
            lo, hi = max(0, p - shingles + 1), min(p + 1, starts)
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(hi, spans[-1][1])
            elif lo < hi:
                spans.append([lo, hi])
        best: dict[int, tuple[float, int]] = {}
        theirs: dict[int, Counter] = {}
        for lo, hi in spans:
            hashes = _hash(words, lo, hi + shingles - 1, width)
            for at in range(0, hi - lo, STRETCH):  # working arrays of bounded size, however long the text is
                part = hashes[at : min(at + STRETCH, hi - lo) + shingles - 1]
                for windows, items in index.near(window_fingerprints(part, shingles)):
                    for w in np.unique(windows).tolist():
                        inside = Counter(part[w : w + shingles].tolist())
                        for n in own[items[windows == w]].tolist():
                            if n not in theirs:
                                if len(theirs) > 4096:
                                    theirs.clear()
                                theirs[n] = self.counts(n)
                            common = (inside & theirs[n]).total()
                            likeness = common / (shingles + theirs[n].total() - common)
                            found = likeness, -(lo + at + w)
                            if likeness and found > best.get(n, (0.0, 0)):
                                best[n] = found
        for n, (likeness, start) in best.items():
            yield n, likeness, -start


def _keys(numbers: np.ndarray, width: int) -> np.ndarray:
    out = numbers[: len(numbers) - width + 1].copy()
    for i in range(1, width):
        out = (out * _P) ^ (out >> np.uint64(31))
        out += numbers[i : len(numbers) - width + 1 + i]
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Documents with a passage that is nearly a benchmark item.

    ``doc_id``, ``item_id``, ``similarity`` (of the best window), ``first_word`` (the window's, counted from 0): a row for each
    document row and item of at least ``similarity``. Null and wordless texts and items match nothing. Repeated
    documents each get their rows; items of one id count as one, by their best. Empty tables give no rows.

    The benchmark is a stated query set. One of up to ``BLOCK_BYTES`` (or one item) goes to all workers. A larger one is cut into
    blocks of about that size: one pass picks the documents that have any shingle of any item, by a filter of ``FILTER_BITS``
    whatever the benchmark's size, and each block goes to tasks of its own with those documents that share a shingle with it.
    """
    return _found(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, similarity)


def _found(texts: DataFrame, benchmark: DataFrame, similarity: float) -> DataFrame:
    """``leaks`` of ``texts`` (a key and the text), by that key."""
    key = texts.columns[0]
    items = benchmark.select(F.col("item_id").cast("long"), "text").filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    schema = f"{key} {texts.schema[key].dataType.simpleString()}, item_id long, similarity double, first_word long"
    if not blocks:
        return texts.sparkSession.createDataFrame([], schema)
    if blocks == 1:
        held = Items([(r[0], r[1].encode()) for r in items.collect()])
        return texts.mapInArrow(_matcher(held, similarity), schema)
    return _in_blocks(texts.select(F.col(key).alias("key"), "text"), items, blocks, similarity).toDF(key, "item_id", "similarity", "first_word")


def _in_blocks(texts: DataFrame, items: DataFrame, blocks: int, similarity: float) -> DataFrame:
    """``leaks`` of a benchmark of several blocks: each block and the documents that have any of its shingles go to tasks of their own.

    Nothing of the benchmark comes to the driver. A block that many documents meet is dealt to several tasks, each with ``DEAL`` of them.
    """
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"))
    picked = stored(_having_shingles(texts, items).withColumn("id", F.monotonically_increasing_id()))
    theirs = items.select("block", "text").mapInArrow(_item_marks, "block int, mark long").distinct()
    met = stored(picked.select("id", F.explode("marks").alias("mark")).join(theirs, "mark").select("id", "block").distinct())
    sizes = stored(met.groupBy("block").agg(F.ceil(F.count("*") / F.lit(DEAL)).cast("int").alias("deals")))
    dealt = met.join(sizes, "block").withColumn("deal", F.pmod(F.xxhash64("id"), F.col("deals")).cast("int"))
    own = dealt.join(picked.select("id", "text"), "id").select("block", "deal", F.lit(1).alias("kind"), "id", F.lit(None).cast("long").alias("item_id"), "text")
    copies = items.join(sizes, "block").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    both = copies.select("block", "deal", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), "item_id", "text").unionByName(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, match = None, [], None
        for batch in (x for b in batches for x in slices(b)):
            group = list(zip(batch.column("block").to_pylist(), batch.column("deal").to_pylist(), batch.column("kind").to_pylist(), strict=True))
            cuts = [i for i in range(batch.num_rows) if not i or group[i] != group[i - 1]]
            for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                part = batch.slice(lo, hi - lo)
                if group[lo][:2] != at:
                    at, rows, match = group[lo][:2], [], None
                if group[lo][2] == 0:
                    rows += zip(part.column("item_id").to_pylist(), utf8(part.column("text")), strict=True)
                    continue
                if match is None:
                    match, rows = _matcher(Items(rows), similarity), []
                yield from match(iter([part.select(["id", "text"])]))

    sorted_ = both.repartition("block", "deal").sortWithinPartitions("block", "deal", "kind")
    found = sorted_.mapInArrow(run, "id long, item_id long, similarity double, first_word long")
    # texts of one item may stand in several blocks
    best = found.groupBy("id", "item_id").agg(F.max(F.struct("similarity", (-F.col("first_word")).alias("place"))).alias("b"))
    return best.join(picked.select("id", "key"), "id").select("key", "item_id", "b.similarity", (-F.col("b.place")).alias("first_word"))


def _item_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(n, _marks(w, min(SHINGLE, len(w)))) for n, w in zip(batch.column("block").to_pylist(), map(words_of, utf8(batch.column("text"))), strict=True) if w]
        at = np.concatenate([np.zeros(0, np.int64), *(m.astype(np.int64) for _, m in found)])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([n for n, _ in found], [len(m) for _, m in found]).astype(np.int32)), pa.array(at)], ["block", "mark"])


def _marks(words: list[bytes], width: int) -> np.ndarray:
    """Positions of a text's shingles in the filter."""
    hashes = _hash(words, 0, len(words) - width + 1, width) + np.uint64(width)
    return ((hashes * _P) >> np.uint64(32)) % np.uint64(FILTER_BITS)


def _having_shingles(texts: DataFrame, items: DataFrame) -> DataFrame:
    """The ``texts`` (``key``, ``text``) with a shingle of any item, and a few others, with the ``marks`` of such shingles."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(min(SHINGLE, len(w)), w) for w in map(words_of, utf8(batch.column("text"))) if w]
            at = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_marks(w, n) for n, w in found)])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], ["word", "bits"])
            widths = sorted({n for n, _ in found})
            yield pa.RecordBatch.from_arrays([pa.array([-1] * len(widths), pa.int64()), pa.array(widths, pa.int64())], ["word", "bits"])

    rows = items.select("text").mapInArrow(marked, "word long, bits long")
    words = rows.filter("word >= 0").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # FILTER_BITS / 64 rows at most
    widths = sorted(r[0] for r in rows.filter("word < 0").select("bits").distinct().collect())
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(bits.view(np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            found = []
            for words in map(words_of, utf8(batch.column("text"))):
                places = np.concatenate([np.zeros(0, np.int64), *(_marks(words, n).astype(np.int64) for n in widths if len(words) >= n)])
                found.append(np.unique(places[(table[places >> 3] >> (places & 7).astype(np.uint8) & 1) != 0]))
            whole = pa.RecordBatch.from_arrays([batch.column("key"), batch.column("text"), pa.array(found, pa.list_(pa.int64()))], ["key", "text", "marks"])
            yield whole.filter(pa.array([len(m) > 0 for m in found], pa.bool_()))

    return texts.mapInArrow(run, f"key {texts.schema['key'].dataType.simpleString()}, text string, marks array<long>")


def _matcher(items: Items, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column("text")), strict=True):
                best: dict[int, tuple[float, int]] = {}
                for n, likeness, start in items.matches(text):
                    if likeness >= similarity:
                        best[items.ids[n]] = max(best.get(items.ids[n], (0.0, 0)), (likeness, start))
                rows += ((doc_id, item_id, *x) for item_id, x in sorted(best.items(), key=lambda b: (b[0] is None, b[0] or 0)))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            types = (batch.column(0).type, pa.int64(), pa.float64(), pa.int64())
            names = [batch.schema.names[0], "item_id", "similarity", "first_word"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return run


def drop_leaking(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without those that have a benchmark passage; columns unchanged. Each row goes by its own text."""
    name = "_" + "_".join(docs.columns)
    # written first: its size is known then, and where it is small the documents need no shuffle
    found = stored(_found(docs.select(row_key().alias("row"), "text"), benchmark, similarity).select("row").distinct())
    return docs.withColumn(name, row_key()).join(found.toDF(name), name, "left_anti").select(*docs.columns)
