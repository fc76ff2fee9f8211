"""SimHash near-duplicate groups: candidate blocks, bit-sliced Hamming comparison, components.

Rows of a candidate block are compared in bit-sliced form: plane ``b`` holds bit ``b`` of 64 fingerprints per
machine word, distances are kept in carry-save counters that overflow at the radius, and a block of words
is left as soon as every lane has passed it.

``near_duplicates`` is exact for 64-bit fingerprints and a radius of up to 3: every two of them agree on two of
five bit ranges, so they share one of ten keys. ``drop_near_duplicates`` is for texts of a shingle similarity
of 0.8 or more, whose 64-bit fingerprints differ in some ten bits: it compares 256-bit fingerprints, in blocks
of documents that share a band of smallest shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgate.llm.common import joined_by_count, row_key, runs, slices, stored, utf8
from rowgate.llm.graph import components

RADIUS = 3
#: Bit ranges of the blocks; radius 3 leaves two of them untouched.
BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
#: Shingles of the texts of a tile, some 8 MB.
TILE_SHINGLES = 1 << 20
#: Rows of a candidate key that are compared in one task at once are at most twice this.
TILE = 4096
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the lower-cased word shingles; of fewer words the whole, of none nothing."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    length = np.fromiter(map(len, tokens), np.int64, len(tokens))
    start = np.zeros(len(tokens), np.int64)
    np.cumsum(length[:-1] + 1, out=start[1:])
    end = (start + length)[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], 42) for i, j in zip(start.tolist(), end, strict=False)), np.uint64, len(end))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = np.unpackbits(np.ascontiguousarray(hashes[at : at + 8192]).view(np.uint8), bitorder="little")
        ones += np.add.reduce(part.reshape(-1, 64), axis=0, dtype=np.uint16)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text; of a text without words zero."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a signed long), one row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x, words) for x in utf8(batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes (bits, rows) of fingerprints (rows, 64 lanes, words): lane j of a plane's word is the row's j-th fingerprint."""
    rows, _, words = fps.shape
    bits = np.unpackbits(fps.view(np.uint8).reshape(rows, 64, words * 8), axis=2, bitorder="little")
    packed = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64)[:, :, 0]


def _near(planes: np.ndarray, query: np.ndarray, radii: tuple[int, ...]) -> list[np.ndarray]:
    """For each of the ascending ``radii``, the lanes within it: planes (bits, ...), query (words, ...) that broadcasts against a plane.

    The counters start so far below their overflow as the last radius allows.
    """
    width = max(1, radii[-1].bit_length())
    start = (1 << width) - 1 - radii[-1]
    counter = [_ONES if start >> k & 1 else np.uint64(0) for k in range(width)]
    over = np.uint64(0)
    for b in range(len(planes)):
        bit = (query[b // 64] >> np.uint64(b % 64)) & np.uint64(1)
        carry = planes[b] ^ (np.uint64(0) - bit)
        for k in range(width):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over = over | carry
        if b % 16 == 15 and b >= 2 * radii[-1] and np.all(over == _ONES):
            break
    out = []
    for radius in radii[:-1]:
        less, equal = np.uint64(0), ~over
        for k in reversed(range(width)):
            if (start + radius) >> k & 1:
                less, equal = less | (equal & ~counter[k]), equal & counter[k]
            else:
                equal = equal & ~counter[k]
        out.append(less | equal)
    return [*out, ~over]


class _Merged:
    """Components within one compared group; a link is emitted only when it joins two of them."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.left = n  # components

    def link(self, i: int, others: np.ndarray) -> list[int]:
        new, first = np.unique(self.label[others], return_index=True)
        mine = self.label[i]
        out = [int(others[f]) for x, f in zip(new, first, strict=True) if x != mine]
        if out:
            self.label[np.isin(self.label, new)] = mine
            self.left -= len(out)
        return out


def _lanes(word: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.array([word], np.uint64).view(np.uint8), bitorder="little"))


def links_within(fps: np.ndarray, edges: np.ndarray, radii: tuple[int, ...]) -> Iterator[tuple[int, int]]:
    """Rows to link so that, in each group, all within the last of the ascending ``radii`` are connected, closer ones first.

    ``fps`` is (rows, words); a group is the rows from one of ``edges`` to the next.
    """
    size = np.diff(edges)
    small = np.flatnonzero((size >= 2) & (size <= 64))
    small = small[np.argsort(size[small], kind="stable")]
    at = 0
    while at < len(small):
        most = max(2, 1 << int(size[small[at]] - 1).bit_length())
        upto = min(at + 1024, int(np.searchsorted(size[small], most, "right")))
        yield from _small_groups(fps, edges[small[at:upto]], size[small[at:upto]], radii)
        at = upto
    for g in np.flatnonzero(size > 64):
        yield from _large_group(fps[edges[g] : edges[g + 1]], int(edges[g]), radii)


def _small_groups(fps: np.ndarray, starts: np.ndarray, size: np.ndarray, radii: tuple[int, ...]) -> Iterator[tuple[int, int]]:
    lane = np.arange(64)
    mine = np.where(lane[None, :] < size[:, None], starts[:, None] + lane, starts[:, None])
    lanes = fps[mine]
    planes = _planes(lanes)
    valid = np.where(size == 64, _ONES, (np.uint64(1) << np.minimum(size, 63).astype(np.uint64)) - np.uint64(1))
    queries = range(int(size.max()) - 1)
    near = np.array([_near(planes, lanes[:, i].T, radii) for i in queries])
    merged: dict[int, _Merged] = {}
    for level in range(len(radii)):
        for i in queries:
            found = near[i, level] & valid & ~np.uint64((2 << i) - 1)
            for k in np.flatnonzero(found):
                own = merged.setdefault(int(k), _Merged(int(size[k])))
                if own.left == 1:
                    continue
                for j in own.link(i, _lanes(found[k])):
                    yield int(starts[k]) + i, int(starts[k]) + j


def _large_group(g: np.ndarray, first: int, radii: tuple[int, ...]) -> Iterator[tuple[int, int]]:
    rows = -(-len(g) // 64)
    padded = np.zeros((rows * 64, g.shape[1]), np.uint64)
    padded[: len(g)] = g
    planes = _planes(padded.reshape(rows, 64, -1))[:, None, :]
    merged = _Merged(len(g))
    near: dict[int, list[np.ndarray]] = {}
    for level in range(len(radii)):
        for at in range(0, len(g), 256):
            if not level:
                near[at] = _near(planes[:, :, at // 64 :], g[at : at + 256].T[:, :, None], radii)
            block = near[at]
            lanes = np.unpackbits(np.ascontiguousarray(block[level]).view(np.uint8), axis=1, bitorder="little").astype(bool)
            for q in range(len(lanes)):
                if merged.left == 1:
                    return
                others = np.flatnonzero(lanes[q]) + at // 64 * 64
                others = others[(others > at + q) & (others < len(g))]
                if len(others):
                    for j in merged.link(at + q, others):
                        yield first + at + q, first + j


def _shared_bits(values: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """For rows of ``values`` (row i has those from edge[i] to edge[i + 1]) a bit for each value that several rows have."""
    _, kind, count = np.unique(values, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    several = count[kind] > 1
    number = np.cumsum(count > 1) - 1
    column, row = number[kind[several]], row[several]
    bits = np.zeros((len(edge) - 1, -(-int((count > 1).sum()) // 64)), np.uint64)
    np.bitwise_or.at(bits, (row, column // 64), np.uint64(1) << (column % 64).astype(np.uint64))
    return bits


def cross_links(
    fps: np.ndarray, edges: np.ndarray, root: np.ndarray, deal: np.ndarray, radius: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All rows of a group that are within ``radius`` and have different ``root``s, in pieces.

    Rows of the same ``deal`` meet elsewhere, unless it is negative.
    """
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if (root[lo:hi] == root[lo]).all():
            continue
        for at in range(lo, hi, 64):
            upto = min(at + 64, hi)
            near = np.bitwise_count(fps[at:upto, None] ^ fps[None, at:hi]).sum(2, dtype=np.uint16) <= radius
            near &= root[at:upto, None] != root[None, at:hi]
            near &= (deal[at:upto, None] != deal[None, at:hi]) | (deal[at:upto, None] < 0)
            i, j = np.nonzero(np.triu(near, 1))
            if len(i):
                yield i + at, j + at


def verified_links(
    fps: np.ndarray, edges: np.ndarray, root: np.ndarray, deal: np.ndarray, radius: int, values: np.ndarray, begin: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those of the ``cross_links`` of each group whose sets have a similarity of ``SIMILARITY``, as many as it takes to join them.

    Row i's set is the ``values`` from begin[i] to begin[i + 1]. Common values are counted on bit rows of what several rows have.
    """
    size = np.diff(begin)
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        bits, label = None, root[lo:hi].copy()
        for i, j in cross_links(fps[lo:hi], np.array([0, hi - lo]), root[lo:hi], deal[lo:hi], radius):
            if bits is None:
                bits = _shared_bits(values[begin[lo] : begin[hi]], begin[lo : hi + 1] - begin[lo])
            step = max(1, (1 << 21) // max(1, bits.shape[1]))
            for at in range(0, len(i), step):
                a, b = i[at : at + step], j[at : at + step]
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
                common = np.bitwise_count(bits[a] & bits[b]).sum(1, dtype=np.int64)
                alike = common >= SIMILARITY * (size[lo + a] + size[lo + b] - common)
                alike |= size[lo + a] + size[lo + b] == 0
                a, b = a[alike], b[alike]
                while len(a):
                    yield a[:1] + lo, b[:1] + lo
                    label[label == label[b[0]]] = label[a[0]]
                    apart = label[a] != label[b]
                    a, b = a[apart], b[apart]


def _compared(keyed: DataFrame, radii: tuple[int, ...], tile: int) -> DataFrame:
    """Links ``a``, ``b`` between the ``node``s (with ``fp``, binary) that share ``t``, ``key`` and are within the last radius.

    A key with more than ``tile`` nodes is cut into tiles by hash, and every two tiles meet in a
    task of their own, so no task holds a whole large group.
    """
    hot = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > tile)
    keyed = keyed.join(hot, ["t", "key"], "left").withColumn(
        "tiles", F.ceil(F.coalesce(F.col("n"), F.lit(1)) / F.lit(tile)).cast("int")
    )

    def pairs(rows: pa.Table, fps: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        found = np.array(list(links_within(fps, edges, radii)), np.int64).reshape(-1, 2)
        yield found[:, 0], found[:, 1]

    return _dealt(keyed, ["fp"], pairs)


def _unlinked(keyed: DataFrame, radius: int, tile: int, sets: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` that join all that share ``t``, ``key``, are within the radius, have different ``root``s and are alike.

    ``sets`` has the ``shingles`` of the nodes. No task holds more than two tiles of nodes, or of ``TILE_SHINGLES``.
    """
    sized = keyed.join(sets.select("node", F.size("shingles").alias("own")), "node")
    mixed = sized.groupBy("t", "key").agg(F.count("*").alias("n"), F.sum("own").alias("held"))
    tiles = F.greatest(F.ceil(F.col("n") / F.lit(tile)), F.ceil(F.col("held") / F.lit(TILE_SHINGLES)), F.lit(1)).cast("int")
    keyed = keyed.join(mixed.select("t", "key", tiles.alias("tiles")), ["t", "key"])

    def pairs(rows: pa.Table, fps: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        shingles = rows.column("shingles").combine_chunks()
        begin = shingles.offsets.to_numpy().astype(np.int64)
        root, deal = rows.column("root").to_numpy(), rows.column("deal").to_numpy()
        yield from verified_links(fps, edges, root, deal, radius, shingles.values.to_numpy(), begin)

    return _dealt(keyed.join(sets, "node"), ["fp", "root", "shingles"], pairs, 1024)


def _apart(keyed: DataFrame) -> DataFrame:
    """The rows of those keys whose nodes have several ``root``s."""
    several = keyed.groupBy("t", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    return keyed.join(several.select("t", "key"), ["t", "key"])


def _shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """``node``, ``shingles``: the distinct shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b)):
            found = [np.unique(shingle_hashes(x, words)).view(np.int64) for x in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<long>")


def _dealt(keyed: DataFrame, columns: list[str], pairs, at_least: int = 16_384) -> DataFrame:
    """``pairs`` of the nodes of each cell: two tiles of a key, or one (then ``deal`` is negative)."""
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("tiles")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1),
        lambda u: F.struct(
            (F.least(u, own).cast("long") * F.col("tiles") + F.greatest(u, own)).alias("cell"),
            F.when(u == own, F.lit(-1)).otherwise(own).alias("deal"),
        ),
    )
    keyed = keyed.select("t", "key", "node", *columns, F.explode(cells).alias("c"))
    keyed = keyed.select("t", "key", "node", *columns, "c.cell", "c.deal")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs((x for b in batches for x in slices(b, min(4096, at_least))), ["t", "key", "cell"], at_least):
            part, key, cell, node = (rows.column(c).to_numpy() for c in ("t", "key", "cell", "node"))
            cut = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (cell[1:] != cell[:-1])) + 1
            edges = np.concatenate(([0], cut, [len(node)]))
            fps = np.frombuffer(b"".join(rows.column("fp").to_pylist()), np.uint64).reshape(len(node), -1)
            for a, b in _gathered(pairs(rows, fps, edges)):
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    dealt = keyed.repartition("t", "key", "cell").sortWithinPartitions("t", "key", "cell")
    return dealt.mapInArrow(compare, "a long, b long")


def _gathered(pieces: Iterator[tuple[np.ndarray, np.ndarray]], at_least: int = 65_536) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for piece in pieces:
        held.append(piece)
        n += len(piece[0])
        if n >= at_least:
            yield np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])
            held, n = [], 0
    if held:
        yield np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links ``a``, ``b`` between distinct 64-bit fingerprints (column ``fp``, long) that connect all within the radius (3 at most)."""
    if not 0 <= radius <= 3:
        raise ValueError("the keys find distances up to 3")
    keys = []
    for n, pair in enumerate(combinations(BLOCKS, 2)):
        mask = sum(((1 << hi) - (1 << lo)) for lo, hi in pair)
        mask -= (1 << 64) if mask >= 1 << 63 else 0
        keys.append(F.struct(F.lit(n).alias("t"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")))
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select(
        F.col("fp").alias("node"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("fp"), "k.t", "k.key"
    )
    return _compared(keyed, (radius,), tile)


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``fp``, ``component_id``.

    ``component_id`` is the smallest doc_id among all documents reachable over links. Null and
    empty texts have fingerprint zero and link like any other. Repeated rows each get a row; a null
    doc_id gets one too but never names a component unless it is alone there (then null). Columns
    other than doc_id and text are not looked at. No rows give no rows.
    """
    marked = stored(fingerprints(docs, words))
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = components(links(nodes.select("fp"), radius))
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", "n", F.coalesce("root", "fp").alias("root")
    )
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = stored(named.join(smallest, "root").select("fp", "n", "component_id"))
    return joined_by_count(marked, by_fp, ["fp"]).select("doc_id", "fp", "component_id")


# --- similarity 0.8 -------------------------------------------------------------------------------------------------

SIMILARITY = 0.8
#: 256 bits; shingle sets of similarity 0.8 differ in 38.6 of them on average, with a deviation of 5.7.
WORDS = 4
#: Pairs within the last are candidates; the closest are linked first.
RADII = (20, 30, 38, 46, 60)
#: Pairs that no links join are candidates up to here: texts of few shingles are further apart (4 of 5 shared: 48, with a deviation of 6).
FAR = 72
#: A pair of similarity 0.8 shares none of 16 bands of four smallest hashes with probability 0.0002.
BANDS, ROWS = 16, 4
_RNG = np.random.default_rng(8)
_MULTIPLY = _RNG.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_WIDEN = _RNG.integers(0, 2**63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_sketch(text: bytes | None, words: int) -> tuple[bytes, list[int]]:
    """The 256-bit fingerprint of the distinct shingles, and a key for each band."""
    hashes = np.unique(shingle_hashes(text, words))
    fp = np.array([majority(_mixed(hashes * m)) for m in _WIDEN], np.uint64)
    least = np.full(BANDS * ROWS, _ONES)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[None, at : at + 2048] * _MULTIPLY[:, None]).min(1), out=least)
    least = least.reshape(BANDS, ROWS)
    keys = _mixed(least[:, 0] + _mixed(least[:, 1] + _mixed(least[:, 2] + _mixed(least[:, 3]))))
    return fp.tobytes(), keys.view(np.int64).tolist()


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The candidate links whose texts have a shingle similarity of ``SIMILARITY`` or more, by the shingle sets themselves."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = _texts(ends, nodes, docs)
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(utf8(batch.column("text_a")), utf8(batch.column("text_b")), strict=True):
                x, y = np.unique(shingle_hashes(a, words)), np.unique(shingle_hashes(b, words))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= SIMILARITY * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _texts(some: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node``, ``text`` of some nodes."""
    texts = docs.join(nodes.join(some, "node").select("node", F.col("first.row").alias("row")), "row").select("node", "text")
    return stored(texts.dropDuplicates(["node"]))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _rooted(docs: DataFrame, words: int) -> DataFrame:
    """``first``, ``root`` for each row of ``docs``: (whether the id is null, doc_id, row key), and its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = [wide_sketch(x, words) for x in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row"),
                    pa.array([s[0] for s in sketches], pa.binary()),
                    pa.array([s[1] for s in sketches], pa.list_(pa.int64())),
                ],
                ["doc_id", "row", "fp", "keys"],
            )

    own = docs.select(F.col("doc_id").cast("long"), "text", row_key().alias("row"))
    sketched = own.mapInArrow(run, "doc_id long, row string, fp binary, keys array<long>")
    first = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row").alias("first")
    marked = stored(sketched.select(first, "fp", "keys", F.xxhash64("fp", "keys").alias("node")))
    nodes = stored(marked.groupBy("node", "fp", "keys").agg(F.min("first").alias("first")))
    keyed = nodes.select("node", "fp", F.posexplode("keys").alias("t", "key"))
    pairs = stored(_ordered(_compared(keyed, RADII, TILE // 4)))
    linked = stored(_verified(pairs, nodes, own, words))
    roots = components(linked)
    # a link that failed may have kept another from being compared: now all that no verified links join
    rooted = _apart(keyed.join(roots, "node", "left").withColumn("root", F.coalesce("root", F.col("node"))))
    rooted = stored(rooted)
    sets = stored(_shingle_sets(_texts(rooted.select("node").distinct(), nodes, own), words))
    roots = components(linked.unionByName(_unlinked(rooted, FAR, TILE // 4, sets)))
    return marked.select("first", "node").join(roots, "node", "left").select("first", F.coalesce("root", "node").alias("root"))


def wide_groups(docs: DataFrame, words: int = 5) -> DataFrame:
    """``doc_id``, ``component_id`` for each row of ``docs``: groups of documents linked by a shingle similarity of 0.8 or more.

    In every candidate block the closest fingerprints are linked first, as long as a link connects anything new, and the
    links are verified by their shingle sets. Then, in blocks that these don't join, every pair is verified where it
    meets, and what joins anything is a link. Null and wordless texts are one group. A null doc_id is a document like another, without a say in names.
    Of rows with one doc_id and several texts each is a document.
    """
    rooted = stored(_rooted(docs, words))
    smallest = rooted.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    return rooted.join(smallest, "root").select("first.doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, the one with the smallest doc_id; columns unchanged.

    A null doc_id comes last. Of rows with that id and several texts in the group one stays, as of repeated rows.
    """
    name = "_" + "_".join(docs.columns)
    keep = _rooted(docs, words).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(name))
    # one deal by the row's key serves the join and the choice among repeated rows
    return docs.withColumn(name, row_key()).join(keep, name, "left_semi").dropDuplicates([name]).select(*docs.columns)
