"""MinHash near-duplicates: b-bit signatures met by a multi-index Hamming join, links confirmed on full shingle sets.

A signature is 40 positions of 16 bits, each the low bits of the smallest shingle hash under one of 40 hash functions. It is split into
eight chunks of five positions. By pigeonhole, signatures that differ in 15 positions or fewer differ in at most one
position of some chunk, so the errors that are allowed in a chunk are enumerated: each of its positions is left out in turn, and
the other four are a key. All pairs at that distance share one of 40 keys. Sets of similarity 0.85 share none with
probability 6e-7, and differ in more than ``REACH`` positions with 2e-7; sets that share a key by chance are told by their full sets.

Not every pair of a key is compared. First each set is held against the smallest of its key. Then, where that hasn't joined all
of a key, those that aren't joined meet in cells of bounded size, nearest work first: what is joined there isn't compared again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgate.llm.common import joined_by_count, row_key, runs, slices, stored, utf8
from rowgate.llm.graph import components
from rowgate.llm.simhash import shingle_hashes

CHUNKS, WIDTH, ERRORS = 8, 5, 1
POSITIONS = CHUNKS * WIDTH
#: All signatures that differ in so many positions share a key.
GUARANTEED = CHUNKS * (ERRORS + 1) - 1
#: Pairs that differ in more positions aren't confirmed on their sets.
REACH = 19
#: A cell holds two tiles, each of so many nodes, or shingles, at most.
TILE, TILE_SHINGLES = 1024, 1 << 19
_RNG = np.random.default_rng(13)
_MULTIPLY = _RNG.integers(0, 2**63, POSITIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_KEPT = [np.array(c) + WIDTH * n for n in range(CHUNKS) for c in combinations(range(WIDTH), WIDTH - ERRORS)]
_SALT = _RNG.integers(0, 2**63, len(_KEPT), np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The 16-bit values of a set of shingle hashes."""
    least = np.full(POSITIONS, ~np.uint64(0))
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[None, at : at + 2048] * _MULTIPLY[:, None]).min(1), out=least)
    return (least & np.uint64(0xFFFF)).astype(np.uint16)


def keys(signatures: np.ndarray) -> np.ndarray:
    """For each row of signatures its keys: for each chunk and each choice of positions that may be wrong, the others' bits."""
    out = np.empty((len(signatures), len(_KEPT)), np.uint64)
    for n, kept in enumerate(_KEPT):
        out[:, n] = np.ascontiguousarray(signatures[:, kept]).view(np.uint64)[:, 0]
    x = (out + _SALT) * np.uint64(0x9E3779B97F4A7C15)  # one-to-one, and apart by chunk and choice
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _sketched(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id``, ``row`` (its key), ``size`` of the set, ``node`` (128 bits of the set), ``sig`` for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            sets = [np.unique(shingle_hashes(x, words)) for x in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row"),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "row", "size", "node", "sig"],
            )

    own = docs.select(F.col("doc_id").cast("long"), "text", row_key().alias("row"))
    return own.mapInArrow(run, "doc_id long, row string, size int, node binary, sig binary")


def _keyed(nodes: DataFrame) -> DataFrame:
    """``key``, ``node``, ``size``: a row for each key of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, 1024)):
            if batch.num_rows:
                found = keys(_signatures(batch.column("sig")))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("size"), lists], ["node", "size", "keys"])

    lists = nodes.select("node", "size", "sig").mapInArrow(run, "node binary, size int, keys array<long>")
    return lists.select(F.explode("keys").alias("key"), "node", "size")


def _signatures(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), POSITIONS)


def _alike(a: str | Column, b: str | Column, percent: int) -> Column:
    """Whether sets of these sizes can be that similar."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``node``, ``shingles``: the distinct shingle hashes of some nodes, by the text of one of their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            found = [np.unique(shingle_hashes(x, words)).view(np.int64) for x in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])

    texts = docs.select("text", row_key().alias("row")).join(nodes.select("row", "node"), "row").dropDuplicates(["row"])
    return texts.select("node", "text").mapInArrow(run, "node binary, shingles array<long>")


def _confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) within ``REACH`` whose sets are that similar."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apart = (_signatures(batch.column("sig_a")) != _signatures(batch.column("sig_b"))).sum(1)
                yield batch.select(["a", "b"]).filter(pa.array(apart <= REACH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, 1024)):
            x, y = batch.column("set_a"), batch.column("set_b")
            alike = [_share(x[i].values.to_numpy(), y[i].values.to_numpy(), percent) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    sigs = nodes.select("node", "sig")
    met = pairs.join(sigs.toDF("a", "sig_a"), "a").join(sigs.toDF("b", "sig_b"), "b").mapInArrow(near, "a binary, b binary")
    both = met.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    return both.mapInArrow(run, "a binary, b binary")


def _share(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def joining(
    sig: np.ndarray, root: np.ndarray, deal: np.ndarray, values: np.ndarray, begin: np.ndarray, percent: int, reach: int = REACH
) -> Iterator[tuple[int, int]]:
    """Pairs of rows to link so that all that are within ``reach`` and similar end up connected, given that those of one ``root`` are.

    Row i's set is the ``values`` from begin[i] to begin[i + 1]. Rows of the same ``deal`` meet elsewhere, unless it is negative.
    """
    number = np.unique(values, return_inverse=True)[1]
    size, label = np.diff(begin), root.copy()
    mine = np.zeros(int(number.max(initial=-1)) + 1, bool)
    for i in range(len(label) - 1):
        n = size[i]
        ok = (label[i + 1 :] != label[i]) & (np.minimum(size[i + 1 :], n) * 100 >= np.maximum(size[i + 1 :], n) * percent)
        if deal[i] >= 0:
            ok &= deal[i + 1 :] != deal[i]
        others = np.flatnonzero(ok) + i + 1
        others = others[(sig[others] != sig[i]).sum(1) <= reach]
        if not len(others):
            continue
        own = number[begin[i] : begin[i + 1]]
        mine[own] = True
        for at in range(0, len(others), 512):
            some = others[at : at + 512]
            some = some[label[some] != label[i]]
            if not len(some):
                continue
            flat = mine[np.concatenate([number[begin[j] : begin[j + 1]] for j in some])]
            common = np.add.reduceat(flat, np.cumsum(np.append(0, size[some][:-1])), dtype=np.int64)
            for j in some[100 * common >= percent * (n + size[some] - common)]:
                if label[j] != label[i]:
                    yield i, int(j)
                    label[label == label[j]] = label[i]
        mine[own] = False


def _rest(members: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between nodes of one ``key`` and different ``root``s, as many as it takes to join all that are similar.

    A key's nodes are cut into tiles by hash, and every two tiles meet in a cell of their own.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("held"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    tiles = F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("held") / TILE_SHINGLES)).cast("int")
    open_ = stored(sizes.filter("lo <> hi").select("key", "n", tiles.alias("tiles")))
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("tiles")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1),
        lambda u: F.struct(
            (F.least(u, own).cast("long") * F.col("tiles") + F.greatest(u, own)).alias("cell"),
            F.when(u == own, F.lit(-1)).otherwise(own).alias("deal"),
        ),
    )
    dealt = joined_by_count(members.select("key", "node", "root"), open_, ["key"]).select("key", "node", "root", F.explode(cells).alias("c"))
    held = nodes.select("node", "sig").join(sets, "node")
    rows = dealt.select("key", "node", "root", "c.cell", "c.deal").join(held, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs((s for b in batches for s in slices(b, 512)), ["key", "cell"], 512):
            key, cell, deal = (group.column(c).to_numpy() for c in ("key", "cell", "deal"))
            node = group.column("node").combine_chunks()
            root = group.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
            sig = _signatures(group.column("sig"))
            shingles = group.column("shingles").combine_chunks()
            values, begin = shingles.values.to_numpy(), shingles.offsets.to_numpy().astype(np.int64)
            cut = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
            a, b = [], []
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True):
                inside = values[begin[lo] : begin[hi]]
                for i, j in joining(sig[lo:hi], root[lo:hi], deal[lo:hi], inside, begin[lo : hi + 1] - begin[lo], percent):
                    a.append(lo + i)
                    b.append(lo + j)
            yield pa.RecordBatch.from_arrays([node.take(pa.array(a, pa.int64())), node.take(pa.array(b, pa.int64()))], ["a", "b"])

    return rows.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(run, "a binary, b binary")


def links(docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Links ``a``, ``b`` that connect all ``nodes`` (``node``, ``row``, ``size``, ``sig``) of such similarity that share a key."""
    keyed = _keyed(nodes)
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    members = stored(joined_by_count(keyed, shared, ["key"]))
    # many keys have the same nodes: one of them will do
    whole = members.groupBy("key").agg(
        F.min(F.struct("node", "size")).alias("first"),
        F.max("n").alias("n"),
        F.bit_xor(F.xxhash64("node")).alias("h"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("g"),
    )
    chosen = stored(whole.groupBy("n", "h", "g").agg(F.min("key").alias("key"), F.min("first").alias("first")).select("key", "n", "first"))
    members = stored(joined_by_count(members.drop("n"), chosen, ["key"]))
    sets = stored(_sets(docs, nodes.join(members.select("node").distinct(), "node", "left_semi"), words))
    pairs = members.filter(F.col("node") != F.col("first.node")).filter(_alike(F.col("size"), F.col("first.size"), percent))
    found = stored(_confirmed(pairs.select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct(), nodes, sets, percent))
    rooted = members.filter("n > 2").select("key", "node", "size").join(components(found), "node", "left")
    rooted = stored(rooted.select("key", "node", "size", F.coalesce("root", "node").alias("root")))
    return found.unionByName(_rest(rooted, nodes, sets, percent))


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for each row of ``docs``.

    A document's set is its distinct shingles of ``words`` words, or all its words where they are fewer. Documents are linked where
    100 * intersection >= percent * union; ``component_id`` is the smallest doc_id that links lead to. A null, empty or wordless
    text has no shingles and is alone. Repeated rows each get a row. A null doc_id has no say in a component's name; where
    nothing else is in it, the name is null. Columns other than doc_id and text are not looked at. No rows give no rows.
    """
    marked = stored(_sketched(docs, words))
    nodes = stored(
        marked.filter("size > 0").groupBy("node").agg(
            F.min("row").alias("row"), F.first("size").alias("size"), F.first("sig").alias("sig"), F.min("doc_id").alias("first"), F.count("*").alias("n")
        )
    )
    roots = components(links(docs, nodes, words, percent))
    named = nodes.select("node", "first", "n").join(roots, "node", "left").select("node", "first", "n", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_node = stored(named.join(least, "root").select("node", "n", "component_id"))
    whole = joined_by_count(marked.filter("size > 0").select("doc_id", "size", "node"), by_node, ["node"]).select("doc_id", "size", "component_id")
    alone = marked.filter("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id"))
    return whole.unionByName(alone).select(
        "doc_id", F.col("size").cast("long").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
