"""Suffix-array dedup: remove every byte that a repeated string of ``LENGTH`` bytes covers, report those of ``SHORT`` bytes.

Documents are UTF-8 bytes. A window is a string of SHORT bytes in one document; equal windows have the same anchor, the
smallest hash of their ``GRAM``-byte strings. Consecutive windows with one anchor form a segment, whose text goes on for
LENGTH bytes from the last window's start (or to the document's end), so that strings of both lengths are judged on it.

1. Segments with an anchor that no other place has can't repeat and go at once (a count, no text moves).
2. Segments equal as a whole are counted; all windows of a repeated one are repeated, and one of them stands for all.
3. The texts of the segments that are left meet by anchor in blocks. A block's window suffixes are put in order by two-stage
   sorting: only those smaller than their successors are sorted directly, the others are induced by scanning the
   buckets of first bytes. Adjacent common prefixes of SHORT and of LENGTH bytes or more mark what is repeated.
4. An anchor with more segments than ``BLOCK`` is dealt over several blocks; each names its distinct windows by
   digest, and a count of those joins the blocks. No task holds a whole anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgate.llm.common import joined_by_count, runs, slices, stored, utf8

LENGTH = 400
#: Passages of some fifty words are shorter than LENGTH as often as not; from here on they count as ``n_repeated``.
SHORT = 256
GRAM = 64
#: Windows of a segment, segments of an anchor that are sorted together (some 2 MB), bytes of a slice of a long text.
PIECE = 512
BLOCK = 4096
SLICE = 1 << 19
_RNG = np.random.default_rng(97)
_VALUE = _RNG.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, SLICE + LENGTH), _powers(_INVERSE, SLICE + LENGTH)


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every ``gram`` bytes in a row: a polynomial's running sums, shifted to the front and mixed."""
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * _UP[: len(raw)], out=total[1:])
    h = (total[gram:] - total[:-gram]) * _DOWN[: len(raw) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :])


def _sliding_most(x: np.ndarray, width: int) -> np.ndarray:
    """For each i the largest of x[i - width + 1 : i + 1], as far as there are any."""
    return ~_sliding_least(~np.concatenate((np.zeros(width - 1, x.dtype), x)), width)


def segment_arrays(raw: bytes, length: int = SHORT, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors, first windows, numbers of windows and places of the anchor in them, of the segments of a text.

    A long text is taken in slices that overlap so that every window is in one.
    """
    reach = length - gram
    for at in range(0, max(1, len(raw) - length + 1), SLICE):
        part = np.frombuffer(raw, np.uint8)[at : at + SLICE + length - 1]
        if len(part) < length:
            return
        h = _gram_hashes(part, gram)
        least = _sliding_least(h, reach + 1)
        cut = np.flatnonzero(least[1:] != least[:-1]) + 1
        edge = np.concatenate(([0], cut, [len(least)]))
        if np.diff(edge).max() > PIECE:
            edge = np.unique(np.concatenate([edge, *(np.arange(a, b, PIECE) for a, b in zip(edge[:-1], edge[1:], strict=True) if b - a > PIECE)]))
        anchor = least[edge[:-1]]
        # a gram is an anchor if a window over it has no smaller one; it has a place in each of that anchor's segments over it
        most = _sliding_most(np.concatenate((least, np.zeros(reach, np.uint64))), reach + 1)
        place = np.flatnonzero(most == h)
        first = np.searchsorted(edge, np.maximum(place - reach, 0), "right") - 1
        last = np.searchsorted(edge, np.minimum(place, len(least) - 1), "right") - 1
        places = np.zeros(len(anchor), np.int64)
        for k in range(int((last - first).max(initial=0)) + 1):
            over = first + k
            own = over <= last
            own[own] = anchor[over[own]] == h[place[own]]
            places += np.bincount(over[own], minlength=len(anchor))
        yield anchor.view(np.int64), edge[:-1] + at, np.diff(edge), places


def segments(raw: bytes, length: int = SHORT, gram: int = GRAM) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, first window, windows, places of the anchor in the segment) over a whole text."""
    for columns in segment_arrays(raw, length, gram):
        yield from zip(*(c.tolist() for c in columns), strict=True)


# --- two-stage sorting ---------------------------------------------------------------------------------------------


def suffix_order(text: bytes, ends: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions ``wanted`` in the order of their suffixes, each up to the end of its own segment.

    ``ends`` are the segments' ends, ascending and covering the text; a segment's end is smaller than any byte. Suffixes
    smaller than their successors (or last of a segment's run of equals) are sorted directly; a larger one's place
    in the bucket of its first byte follows from its successor's rank.
    """
    n = len(text)
    raw = np.frombuffer(text, np.uint8).astype(np.int16)
    nxt = np.empty(n, np.int16)
    nxt[:-1] = raw[1:]
    nxt[ends - 1] = -1
    # smaller than the successor: by the next unequal byte to the right
    at = np.arange(n, dtype=np.int32)
    turn = np.minimum.accumulate(np.where(raw != nxt, at, np.int32(n))[::-1])[::-1]
    small = raw[turn] < nxt[turn]
    del turn
    # each wanted suffix needs its successors up to the first small one
    stop = np.minimum.accumulate(np.where(small, at, np.int32(n))[::-1])[::-1]
    end_of = np.repeat(ends, np.diff(ends, prepend=0)).astype(np.int32)
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, wanted, 1)
    np.add.at(depth, np.minimum(stop[wanted], end_of[wanted] - 1) + 1, -1)
    needed = np.cumsum(depth)[:-1] > 0
    del stop, depth, at
    direct = np.flatnonzero(needed & small)
    finish = end_of[direct].tolist()
    keys = [text[i:e] for i, e in zip(direct.tolist(), finish, strict=True)]
    ordered = direct[np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)] if len(keys) else direct
    del keys, finish, end_of
    rank = np.full(n + 1, -1, np.int32)  # of what has its place; the end of a segment is before all
    large = np.flatnonzero(needed & ~small)
    follows = np.where(nxt[large] < 0, n, large + 1)
    by_byte = np.argsort(raw[large], kind="stable")
    large, follows = large[by_byte], follows[by_byte]
    bounds = np.searchsorted(raw[large], np.arange(257))
    small_bounds = np.searchsorted(raw[ordered], np.arange(257))
    out, at = [], 0
    for c in range(256):
        own, after = large[bounds[c] : bounds[c + 1]], follows[bounds[c] : bounds[c + 1]]
        while len(own):  # successors in smaller buckets first, then those in this bucket that got their place
            ready = (rank[after] >= 0) | (after == n)
            placed = own[ready][np.argsort(rank[after[ready]], kind="stable")]
            rank[placed] = np.arange(at, at + len(placed))
            at += len(placed)
            out.append(placed)
            own, after = own[~ready], after[~ready]
        last = ordered[small_bounds[c] : small_bounds[c + 1]]
        rank[last] = np.arange(at, at + len(last))
        at += len(last)
        out.append(last)
    order = np.concatenate(out)
    keep = np.zeros(n, bool)
    keep[wanted] = True
    return order[keep[order]]


def common_prefixes(text: bytes, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, ``most`` at the most, of each suffix in ``order`` and the one before it (0 for the first)."""
    words = np.ndarray(len(text) + 1, np.uint64, text + bytes(8), strides=(1,))
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    a, b = order[1:].copy(), order[:-1].copy()
    for _ in range(0, most, 8):
        differ = words[np.minimum(a, len(text))] ^ words[np.minimum(b, len(text))]
        whole = differ == 0
        if not whole.all():
            odd = differ[~whole]
            out[live[~whole]] += np.bitwise_count((odd & (~odd + np.uint64(1))) - np.uint64(1)) // 8
            live, a, b = live[whole], a[whole], b[whole]
        out[live] += 8
        a += 8
        b += 8
    return np.minimum(out, most)


def repeated_windows(
    parts: list[bytes], windows: list[int], lengths: tuple[int, ...] = (SHORT, LENGTH)
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For the first ``windows[i]`` positions of each part: part, position, and for each of the ``lengths`` a class.

    Positions whose next so many bytes are equal share a class; it is -1 where the part has fewer bytes left.
    """
    text = b"".join(parts)
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    counts = np.array(windows, np.int64)
    part = np.repeat(np.arange(len(parts)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    wanted = (ends - sizes)[part] + within
    order = suffix_order(text, ends, wanted)
    prefix = common_prefixes(text, order, max(lengths))
    left = np.zeros(len(text), np.int64)
    left[wanted] = sizes[part] - within
    room = left[order]
    prefix[1:] = np.minimum(prefix[1:], np.minimum(room[1:], room[:-1]))
    place = np.empty(len(text), np.int64)
    classes = []
    for length in lengths:
        place[order] = np.cumsum(prefix < length)
        classes.append(np.where(left[wanted] >= length, place[wanted], -1))
    return part, within, classes


# --- Spark ---------------------------------------------------------------------------------------------------------

_KEY = ["d", "t"]


def _keyed(docs: DataFrame) -> DataFrame:
    """d and t name a document; rows with one doc_id and one text are the same in all that follows."""
    doc_id = F.col("doc_id").cast("long")
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-(2**63)).cast("long")).alias("d"), F.xxhash64(text).alias("t"), text.alias("text")
    )


def _segment_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        names = ["d", "t", "anchor", "digest", "start", "windows", "places"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]

        def batch_of(held: list[list]) -> pa.RecordBatch:
            columns = [np.concatenate(c) if c else [] for c in held]
            columns[3] = [x for part in held[3] for x in part]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in (x for b in batches for x in slices(b)):
            held: list[list] = [[] for _ in names]
            n = 0
            for d, t, raw in zip(batch.column("d").to_pylist(), batch.column("t").to_pylist(), utf8(batch.column("text")), strict=True):
                for anchor, start, windows, places in segment_arrays(raw):
                    ends = (start + windows + LENGTH - 1).tolist()
                    texts = [digest(raw[a:b]) for a, b in zip(start.tolist(), ends, strict=True)]
                    who = np.full(len(anchor), d), np.full(len(anchor), t)
                    for column, x in zip(held, (*who, anchor, texts, start, windows, places), strict=True):
                        column.append(x)
                    n += len(anchor)
                if n > 50_000:
                    yield batch_of(held)
                    held, n = [[] for _ in names], 0
            yield batch_of(held)

    schema = "d long, t long, anchor long, digest binary, start int, windows int, places int"
    return docs.select("d", "t", "text").mapInArrow(run, schema)


def _candidates(rows: DataFrame) -> DataFrame:
    """Segments that may have repeated windows, with what is known of each.

    ``all_repeated``: another segment is equal as a whole; ``ships``: its text is needed; ``blocks``: over how many blocks its anchor is dealt.
    """
    equal = rows.groupBy("anchor", "digest").agg(
        F.count("*").alias("n"), F.sum("places").alias("places"), F.min(F.struct("d", "t", "start")).alias("one")
    )
    equal = stored(equal)
    anchors = equal.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("places").alias("total")).filter("total > 1")
    classes = equal.join(anchors, "anchor").select("anchor", "digest", "n", "one", "kinds", F.col("places") > F.col("n"))
    classes = classes.toDF("anchor", "digest", "n", "one", "kinds", "own_repeats")
    alone = (F.col("kinds") == 1) & ~F.col("own_repeats")
    classes = stored(classes.withColumn("blocks", F.when(alone, 0).otherwise(F.ceil(F.col("kinds") / BLOCK)).cast("int")))
    me = F.struct("d", "t", "start")
    return joined_by_count(rows, classes, ["anchor", "digest"]).select(
        "d",
        "t",
        "start",
        "windows",
        "anchor",
        "blocks",
        (F.col("n") > 1).alias("all_repeated"),
        ((F.col("blocks") > 0) & (me == F.col("one"))).alias("ships"),
    )


def _with_texts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Each document with its candidate segments (null if it has none)."""
    fields = F.struct("start", "windows", "anchor", "blocks", "all_repeated", "ships")
    lists = known.groupBy(*_KEY).agg(F.collect_set(fields).alias("known"))
    return docs.join(lists, _KEY, "left")


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated strings of ``length`` bytes of undecided segments (start, end of their runs; no anchor), and, of anchors dealt over
    several blocks, a row for each distinct one, ``open`` if it isn't known to be repeated and may match another block's."""
    names = ["d", "t", "start", "end", "length", "anchor", "digest", "open"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.bool_()]
    for table in runs((x for b in batches for x in slices(b, 512)), ["anchor", "block"], 1024):
        parts = utf8(table.column("piece").combine_chunks()) if table.num_rows else []
        windows = table.column("windows").to_numpy()
        start = table.column("start").to_numpy()
        d, t, anchor = (table.column(c).to_numpy() for c in ("d", "t", "anchor"))
        decided = table.column("all_repeated").to_numpy()
        many = table.column("blocks").to_numpy() > 1
        part, within, classes = repeated_windows(parts, windows.tolist())
        rows: list[tuple] = []
        for length, kind in zip((SHORT, LENGTH), classes, strict=True):
            whole = np.flatnonzero(kind >= 0)
            count = np.bincount(kind[whole], minlength=1)
            # what stands in a segment that is repeated as a whole is repeated wherever else it stands
            sure = np.bincount(kind[whole], weights=decided[part[whole]], minlength=len(count)) > 0
            twice = (count > 1) | sure
            mine = whole[twice[kind[whole]] & ~decided[part[whole]]]
            if len(mine):
                cut = np.flatnonzero((np.diff(part[mine]) != 0) | (np.diff(within[mine]) != 1)) + 1
                edge = np.concatenate(([0], cut, [len(mine)]))
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    p = int(part[mine[a]])
                    s = int(start[p] + within[mine[a]])
                    rows.append((int(d[p]), int(t[p]), s, s + b - a - 1 + length, length, None, None, None))
            if many.any() and len(whole):
                _, first = np.unique(kind[whole], return_index=True)
                first = whole[first]
                for i in first[many[part[first]]].tolist():
                    p, w = int(part[i]), int(within[i])
                    digest = xxhash.xxh3_128_digest(parts[p][w : w + length])
                    rows.append((int(d[p]), int(t[p]), int(start[p]) + w, 0, length, int(anchor[p]), digest, not bool(twice[kind[i]])))
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, types, strict=True)], names)


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def removed(docs: DataFrame) -> DataFrame:
    """What is removed of each row of ``docs``.

    ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256``, ``n_repeated`` (bytes covered by
    repeated strings of SHORT bytes, removed or not), ``spans`` (removed: start, end in bytes). Null and short texts lose
    nothing. Repeated rows are repeats of each other, so each loses all that is LENGTH bytes long. No rows give no rows.
    Segments and documents are told apart by 128 and 64 bit digests.
    """
    keyed = _keyed(docs)
    rows = stored(_segment_rows(keyed))
    known = stored(_candidates(rows))
    texts = stored(_open_texts(_with_texts(keyed, known)))
    pieces = texts.filter("ships is not null").select("d", "t", F.explode("ships").alias("s")).select("d", "t", "s.*")
    block = F.pmod(F.xxhash64("d", "t", "start"), F.col("blocks"))
    pieces = pieces.withColumn("block", block).repartition("anchor", "block").sortWithinPartitions("anchor", "block", "d", "t", "start")
    found = stored(
        pieces.mapInArrow(_block_rows, "d long, t long, start int, end int, length int, anchor long, digest binary, open boolean")
    )
    named = found.filter("anchor is not null")
    across = named.groupBy("anchor", "digest").agg(F.count("*").alias("n")).filter("n > 1")
    more = named.filter("open").join(across, ["anchor", "digest"]).select("d", "t", "start", (F.col("start") + F.col("length")).alias("end"), "length")
    # open windows of one block's class are single there; a class with members in other blocks is repeated
    spans = found.filter("anchor is null").select("d", "t", "start", "end", "length").unionByName(more)
    lists = spans.groupBy(*_KEY).agg(F.collect_set(F.struct("start", "end", "length")).alias("more"))
    span = "array<struct<start:int,end:int>>"
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, spans {span}"
    undecided = texts.filter("text is not null").select("doc_id", "d", "t", "text", "spans", "short")
    finished = undecided.join(lists, _KEY, "left").select("doc_id", "text", "spans", "short", "more").mapInArrow(_finish, schema)
    decided = texts.filter("text is null").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "spans")
    return decided.unionByName(finished)


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_SHIP = pa.list_(
    pa.struct([("start", pa.int32()), ("windows", pa.int32()), ("anchor", pa.int64()), ("blocks", pa.int32()), ("all_repeated", pa.bool_()), ("piece", pa.binary())])
)


def _result(raw: bytes, spans: list[list[int]], short: list[list[int]]) -> tuple:
    keep, at = hashlib.sha256(), 0
    for s, e in spans:
        keep.update(raw[at:s])
        at = e
    keep.update(raw[at:])
    removed_, repeated = (sum(e - s for s, e in x) for x in (spans, short))
    return len(raw), removed_, len(spans), keep.hexdigest(), repeated, _listed(spans)


def _listed(spans: list[list[int]]) -> list[dict]:
    return [{"start": s, "end": e} for s, e in spans]


def _open_texts(docs: DataFrame) -> DataFrame:
    """Finish documents whose segments are all decided; keep the text of the others and cut out what is shipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "d", "t", "text", "spans", "short", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "ships"]
        number = pa.int64()
        types = [number, number, number, pa.string(), _SPAN, _SPAN, number, number, number, pa.string(), number, _SHIP]
        for batch in (x for b in batches for x in slices(b)):
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "d", "t", "known"))
            for doc_id, d, t, known, raw in zip(*columns, utf8(batch.column("text")), strict=True):
                known = known or []
                whole = [(k["start"], k["start"] + k["windows"] - 1) for k in known if k["all_repeated"]]
                short = _merged([(a, b + SHORT) for a, b in whole])
                spans = _merged([(a, min(b, len(raw) - LENGTH) + LENGTH) for a, b in whole if a + LENGTH <= len(raw)])
                ships = [
                    {x: k[x] for x in ("start", "windows", "anchor", "blocks", "all_repeated")}
                    | {"piece": raw[k["start"] : k["start"] + k["windows"] + LENGTH - 1]}
                    for k in known
                    if k["ships"]
                ] or None
                if any(not k["all_repeated"] for k in known):
                    rows.append((doc_id, d, t, raw.decode(), _listed(spans), _listed(short), *[None] * 5, ships))
                else:
                    *totals, listed = _result(raw, spans, short)
                    rows.append((doc_id, d, t, None, listed, None, *totals, ships))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, types, strict=True)], names)

    span, ship = "array<struct<start:int,end:int>>", "array<struct<start:int,windows:int,anchor:long,blocks:int,all_repeated:boolean,piece:binary>>"
    totals = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long"
    return docs.select("doc_id", "d", "t", "text", "known").mapInArrow(
        run, f"doc_id long, d long, t long, text string, spans {span}, short {span}, {totals}, ships {ship}"
    )


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "spans"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), _SPAN]
    for batch in (x for b in batches for x in slices(b)):
        rows = []
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "spans", "short", "more"))
        for doc_id, spans, short, more, raw in zip(*columns, utf8(batch.column("text")), strict=True):
            more = more or []
            merged = [
                _merged([(s["start"], s["end"]) for s in [*known, *(x for x in more if x["length"] == length)]])
                for known, length in ((spans, LENGTH), (short, SHORT))
            ]
            rows.append((doc_id, *_result(raw, *merged)))
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, types, strict=True)], names)
