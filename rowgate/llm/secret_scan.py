"""Secret scans: base patterns over whole texts, and over every layer that decoding uncovers.

A worklist unwraps percent-encoded, Unicode-escaped, base64 (also wrapped in lines, also of UTF-16) and compressed stretches
(gzip, zlib, deflate without a head) of a text, rescans what comes out, and the text with the decoded stretches in their places, and unwraps that again, until
nothing new appears. A layer that lies within itself (a cycle) isn't taken up again; what a layer holds is
remembered, so that one that comes up in several places counts in each of them. A secret found in a layer
gets the span of the stretch of the original text that it came from. Layers beyond ``EXPANSION`` are
inflated and scanned in windows that are cut between lines, and in overlapping ones where no line ends.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""([pP][aA][sS][sS](?:[wW][oO][rR][dD]|[wW][dD])|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
# from the start of a run of plain characters, so that a long one is walked once
_PERCENT = re.compile(r"(?<![A-Za-z0-9_.~+/=:-])[A-Za-z0-9_.~+/=:-]*+(?:%[0-9A-Fa-f]{2}[A-Za-z0-9_.~+/=:-]*+)+")
_ESCAPED = re.compile(r"(?<![!-\[\]-~])[!-\[\]-~]*+(?:\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2})[!-\[\]-~]*+)+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+[\x20\t]*+\r?\n[\x20\t]*+)+[A-Za-z0-9+/_-]++={0,2}")
_LINE_END = re.compile(r"[A-Za-z0-9+/_-]{16}[\x20\t]*\r?$")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2}))")
#: What a run that isn't cut where base64 starts must show to be taken for text behind other letters.
_PLAIN = re.compile(rb"[\x20-\x7e]{12}")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
_LETTERS = re.compile(rb"[\t\n\r\x20-\x7e]+")
_JOINT = re.compile(r"[+/_-]")
#: Kind of a stretch of which something may be unseen.
_CUT = len(KINDS)
#: Characters of a layer that are held at once. ``truncated`` is true where a layer beyond it has a line so long
#: that an encoded stretch may not fit one window.
EXPANSION = 16 << 20


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _key(data: bytes | str) -> bytes:
    raw = data.encode("utf-8", "surrogatepass") if isinstance(data, str) else data
    return hashlib.blake2b(raw, digest_size=16).digest()


def _utf16(data: bytes) -> str | None:
    """The kind of UTF-16 that ``data`` starts as: by its mark, or as most of its letters have a zero byte on the same side."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    head = data[:256]
    if len(head) >= 16:
        pairs = len(head) // 2
        for odd, name in ((1, "utf-16-le"), (0, "utf-16-be")):
            if head[odd::2].count(0) >= 0.8 * pairs and head[1 - odd :: 2].count(0) <= 0.1 * pairs:
                return name
    return None


def _readable(data: bytes) -> str | None:
    try:
        text = data.decode(_utf16(data) or "utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and not _CONTROL.search(text) else None


def _format(data: bytes) -> int:
    """How zlib is to read what starts here: 47 for gzip and zlib data, -15 for deflated data without a head, 0 for anything else.

    The first are told by head and first byte, the last by 32 plain characters that come out, or by 8 that are all there is.
    """
    if data[:2] == b"\x1f\x8b" or (len(data) > 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0):
        try:
            unpack = zlib.decompressobj(47)
            if unpack.decompress(data, 1) or unpack.eof:
                return 47
        except zlib.error:
            pass
    if len(data) > 8 and not _LETTERS.fullmatch(data[:64]):
        try:
            unpack = zlib.decompressobj(-15)
            out = unpack.decompress(data[:4096], 32)
        except zlib.error:
            return 0
        if (len(out) == 32 or (unpack.eof and len(out) >= 8)) and _LETTERS.fullmatch(out):
            return -15
    return 0


def _compressed(data: bytes) -> bool:
    return _format(data) != 0


def _inflated(chunks: Iterator[bytes], kind: int = 47) -> Iterator[bytes]:
    """What all members come to, in pieces; of damaged data what comes before the damage. Other data behind it follows as it is."""
    unpack, data = zlib.decompressobj(kind), b""
    while True:
        data = data or next(chunks, b"")
        if not data:
            return
        try:
            out = unpack.decompress(data, 1 << 20)
        except zlib.error:
            return
        data = unpack.unconsumed_tail
        if out:
            yield out
        while not unpack.eof and not data and len(out) == 1 << 20:  # what the decompressor still holds
            out = unpack.decompress(b"", 1 << 20)
            data = unpack.unconsumed_tail
            if out:
                yield out
        if unpack.eof:
            data = unpack.unused_data.lstrip(b"\0")
            while len(data) < 64 and (more := next(chunks, b"")):
                data = (data + more).lstrip(b"\0")
            if not (kind := _format(data)):
                if data:
                    yield data
                yield from chunks
                return
            unpack = zlib.decompressobj(kind)


def _pieces(data: bytes) -> Iterator[bytes]:
    for at in range(0, len(data), 65_536):
        yield data[at : at + 65_536]


def _head(chunks: Iterator[bytes]) -> tuple[bytes, bool]:
    """The first ``EXPANSION`` bytes or more, and whether that is all."""
    held, n = [], 0
    for piece in chunks:
        held.append(piece)
        n += len(piece)
        if n > EXPANSION:
            return b"".join(held), False
    return b"".join(held), True


def _opened(data: bytes) -> Iterator[bytes]:
    """``data`` without all its compressions; nothing if it comes back to what it was."""
    chunks: Iterator[bytes] = iter((data,))
    seen = set()
    while True:
        data, whole = _head(chunks)
        if not (kind := _format(data)):
            return chain((data,), chunks)
        key = _key(data) + (b"" if whole else b"+")
        if key in seen:
            return iter(())
        seen.add(key)
        chunks = _inflated(chain(_pieces(data), () if whole else chunks), kind)


def _windows(chunks: Iterator[bytes]) -> Iterator[tuple[str, bool]]:
    """The text of ``chunks``, whole or in windows, and whether a stretch may not fit the window."""
    first = next(chunks, b"")
    decoder = codecs.getincrementaldecoder(_utf16(first) or "utf-8")("replace")
    held, n = [], 0
    for piece in chain((first,), chunks):
        held.append(decoder.decode(piece))
        n += len(held[-1])
        if n <= EXPANSION:
            continue
        text = "".join(held)
        at = text.rfind("\n", EXPANSION // 2)
        while at > 0 and _LINE_END.search(text, max(0, at - 64), at):  # base64 may go on in the next line
            at = text.rfind("\n", EXPANSION // 2, at)
        if at > 0:
            yield text[: at + 1], False
            held = [text[at + 1 :]]
        else:
            yield text, True
            held = [text[-(EXPANSION // 2) :]]
        n = len(held[0])
    held.append(decoder.decode(b"", True))
    if text := "".join(held):
        yield text, False


def _unpercent(s: str) -> bytes:
    return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), s.encode("utf-8", "surrogatepass"))


def _unescape(s: str) -> bytes:
    out = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)), s)
    raw = out.encode("latin-1", "replace")
    if _compressed(raw):
        return raw
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode()


def _unbase64(s: str) -> bytes:
    """A last letter too much, of a word behind it, is left out."""
    body = s.rstrip("=").replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _unbase64_run(s: str) -> Iterator[bytes]:
    """What a run comes to; where that is no text, also what it comes to when its base64 starts further on, as behind a path."""
    data = _unbase64(s)
    yield data
    if _compressed(data) or _readable(data) is not None:
        return
    for k in (1, 2, 3):
        data = _unbase64(s[k:])
        if _PLAIN.search(data):
            yield data
    for m in _JOINT.finditer(s):
        if _compressed(_unbase64(s[m.end() : m.end() + 64])):
            yield _unbase64(s[m.end() :])


def _stretches(text: str) -> Iterator[tuple[int, int, bytes]]:
    """Stretches of ``text`` that decode: start, end, what comes out."""
    if "%" in text:
        for m in _PERCENT.finditer(text):
            yield m.start(), m.end(), _unpercent(m[0])
    if "\\" in text:
        for m in _ESCAPED.finditer(text):
            yield m.start(), m.end(), _unescape(m[0])
    if "\n" in text:
        for m in _WRAPPED.finditer(text):
            yield m.start(), m.end(), _unbase64("".join(m[0].split()))
    for m in _BASE64.finditer(text):
        for data in _unbase64_run(m[0]):
            yield m.start(), m.end(), data


class _Place:
    """Where a text's positions lie in the original: pieces (own start, own end, start, end) of the text before."""

    def __init__(self, before: _Place | None, pieces: list[tuple[int, int, int, int]]) -> None:
        self.before, self.pieces = before, pieces
        self.starts = [p[0] for p in pieces]

    def of(self, start: int, end: int) -> tuple[int, int]:
        place: _Place | None = self
        while place is not None:
            start, end = place._one(start, False), place._one(end, True)
            place = place.before
        return start, end

    def _one(self, at: int, is_end: bool) -> int:
        k = (bisect_left if is_end else bisect_right)(self.starts, at) - 1
        if k < 0:
            return at
        own, own_end, start, end = self.pieces[k]
        if at > own_end or (at == own_end and not is_end):
            return at - own_end + end
        return end if is_end else start


def _substituted(text: str, pieces: list[tuple[int, int, str]]) -> tuple[str, list[tuple[int, int, int, int]]] | None:
    """``text`` with the decoded pieces in their places, and where these stand in it; None if that is one piece alone."""
    out, mapped, at, length = [], [], 0, 0
    for start, end, plain in sorted(pieces, key=lambda p: (p[0], -p[1])):
        if start < at:
            continue
        out += (text[at:start], plain)
        length += start - at + len(plain)
        mapped.append((length - len(plain), length, start, end))
        at = end
    if not mapped or mapped[0][2:] == (0, len(text)):
        return None
    return "".join(out) + text[at:], mapped


def _kinds(text: str) -> set[int]:
    return {kind for _, kind, _ in base_spans(text)}


#: A layer on the worklist: what it shows at once, its key, and the layers in it, made when they are asked for.
_Child = tuple[set[int], bytes, Iterator]


def _texts(data: bytes) -> Iterator[_Child]:
    """The text of decoded data, inflated as often as it takes."""
    for window, cut in _windows(_opened(data)):
        yield _kinds(window) | ({_CUT} if cut else set()), b"t" + _key(window), _within(window)


def _within(text: str) -> Iterator[_Child]:
    """What the stretches of a layer's text come to, then that text with the readable ones in their places."""
    pieces = []
    for start, end, data in _stretches(text):
        yield set(), b"d" + _key(data), _texts(data)
        if (plain := _readable(data)) is not None and plain != text[start:end]:
            pieces.append((start, end, plain))
    if changed := _substituted(text, pieces):
        yield _kinds(changed[0]), b"t" + _key(changed[0]), _within(changed[0])


class _Layer:
    def __init__(self, key: bytes, children: Iterator[_Child]) -> None:
        self.key, self.children = key, children
        self.kinds: set[int] = set()
        self.back: float = math.inf  # depth of the highest layer around it that came up again within it


def _below(data: bytes, known: dict[bytes, frozenset[int]]) -> frozenset[int]:
    """The kinds in ``data`` and in all that it unwraps to; ``known`` has those of layers that are done."""
    first = b"d" + _key(data)
    if first in known:
        return known[first]
    # the innermost layer first, each text read when its turn comes, so that few windows are held
    work, depth = [_Layer(first, _texts(data))], {first: 0}
    while True:
        layer = work[-1]
        child = next(layer.children, None)
        if child is not None:
            kinds, key, children = child
            layer.kinds |= kinds
            if key in known:
                layer.kinds |= known[key]
            elif key in depth:
                layer.back = min(layer.back, depth[key])
            else:
                depth[key] = len(work)
                work.append(_Layer(key, children))
            continue
        work.pop()
        del depth[layer.key]
        found = frozenset(layer.kinds)
        if layer.back >= len(work):  # else it lacks what a layer around it has
            known[layer.key] = found
        if not work:
            return found
        work[-1].kinds |= found
        if layer.back < len(work):
            work[-1].back = min(work[-1].back, layer.back)


def _scan(text: str) -> tuple[list[tuple[int, int, int]], set[tuple[int, int, int]], set[tuple[int, int]]]:
    """Base spans, all spans, and stretches of which something may be unseen."""
    base = base_spans(text)
    spans = set(base)
    cuts: set[tuple[int, int]] = set()
    known: dict[bytes, frozenset[int]] = {}
    place, seen = _Place(None, []), set()
    while (key := _key(text)) not in seen:
        seen.add(key)
        pieces = []
        for start, end, data in _stretches(text):
            at = place.of(start, end)
            for kind in _below(data, known):
                if kind == _CUT:
                    cuts.add(at)
                else:
                    spans.add((at[0], kind, at[1]))
            if (plain := _readable(data)) is not None and plain != text[start:end]:
                pieces.append((start, end, plain))
        changed = _substituted(text, pieces)
        if changed is None:
            break
        text, place = changed[0], _Place(place, changed[1])
        for start, kind, end in base_spans(text):
            at = place.of(start, end)
            spans.add((at[0], kind, at[1]))
    return base, spans, cuts


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], bool]:
    """Base spans, all spans (both (start, kind, end), sorted), and whether a stretch was too long for a window."""
    base, spans, cuts = _scan(text or "")
    return base, sorted(spans), bool(cuts)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``.

    ``doc_id``, ``n_assign``, ``n_access``, ``n_hex`` (spans of the base patterns), ``base_sha256``,
    ``spans`` (all, ``kind:start:end`` in code points, end exclusive), ``n_decoded``, ``truncated``. Null and empty texts
    have no spans. No rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                base, spans, truncated = scan(text)
                count = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((doc_id, *count, digest, joined(spans), len(spans) - len(base), truncated))
            names = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_decoded", "truncated")
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(names))

    schema = (
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long, truncated boolean"
    )
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def redact_text(text: str, mark: str = "[{kind}]") -> str:
    """``text`` with every span replaced by its kind's mark; overlapping spans become one mark.

    So are stretches too long for a window (``undecoded``), as something in them may be unseen.
    """
    kinds = (*KINDS, "undecoded")
    merged: list[list[int]] = []
    _, spans, cuts = _scan(text)
    for s, k, e in sorted(spans | {(s, len(KINDS), e) for s, e in cuts}):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(e, merged[-1][2])
        else:
            merged.append([s, k, e])
    out, at = [], 0
    for s, k, e in merged:
        out += (text[at:s], mark.format(kind=kinds[k]))
        at = e
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced by their kind and ``n_chars`` renewed; other columns and null texts as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            out = [x if x is None else redact_text(x) for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    clean = docs.mapInArrow(run, docs.schema)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean
