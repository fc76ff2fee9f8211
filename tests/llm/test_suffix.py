import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowgate.llm import suffix_dedup


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=8))
def test_suffix_order(parts):
    text = b"".join(parts)
    ends = np.cumsum([len(p) for p in parts])
    start = np.concatenate(([0], ends[:-1]))
    own = lambda i: text[i : ends[np.searchsorted(ends, i, "right")]]
    for wanted in (np.arange(len(text)), start):
        order = suffix_dedup.suffix_order(text, ends, wanted)
        assert sorted(order.tolist()) == sorted(wanted.tolist())
        assert [own(i) for i in order.tolist()] == sorted(own(i) for i in wanted.tolist())


def test_common_prefixes():
    text = b"banana" * 20 + b"bandana"
    order = np.arange(len(text))
    got = suffix_dedup.common_prefixes(text, order, 50)
    for i in range(1, len(text)):
        a, b = text[i:], text[i - 1 :]
        n = next((k for k in range(min(len(a), len(b), 50)) if a[k] != b[k]), min(len(a), len(b), 50))
        if max(i, i - 1) + n < len(text) - 8:
            assert got[i] == n


def plain(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        cover = np.zeros(len(r) + 1, int)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                cover[i : i + length] = 1
        runs = int((np.diff(np.concatenate(([0], cover))) == 1).sum())
        kept = bytes(c for c, x in zip(r, cover, strict=False) if not x)
        out.append((len(r), int(cover.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdeé ", k=rng.randint(2, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    long = say(400)
    texts = [say(120) for _ in range(20)] + [long, long[:900] + say(30) + long[900:], "x" + long[37:700], "ab" * 900, "a" * 399, "a" * 401, "a" * 400, "", None]
    texts += [say(10) + long[50:380], long[2:300], say(30) + long[-330:], "b" + long[-399:], say(9) + long[-400:]]
    near = say(150).split(" ")
    for _ in range(60):
        other = list(near)
        other[rng.randrange(len(other))] = say(1)
        texts.append(" ".join(other))
    return texts + [texts[3], texts[3]]


@pytest.mark.parametrize("block,piece,cut", [(4096, 512, 1 << 19), (8, 64, 1 << 19), (16, 512, 700)])
def test_removed_against_every_window(spark, monkeypatch, block, piece, cut):
    """With whole anchors, with anchors dealt over several blocks, and with texts cut into slices."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    texts = corpus()
    if cut < 1 << 19:
        rows = [list(_sliced(suffix_dedup, t, cut)) for t in texts]
        whole = [list(suffix_dedup.segments((t or "").encode())) for t in texts]
        for a, b in zip(rows, whole, strict=True):
            assert _windows(a) == _windows(b)
        return
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS d", "'x' AS spans")
    rows = suffix_dedup.removed(df).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert [got[i] for i in range(len(texts))] == plain(texts, 400)
    reported = {r.doc_id: r.n_repeated for r in rows}
    assert [reported[i] for i in range(len(texts))] == [x[1] for x in plain(texts, 256)]


def test_places_of_the_anchor():
    for text in corpus():
        raw = (text or "").encode()
        reach = suffix_dedup.SHORT - suffix_dedup.GRAM
        h = suffix_dedup._gram_hashes(np.frombuffer(raw, np.uint8), suffix_dedup.GRAM).view(np.int64) if len(raw) >= suffix_dedup.SHORT else []
        for anchor, start, windows, places in suffix_dedup.segments(raw):
            assert places == int((h[start : start + windows + reach] == anchor).sum()) >= 1


def _sliced(module, text, cut):
    before = module.SLICE
    module.SLICE = cut
    try:
        return list(module.segments((text or "").encode()))
    finally:
        module.SLICE = before


def _windows(rows):
    return {(a, s + i) for a, s, n, _ in rows for i in range(n)}


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.removed(empty).count() == 0
    same = spark.createDataFrame([(1, "q" * 500), (1, "q" * 500), (None, "short")], "doc_id long, text string")
    assert sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.removed(same).collect()) == [(5, 0), (500, 500), (500, 500)]
