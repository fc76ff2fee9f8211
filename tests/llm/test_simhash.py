import re

import numpy as np
import pytest
import xxhash

from rowgate.llm import common, simhash
from rowgate.llm.graph import components


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("text", ["", None, "a", "A b", "a b a b a b a b", "ÉA b\x0bc\xa0d É e", "x " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def groups(pairs, n):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("words,radii", [(1, (3,)), (4, (20, 30, 44)), (1, (0,)), (1, (1, 2, 3))])
def test_links_connect_what_is_near(words, radii):
    rng = np.random.default_rng(1)
    for sizes in ([2, 3, 5, 64, 1, 63], [200, 2, 500, 64, 65]):
        edges = np.concatenate(([0], np.cumsum(sizes)))
        base = rng.integers(0, 2**63, (8, words), np.uint64)
        fps = base[rng.integers(0, 8, edges[-1])].copy()
        for r in range(len(fps)):
            for _ in range(rng.integers(0, 2 * radii[-1] + 2)):
                k = int(rng.integers(0, 64 * words))
                fps[r, k // 64] ^= np.uint64(1 << (k % 64))
        near = [
            (i, j)
            for a, b in zip(edges[:-1], edges[1:], strict=True)
            for i in range(a, b)
            for j in range(i + 1, b)
            if np.bitwise_count(fps[i] ^ fps[j]).sum() <= radii[-1]
        ]
        found = list(simhash.links_within(fps, edges, radii))
        assert groups(found, len(fps)) == groups(near, len(fps))
        assert len(found) == len(fps) - len(set(groups(near, len(fps))))  # a forest: no link too many


def test_components_of_fingerprints(spark):
    """Against every pair, with hot keys cut into tiles."""
    rng = np.random.default_rng(3)
    fps = np.unique(np.concatenate([rng.integers(0, 2**63, 40, np.uint64)] * 1))
    near = [int(f) ^ (1 << int(a)) ^ (1 << int(b)) for f in fps[:20] for a, b in rng.integers(0, 64, (6, 2))]
    values = sorted({int(np.uint64(x).view(np.int64)) for x in [*map(int, fps), *near]})
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    bits = np.array(values, np.int64).view(np.uint64)
    pairs = [(i, j) for i in range(len(bits)) for j in range(i + 1, len(bits)) if np.bitwise_count(bits[i] ^ bits[j]) <= 3]
    want = groups(pairs, len(bits))
    for tile in (4096, 2):
        roots = {r.node: r.root for r in components(simhash.links(df, 3, tile)).collect()}
        got = [roots.get(v, v) for v in values]
        assert [values[w] for w in want] == got


def test_near_duplicates_edge_cases(spark):
    got = simhash.near_duplicates(docs(spark, ["", None, "  ", "one two three four", "ONE two three four", "other words here now"]))
    named = {r.doc_id: (r.fp, r.component_id) for r in got.collect()}
    assert named[0] == named[1] == named[2] == (0, 0)
    assert named[3][1] == named[4][1] == 3 and named[5][1] == 5
    assert simhash.near_duplicates(docs(spark, []).limit(0)).count() == 0
    repeated = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "a b c")], "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS component_id")
    assert [r.component_id for r in simhash.near_duplicates(repeated).collect()] == [5, 5, 5]


def test_chain_is_one_component(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.root for r in components(df).collect()} == {0}
    assert components(df.limit(0)).count() == 0


def test_stage_keeps_one_of_a_group(spark):
    rng = np.random.default_rng(0)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 200)) for _ in range(12)]
    near = [t.replace(t.split()[50], "changed").replace(t.split()[120], "other") for t in base[:6]]
    far = [" ".join(t.split()[:110] + [f"z{x}" for x in rng.integers(0, 5000, 90)]) for t in base[6:9]]
    texts = base + near + far + [base[0], "", None]
    df = docs(spark, texts).selectExpr("doc_id", "text", "'en' AS lang", "1 AS node", "2 AS fp")
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [*range(12), *range(18, 21), 22]
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_stage_verifies_what_failed_links_hid(spark):
    """Against every pair: families just around the similarity, where a spanning forest of candidates fails."""
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(3):
        stem = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
        for _ in range(20):
            words = list(stem)
            at = int(rng.integers(0, 400 - 20))
            words[at : at + 20] = [f"z{x}" for x in rng.integers(0, 10**6, 20)]
            texts.append(" ".join(words))
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    bands = [set(enumerate(simhash.wide_sketch(t.encode(), 5)[1])) for t in texts]
    fps = [np.frombuffer(simhash.wide_sketch(t.encode(), 5)[0], np.uint64) for t in texts]
    pairs = [
        (i, j)
        for i in range(len(texts))
        for j in range(i + 1, len(texts))
        if bands[i] & bands[j]
        and np.bitwise_count(fps[i] ^ fps[j]).sum() <= simhash.FAR
        and len(sets[i] & sets[j]) >= simhash.SIMILARITY * len(sets[i] | sets[j])
    ]
    got = {r.doc_id: r.component_id for r in simhash.wide_groups(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == groups(pairs, len(texts))


def test_verified_links_join_what_is_alike():
    rng = np.random.default_rng(11)
    sets, fps = [], []
    for _ in range(4):
        stem = rng.choice(10**6, 60, replace=False)
        for _ in range(int(rng.integers(1, 90))):
            own = np.unique(np.where(rng.random(60) < rng.choice([0.05, 0.12]), rng.integers(10**6, 10**9, 60), stem))
            sets.append(own)
            fps.append(rng.integers(0, 4, 4).astype(np.uint64))
    sets += [np.zeros(0, np.int64)] * 2
    fps += [np.zeros(4, np.uint64)] * 2
    n = len(sets)
    begin = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    edges = np.array([0, n // 3, n // 3 + 1, n])
    root, deal = rng.integers(0, n, n), rng.integers(-1, 2, n)
    alike = [
        (i, j)
        for a, b in zip(edges[:-1], edges[1:], strict=True)
        for i in range(a, b)
        for j in range(i + 1, b)
        if (deal[i] != deal[j] or deal[i] < 0) and (not len(sets[i]) + len(sets[j]) or len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])))
    ]
    found = [
        (int(i), int(j))
        for a, b in simhash.verified_links(np.array(fps), edges, root, deal, 256, np.concatenate(sets), begin)
        for i, j in zip(a, b, strict=True)
    ]
    assert set(found) <= set(alike) and len(found) < n < len(alike)
    same = [(i, j) for a, b in zip(edges[:-1], edges[1:], strict=True) for i in range(a, b) for j in range(i + 1, b) if root[i] == root[j]]
    assert groups(found + same, n) == groups(alike + same, n)


def test_hot_keys_join_as_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "HOT_KEYS", 2)
    rows = spark.createDataFrame([(k, i) for k, m in ((1, 40), (2, 20), (3, 9), (4, 1)) for i in range(m)], "k long, i long")
    counted = rows.groupBy("k").count().selectExpr("k", "count AS n", "k * 10 AS v")
    got = sorted((r.k, r.i, r.n, r.v) for r in common.joined_by_count(rows, counted, ["k"]).collect())
    assert got == sorted((r.k, r.i, r.n, r.v) for r in rows.join(counted, "k").collect()) and len(got) == 70


def test_cross_links_against_every_pair():
    rng = np.random.default_rng(6)
    edges = np.array([0, 5, 6, 206, 300])
    base = rng.integers(0, 2**63, (4, 1), np.uint64)
    fps = base[rng.integers(0, 4, 300)] ^ (np.uint64(1) << rng.integers(0, 64, (300, 1)).astype(np.uint64))
    root, deal = rng.integers(0, 3, 300), rng.integers(-1, 2, 300)
    want = {
        (i, j)
        for a, b in zip(edges[:-1], edges[1:], strict=True)
        for i in range(a, b)
        for j in range(i + 1, b)
        if np.bitwise_count(fps[i] ^ fps[j]).sum() <= 2 and root[i] != root[j] and (deal[i] != deal[j] or deal[i] < 0)
    }
    found = [p for a, b in simhash.cross_links(fps, edges, root, deal, 2) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(found) == len(want) and set(found) == want


def test_stage_keeps_rows_of_null_and_shared_ids(spark):
    rng = np.random.default_rng(7)
    a, b, c, d = (" ".join(f"w{x}" for x in rng.integers(0, 10**6, 100)) for _ in range(4))
    rows = [(None, a), (None, b), (None, a + " end"), (7, c), (7, d), (3, c), (3, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id or 0, r.text) for r in simhash.drop_near_duplicates(df).collect()))
    assert [x for x in kept if x[0]] == [(3, c), (7, d)]
    assert len(kept) == 4 and {t.removesuffix(" end") for i, t in kept if not i} == {a, b}


def varied(rng, many, members, length, changes):
    """Texts in families, each changed in some words."""
    texts = []
    for _ in range(many):
        stem = [f"w{x}" for x in rng.integers(0, 10**6, length)]
        for _ in range(members):
            words = list(stem)
            for at in rng.integers(0, length, int(rng.integers(0, changes + 1))):
                words[at] = f"z{rng.integers(0, 10**6)}"
            texts.append(" ".join(words))
    return texts


def test_near_duplicates_against_all_pairs(spark):
    texts = [*varied(np.random.default_rng(6), 12, 14, 150, 3), "", " ", "one", "ONE", "one two"]
    fps = [plain_fingerprint(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if (fps[i] ^ fps[j]).bit_count() <= 3]
    want = groups(pairs, len(texts))
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == list(zip(fps, want, strict=True))
    assert 20 < len(set(want)) < len(texts) - 20


def test_stage_finds_what_is_alike(spark):
    """Recall against all pairs of whole shingle sets, whether or not they share a band: families around the similarity."""
    texts = varied(np.random.default_rng(7), 10, 12, 220, 7)
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    alike = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(sets[i] & sets[j]) >= simhash.SIMILARITY * len(sets[i] | sets[j])]
    got = {r.doc_id: r.component_id for r in simhash.wide_groups(docs(spark, texts)).collect()}
    found = sum(got[i] == got[j] for i, j in alike)
    assert len(alike) > 100 and found >= 0.99 * len(alike)
    want = groups(alike, len(texts))
    assert all(want[i] == want[j] for i in range(len(texts)) for j in range(i) if got[i] == got[j])  # and nothing else
