"""MinHash near-duplicates against all pairs of full sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowgate.llm import minhash

WORDS = [f"w{i}" for i in range(5000)]


def shingles(text, words=3):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def plain(rows, percent=85):
    """Each row's set size and component, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    ids = [d for d, _ in rows]
    out = []
    for i in range(len(rows)):
        named = [ids[j] for j in range(len(rows)) if label[j] == label[i] and ids[j] is not None]
        least = min(named, default=None)
        out.append((ids[i], len(sets[i]), least, ids[i] == least))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit("clash"), "size": F.lit(1)}).repartition(5)
    return sorted((tuple(r) for r in minhash.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def families(seed, many, members, changes, length=(20, 120)):
    rng = random.Random(seed)
    rows = []
    for _ in range(many):
        base = [rng.choice(WORDS) for _ in range(rng.randint(*length))]
        for _ in range(members):
            w = list(base)
            for _ in range(rng.randint(0, changes)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    return rows


def test_components_against_all_pairs(spark):
    rows = families(1, 25, 12, 5) + [(10_000 + i, " ".join(random.Random(i).choices(WORDS, k=40))) for i in range(40)]
    assert found(spark, rows) == plain(rows)


def test_one_large_family_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 16)
    monkeypatch.setattr(minhash, "TILE_SHINGLES", 1500)
    rows = families(2, 1, 220, 8, (60, 80))
    want = plain(rows)
    assert 5 < len({w[2] for w in want}) < 200
    assert found(spark, rows) == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One\ttwo"), (8, "two one"), (None, "lone text here now"), (9, "a b c " * 4000)]
    rows += [(10, "x y z w v"), (10, "x y z w v"), (11, "x y z w v"), (None, "x y z w v"), (12, "Ä b c"), (13, "ä b c"), (14, "a b c d"), (5, "other words than before")]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == [] and found(spark, [(1, None)]) == [(1, 0, 1, True)]


@pytest.mark.parametrize("share, linked", [(85, True), (84, False)])
def test_threshold_is_exact(spark, share, linked):
    words = [f"k{i}" for i in range(400)]
    # 100 shingles in the union, of which `share` are common
    a, b = words[: share + 2 + (100 - share)], words[: share + 2]
    rows = [(1, " ".join(a)), (2, " ".join(b))]
    assert len(shingles(rows[0][1])) == 100 and len(shingles(rows[1][1])) == share
    assert (found(spark, rows)[1][2] == 1) is linked


def test_errors_within_the_guarantee_share_a_key():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, minhash.POSITIONS).astype(np.uint16)
        b = a.copy()
        wrong = rng.choice(minhash.POSITIONS, minhash.GUARANTEED, replace=False)
        b[wrong] ^= rng.integers(1, 1 << 16, minhash.GUARANTEED).astype(np.uint16)
        ka, kb = minhash.keys(np.array([a, b]))
        assert (ka == kb).any()


def test_pairs_at_the_similarity_meet():
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(2000):
        union = rng.integers(0, 1 << 63, 100).astype(np.uint64)
        a, b = minhash.signature(union[:92]), minhash.signature(np.concatenate([union[:85], union[92:]]))
        ka, kb = minhash.keys(np.array([a, b]))
        met += (ka == kb).any() and (a != b).sum() <= minhash.REACH
    assert met == 2000
