"""Quality, toxicity, URLs, decontamination, mixing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowgate.llm import decontam, mixing, quality, toxicity, urls
from rowgate.llm.common import fold

# --- quality ---


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    net = quality.Network(width=7, hidden=4)
    x, first, target = rng.normal(size=(9, 7)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    y, kept = net.forward(x, first)
    grads = net.gradients(y, target, kept)

    def loss():
        p = net.forward(x, first)[0]
        return -np.mean(target * np.log(p) + (1 - target) * np.log(1 - p))

    for name, g in grads.items():
        at = tuple(int(rng.integers(0, n)) for n in net.p[name].shape)
        net.p[name][at] += 1e-6
        up = loss()
        net.p[name][at] -= 2e-6
        assert (up - loss()) / 2e-6 == pytest.approx(g[at], abs=1e-5)
        net.p[name][at] += 1e-6


def test_encoding_doesnt_depend_on_company():
    texts = [b"", b"plain words here", b"X" * 3000, "é ñ".encode() * 100]
    alone = np.concatenate([quality.encode([t])[0] for t in texts])
    assert np.allclose(alone, quality.encode(texts)[0]) and np.allclose(alone, quality.encode_all(texts, 512)[0])
    assert (quality.encode_all(texts, 512)[1] == quality.encode(texts)[1]).all()


def labelled(spark, n=400):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(rng.randint(20, 200))]
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(good), int(not good)))
    rows += [(n, None), (n + 1, ""), (None, "words"), (5, "again")]
    labels += [(None, 1, 0), (7, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_learns_and_keeps(spark):
    docs, labels = labelled(spark)
    net = quality.fit(docs, labels, fold("label_id", 3) != 1, 60)
    scored = quality.score(docs.withColumn("quality_score", F.lit("clash")), net).collect()
    assert len(scored) == docs.count() and all(0 <= r.quality_score <= 1 for r in scored)
    own = [r for r in scored if r.doc_id is not None and r.doc_id < 400 and r.text != "again"]
    assert np.mean([(r.quality_score >= 0.5) == (r.doc_id % 3 != 0) for r in own]) > 0.98
    assert quality.keep_good(docs, labels, fold("label_id", 3) != 1).columns == docs.columns
    assert quality.fit(docs, labels.limit(0), F.lit(True)) is None
    assert {r.quality_score for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(docs.limit(0), net).count() == 0


# --- toxicity ---


def edits(a, b):
    """Damerau distance with swaps of neighbours (optimal alignment)."""
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_distances():
    rng = random.Random(3)
    lexicon = {"".join(rng.choices("abc", k=rng.randint(3, 7))): 1.0 for _ in range(12)}
    matcher = toxicity.Matcher(lexicon, {})
    for _ in range(3000):
        word = "".join(rng.choices("abcd", k=rng.randint(1, 8)))
        want = word in lexicon or any(len(w) >= toxicity.FUZZY_FROM and edits(word, w) <= 1 for w in lexicon)
        got = matcher.match(word)
        assert (got is not None) == want, word
        if got:
            assert got[1] == (word in lexicon)


def test_long_entries_may_have_two_edits():
    rng = random.Random(5)
    lexicon = {"".join(rng.choices("ab", k=n)): 1.0 for n in (4, 6, 8, 9, 9, 10, 11)}
    matcher = toxicity.Matcher(lexicon, {})
    found = 0
    for _ in range(4000):
        word = "".join(rng.choices("abc", weights=(5, 5, 1), k=rng.randint(3, 13)))
        want = any(edits(word, w) <= toxicity.edits_of(w) for w in lexicon)
        assert (matcher.match(word) is not None) == want, word
        found += want
    assert 100 < found < 3900


def test_stems_take_any_ending():
    matcher = toxicity.Matcher({}, {"stump": 2.0, "vek": 1.0})
    assert matcher.match("stumping") == (2.0, True) and matcher.match("stmup") == (2.0, False) and matcher.match("sturping") == (2.0, False)
    assert matcher.match("vekish") == (1.0, True) and matcher.match("vokish") is None and matcher.match("st") is None


def test_toxicity_learns_words_stems_and_context(spark):
    rng = random.Random(2)
    clean = ["".join(rng.choices("bcdfgaeiou", k=6)) for _ in range(800)]
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(clean, k=40)
        bad = i % 2
        if bad:
            words[rng.randrange(40)] = rng.choice(["nastyword", "stump" + rng.choice(clean)[:3]])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, bad))
    rows += [(1000, "good words nastywrod more"), (1001, None), (1002, ""), (None, "x")]
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, table, fold("label_id", 5) != 0)
    assert "nastyword" in model.words and any(s.startswith("stu") for s in model.stems)
    got = {r.doc_id: r.toxic_score for r in toxicity.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(i % 2) for i in range(600)]) > 0.97
    assert got[1001] == got[1002] < 0.5
    quoted = model.features('he said "nastyword" yesterday')
    plain = model.features("you are a nastyword yesterday")
    assert quoted[5] > 0 and plain[5] == 0 and quoted[2] < plain[2]
    assert toxicity.fit(docs, table.limit(0), F.lit(True)) is None
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_of_odd_texts(spark):
    model = toxicity.Model({"nastyword": 5.0}, {"vil": 3.0}).fit([("you nastyword", 1), ("a vilest thing", 1), ("fine words", 0), ("good day", 0)])
    rows = [(1, None), (2, ""), (3, "!?"), (4, "plain " * 300_000), (5, "plain nastyword " * 150_000), (6, "you nastyword"), (6, "you nastyword"), (None, "n" * 500_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS toxic_score", "2 AS label_id")
    got = [(r.doc_id, r.toxic_score) for r in toxicity.score(df, model).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    by = {}
    for d, s in got:
        by.setdefault(d, set()).add(s)
    assert all(len(s) == 1 for s in by.values()) and by[1] == by[2] == by[3] == by[4] and min(by[5] | by[6]) > max(by[1])


# --- urls ---


def test_viterbi():
    counts = {"cheap": 5, "pills": 5, "th": 20, "the": 50, "pill": 1}
    assert urls.viterbi("cheappills", counts, 1000) == ["cheap", "pills"]
    assert urls.viterbi("theth", counts, 1000) == ["the", "th"]
    assert "".join(urls.viterbi("xqzcheapw", counts, 1000)) == "xqzcheapw" and "cheap" in urls.viterbi("xqzcheapw", counts, 1000)
    assert urls.viterbi("", counts, 10) == []


def test_rules_and_parts(spark):
    cases = [
        ("http://Example.ORG/es/1", "example.org", "/es/1", "example.org/es/", "block"), ("https://a.example.org/en/12?x", "a.example.org", "/en/12", "example.org/en/1", "block"),
        ("x://b.org/fr", "b.org", "/fr", "org/", "allow"), ("x://b.com/fr/a#t", "b.com", "/fr/a", "com/fr/", "allow"), ("x://com/de/", "com", "/de/", "com/de/", "block"),
        ("x://notcom.net/de/", "notcom.net", "/de/", None, None), ("x://b.org", "b.org", "", None, None), ("nothing", "", "", None, None), (None, "", "", None, None),
        ("a://b://c/d", "b:", "//c/d", None, None), ("x://B.com?q=/de/", "b.com", "", None, None),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "url string")
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    name, verdict = urls.rule_for(host, path)
    got = [tuple(r) for r in df.select("url", host, path, name, verdict).collect()]
    assert got == [(u, h or "", p or "", r, v) for u, h, p, r, v in cases]


def test_judging(spark):
    pages = [(i, f"http://good{'abcd'[i % 4]}.net/{i}", "<p>good cheap pills words</p>") for i in range(30)]
    pages += [(100 + i, f"http://cheappills.net/buy/{i}", None) for i in range(10)] + [(200, None, ""), (201, "no scheme", "x"), (202, "", None), (5, "http://gooda.net/buy", "<b>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'c' AS host", "'c' AS tokens", "1 AS n")
    got = urls.judge(df).collect()
    assert len(got) == len(pages)
    assert {r.verdict for r in got if 100 <= r.page_id < 200} == {"block"} and {r.verdict for r in got if r.page_id < 30 and "buy" not in r.path} == {"allow"}
    assert urls.judge(df.limit(0)).count() == 0


def test_hosts_without_seed_words(spark):
    """Held-out hosts: concatenated, and none has a seed word; what they share with seeded hosts was learned."""
    rng = random.Random(12)
    shady, plain = ["win", "bonus", "jackpot", "deal", "magic", "fast"], ["garden", "music", "river", "bread", "stone", "paper"]
    text = " ".join([*shady, *plain, "casino", "pills", "cheap", "online"] * 30)
    seeded = [f"http://{''.join(rng.sample(['casino', 'pills'], 1) + rng.sample(shady, 2))}{i % 3}.net/{i}" for i in range(60)]
    good = [f"http://{''.join(rng.sample(plain, 3))}.net/{i}" for i in range(200)]
    held = [f"http://{''.join(rng.sample(shady, 3))}.net/{i}" for i in range(20)] + ["http://www.cheappillsonline.net/", f"http://{'winbonus' * 40_000}.net/"]
    rows = [(i, u, text if i < 5 else None) for i, u in enumerate(seeded + good + held)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    verdicts = [got[i].verdict for i in range(len(rows))]
    assert len(got) == len(rows) and verdicts[60:260].count("allow") >= 195 and verdicts[260:].count("block") >= 20
    assert verdicts[280] == verdicts[281] == "block" and {"cheap", "pills"} <= set(got[280].tokens)


# --- decontamination ---


def test_leaks_against_every_window(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [" ".join(rng.choices(vocabulary, k=n)) for n in (30, 30, 45, 12, 5, 4, 1)] + ["", None]
    docs = []
    for i in range(60):
        words = rng.choices(vocabulary, k=200)
        if i % 3 == 0:
            own = items[(i // 3) % 4].split()
            for _ in range(i // 12 % 4):
                own[rng.randrange(len(own))] = "changed"
            words[50:50] = own
        docs.append((i, " ".join(words).upper() if i % 2 else ", ".join(words)))
    docs += [(100, items[4]), (101, "x " + items[5] + " y"), (102, None), (103, ""), (104, items[0]), (104, items[0])]
    bench = [(n, t) for n, t in enumerate(items)]
    want = set()
    for doc_id, text in docs:
        words = decontam.words_of((text or "").encode())
        for n, t in bench:
            own = decontam.words_of((t or "").encode())
            if own and words:
                width = min(5, len(own))
                theirs = [tuple(own[i : i + width]) for i in range(len(own) - width + 1)]
                for p in range(max(1, len(words) - len(own) + 1)):
                    mine = [tuple(words[p : p + len(own)][i : i + width]) for i in range(min(len(own), len(words)) - width + 1)]
                    rest, common = list(theirs), 0
                    for s in mine:
                        if s in rest:
                            rest.remove(s)
                            common += 1
                    if common >= 0.8 * (len(mine) + len(theirs) - common) and common:
                        want.add((doc_id, n))
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "0.5 AS similarity")
    table = spark.createDataFrame(bench, "item_id long, text string")
    found = decontam.leaks(df, table).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(want) > 10
    kept = {r.doc_id for r in decontam.drop_leaking(df, table).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}
    assert decontam.leaks(df.limit(0), table).count() == 0 and decontam.leaks(df, table.limit(0)).count() == 0


def test_benchmark_in_blocks_finds_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"i{i}w{k}" for k in range(20))) for i in range(12)], "item_id long, text string")
    docs = items.selectExpr("item_id AS doc_id", "concat('before ', text, ' after') AS text")
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 300)
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()} == {(i, i) for i in range(12)}


@pytest.mark.parametrize("size, deal", [(400, 3), (4000, 20_000), (150_000, 20_000)])
def test_blocks_of_any_size_give_the_same(spark, monkeypatch, size, deal):
    """Fifty blocks, five and one; a passage that a third of all documents have, an item of two texts, repeated documents, odd rows."""
    rng = random.Random(7)
    make = lambda n: " ".join(rng.choices([f"w{i}" for i in range(900)], k=n))
    texts = {i: make(rng.choice([3, 12, 30])) for i in range(150)}
    rows = [*texts.items(), (5, texts[6]), (200, None), (201, ""), (None, texts[9])]
    docs = [(i, make(40) + " " + texts[i % 150] + " " + make(20)) for i in range(90)] + [(i, make(15) + " " + texts[3]) for i in range(90, 140)]
    docs += [(300, texts[6]), (300, texts[6]), (301, None), (302, ""), (None, texts[30])]
    items, df = spark.createDataFrame(rows, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = sorted((tuple(r) for r in decontam.leaks(df, items).collect()), key=str)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
    monkeypatch.setattr(decontam, "DEAL", deal)
    assert sorted((tuple(r) for r in decontam.leaks(df, items).collect()), key=str) == want and len(want) > 140
    kept = {r.text for r in decontam.drop_leaking(df, items).collect()}
    assert kept == {t for _, t in docs} - {t for d, t in docs if any(w[0] == d for w in want)}


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 2**63, 3000, np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000, np.uint64)
    fps[1000:1200] = fps[:200]
    flips = np.array([sum(1 << int(k) for k in rng.permutation(64)[: i % 24]) for i in range(400)], np.uint64)
    windows = fps[:400] ^ flips
    want = {(w, i) for w, i in zip(*(x.tolist() for x in np.nonzero(np.bitwise_count(windows[:, None] ^ fps[None]) <= decontam.RADIUS)), strict=True)}
    got = [(w, i) for a, b in decontam.Index(fps).near(windows) for w, i in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_many_items_of_one_size_fit():
    """100,000 items: every planted one is found with a word of fifty changed, all by way of the index."""
    rng = np.random.default_rng(3)
    words = np.array([f"word{i}".encode() for i in range(30_000)], object)
    items = [(i, b" ".join(words[row])) for i, row in enumerate(rng.integers(0, len(words), (100_000, 24)))]
    held = decontam.Items(items)
    found = 0
    for i in range(0, 100_000, 2000):
        own = items[i][1].split()
        own[-1 if i % 4000 else 0] = b"changed"
        text = b" ".join([b"some words before", *own, b"and after"])
        found += any(held.ids[n] == i and likeness >= 0.8 for n, likeness, _ in held.matches(text))
    assert found == 50


def test_windows_of_long_items():
    rng = np.random.default_rng(4)
    hashes = rng.integers(0, 2**63, 9000, np.uint64)
    for size in (1, 7, 8500, 9000):
        got = decontam.window_fingerprints(hashes, size).tolist()
        assert len(got) == len(hashes) - size + 1
        for i in {*range(0, len(got), 97), len(got) - 1}:
            assert got[i] == decontam.majority(hashes[i : i + size])


# --- mixing ---


def filled(sizes, weights=(3, 1, 2), total=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, full, left = {}, set(), total * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        share = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if weight[s] * share > most * sizes[s]]
        if not over:
            return target | {s: weight[s] * share for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            full.add(s)


def test_targets_against_resharing(spark):
    rng = random.Random(1)
    for n in (1, 2, 5, 20):
        sizes = {rng.choice([f"s{i}", f"é{i}", f"S{i}"]): rng.randint(1, 10_000) ** 2 // 100 + 1 for i in range(n)} | {None: 50}
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in mixing.rates(df).collect()}
        want = filled(sizes)
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in got)


def test_mix_repeats_and_agrees(spark):
    rows = [(i, f"s{i % 3}", "word " * (1 + i % 50)) for i in range(3000)] + [(5000, None, None), (None, "s1", ""), (7, "s1", "again and again")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS rate", "2 AS size")
    taken = mixing.copies(df)
    by = {r.source: r for r in taken.groupBy("source").agg(F.sum(F.col("mix_size") * F.col("mix_copies")).alias("took"), F.max("mix_target").alias("target")).collect()}
    for s in ("s0", "s1", "s2"):
        assert by[s].took == pytest.approx(by[s].target, rel=0.06)
    assert taken.filter("mix_copies > 2").count() == 0
    once, again = (sorted(map(str, mixing.mix(df).collect())) for _ in range(2))
    assert once == again and mixing.mix(df).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, "a", None), (2, "a", "")], "doc_id long, source string, text string")
    assert [r.mix_target for r in mixing.copies(blank).collect()] == [0.0, 0.0]


def test_leaking_rows_go_by_their_own_text(spark):
    item = " ".join(f"w{k}" for k in range(20))
    df = spark.createDataFrame([(None, item), (None, "other"), (7, f"x {item}"), (7, "more")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r.text for r in decontam.drop_leaking(df, items).collect()) == ["more", "other"]


# --- held-out labels of the given tables ---


def under_the_curve(rows):
    """Share of pairs of a labelled 1 and a labelled 0 in which the first has the higher score."""
    high, low = ([s for s, y in rows if y == v] for v in (1, 0))
    return sum((a > b) + (a == b) / 2 for a in high for b in low) / (len(high) * len(low))


@pytest.mark.parametrize("name, label, curve, right", [("op1_quality_classifier", "quality", 0.95, 0.95), ("op3_toxicity", "toxic", 0.8, 0.93)])
def test_held_out_documents(spark, name, label, curve, right):
    from rowgate.llm import queries

    data = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", label)
    found = queries.queries()[name](spark, data).filter("held_out").join(labels, "doc_id").filter(F.col(label).isNotNull()).collect()
    assert len(found) > 50
    assert under_the_curve([(r.score, r[label]) for r in found]) >= curve
    assert sum(r.predicted == r[label] for r in found) / len(found) >= right
