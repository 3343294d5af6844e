"""Operators on whole corpora, against brute force or held-out accuracy."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwarden.llm import language_id, minhash, mixing, quality, queries, quotas, sharding, url_filter
from sparkwarden.llm.common import held_out, materialize, word_count
from sparkwarden.llm.components import components

SF = "/root/testdata/sf0.01"


def near_corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, base = [], [word() for _ in range(120)]
    passage = [word() for _ in range(60)]
    for i in range(70):  # one large group of near copies, of all degrees
        w = list(base)
        for _ in range(i % 14):
            w[rng.randrange(len(w))] = word()
        rows.append(" ".join(w))
    rows += [" ".join([word() for _ in range(rng.randrange(20, 90))] + passage) for _ in range(60)]  # a shared passage
    rows += [" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    rows += [rows[3]] * 40 + [rows[150].upper()] + ["", None, " \n\t ", "one", "ONE", "one two three four", "x " * 50_000]
    rng.shuffle(rows)
    return [(i * 3 % 1009, t) for i, t in enumerate(rows)]


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    leader = {i: i for i in sets}

    def find(x):
        while leader[x] != x:
            x = leader[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                leader[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("small", [24, 4])
def test_near_duplicates_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL_GROUP", small)
    monkeypatch.setattr(minhash, "BLOCK_FEW", 7)
    monkeypatch.setattr(minhash, "BLOCK_MANY", 11)
    rows = near_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "kept": F.lit("x"), "set_key": F.lit(None).cast("string")})
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    expected = brute_components(rows)
    assert got == {i: (n, c, c == i) for i, (n, c) in expected.items()}


def test_near_duplicates_of_text_ids(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL_GROUP", 4)
    rows = [(f"d{i}" if i % 3 else f"é{i}", t) for i, t in near_corpus()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_edge_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (7, None)]
    got = sorted(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert [(r.doc_id, r.component_id, r.kept) for r in got if r.doc_id] == [(2, 2, True), (5, 2, False), (5, 2, False), (7, 7, True)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(2, False)]
    nameless = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "u v w x y z")]
    got = minhash.near_duplicates(spark.createDataFrame(nameless, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("1", "1", True), ("None", "None", True), ("None", "None", True)]


def test_long_texts_hash_like_short_ones(monkeypatch):
    text = " ".join(f"w{k % 977}" for k in range(20_000))
    whole = minhash.shingle_sets([text])[0]
    monkeypatch.setattr(minhash, "CHUNK", 1000)
    assert (minhash.shingle_sets([text, "a b"])[0] == whole).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    leader = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            leader[a] = leader[b] = min(leader[a], leader[b])
    assert got == {x: c for x, c in leader.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_quotas_are_exact():
    rng = np.random.default_rng(1)
    rows, cols = [1000, 0, 7, 493], [300, 300, 450, 450]
    m = np.array(quotas.communication_matrix(rng, rows, cols))
    assert (m.sum(axis=1) == rows).all() and (m.sum(axis=0) == cols).all() and (m >= 0).all()
    draws = [quotas.hypergeometric(rng, 30, 70, 20) for _ in range(20_000)]
    assert abs(np.mean(draws) - 6) < 0.06 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.15
    assert quotas.hypergeometric(rng, 10**13, 10**13, 10**12) in range(10**11, 9 * 10**11)


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def mix_rows():
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None, "é"]), rng.randrange(0, 400)) for i in range(6000)]
    return rows + [(9001, "tiny", 3), (9002, "zero", 0), (9003, "b", None), (9004, "c", 50_000)] + [(9005, "b", 11)] * 3


def test_mixing_against_brute_force(spark):
    rows = mix_rows()
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumns({"target": F.lit("x"), "block": F.lit(1), "quota": F.lit(2)})
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and {"doc_id", "block", "quota", "taken"} <= set(got[0].asDict())
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n or 0
    expected, taken, shards = brute_targets(sizes), defaultdict(int), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - expected[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * (r.size or 0) and sum(c.units for c in r.copies) == r.taken and all(0 <= c.shard < 8 for c in r.copies)
        taken[r.source] += r.taken
        for c in r.copies:
            shards[c.shard] += c.units
    assert all(abs(taken[s] - expected[s]) <= 1 for s in expected)
    assert max(shards.values()) - min(shards.values()) < 2 * 50_000 + 4000
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    assert mixing.mix(df.limit(0)).count() == 0
    flat = mixing.expand(mixing.mix(df)).groupBy("doc_id").count()
    assert flat.agg(F.max("count")).first()[0] <= 3 * 3


def test_sharding(spark):
    df = spark.range(0, 9001).select(F.when(F.col("id") > 3, F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("block"), F.lit(1).alias("slot"))
    df = df.union(df.limit(5))
    rows = sharding.shard(df, 8).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert sorted(len(v) for v in by.values())[0] + 1 >= max(len(v) for v in by.values()) and set(by) == set(range(8))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sorted(map(str, rows)) == sorted(map(str, sharding.shard(df.repartition(5), 8).collect()))
    near = np.corrcoef([r.doc_id or 0 for r in rows], [r.shard * 2000 + r.slot for r in rows])[0, 1]
    assert abs(near) < 0.05
    assert sharding.shard(df.limit(0), 8).count() == 0 and sharding.shard(df.limit(3), 8).count() == 3


def test_whole_documents_are_sharded(spark, monkeypatch):
    made, shard = [], sharding.shard
    monkeypatch.setattr(sharding, "shard", lambda df, *more: made.append(shard(df, *more)) or made[-1])
    rows = queries.op7_sharding(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    shards = {(r.shard, r.slot): r for r in made[0].collect()}
    assert Counter(tuple(r)[:-2] for r in shards.values()) == Counter(map(tuple, docs.collect())) and len(shards) == len(rows)
    for r in rows:
        text = (shards[r.shard, r.slot].text or "").encode()
        assert (r.doc_id, r.size, r.text_crc32) == (shards[r.shard, r.slot].doc_id, len(text) + 1, zlib.crc32(text))


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").withColumns({"score": F.lit("x"), "_judged": F.lit(1)})
    model = language_id.fit(docs)
    out = language_id.identify(docs.withColumn("held", held_out(F.col("doc_id"))), model).filter("held").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.97 and out.score.between(0, 1).all() and out.rejected[out.lang_pred != 'und'].mean() < 0.001
    odd = spark.createDataFrame([(None,), ("",), ("123 !!! \n",), ("x",), ("zq" * 30_000,), ("日本語の文章です" * 50,)], "text string")
    got = language_id.identify(odd, model).collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and all(r.rejected for r in got[:3]) and all(r.lang_pred in model.languages for r in got[3:])
    assert got[4].rejected and got[5].rejected and not set(model.languages) - set(out.lang)
    empty = language_id.fit(docs.limit(0))
    assert [r.lang_pred for r in language_id.identify(odd, empty).collect()] == ["und"] * 6


def test_all_languages_and_letters_are_learned(spark):
    """70 languages, more letters than a byte holds; pairs of languages differ in which of two rare letters they use."""
    rng, rows = random.Random(8), []
    for k in range(70):
        common = [chr(0x4E00 + 40 * (k // 2) + c) for c in range(36)]
        own = [chr(0x9000 + 2 * k), chr(0x9001 + 2 * k)]
        words = ["".join(rng.choice(common if rng.random() < 0.9 else own) for _ in range(4)) for _ in range(40)] if k % 2 == 0 else [w.translate({ord(a): b for a, b in zip(last, own)}) for w in words]
        last = own
        rows += [(1000 * k + i, " ".join(rng.choice(words) for _ in range(60)), f"l{k:02d}") for i in range(20 - k // 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert len(model.languages) == 70
    out = language_id.identify(docs.filter(held_out(F.col("doc_id"))), model).toPandas()
    assert len(out) > 100 and (out.lang == out.lang_pred).all() and not out.rejected.any()


def test_language_scores_by_plain_interpolation(monkeypatch):
    """Cross-entropies against Kneser-Ney written out over dictionaries; parts of a text count as the whole."""
    texts = ["the cat sat on the mat", "a cat, a hat!", "that is that"] * 2
    rank = np.ones(0x110000, np.uint16)
    for k, c in enumerate("abcdefghijklmnopqrstuvwxyz"):
        rank[ord(c)] = 2 + k
    model = language_id.KneserNey(*language_id.text_counts(texts, rank), language_id.ORDER, 28, language_id.BITS)
    coder = language_id.Identifier(["x"], rank, [model])
    plain = lambda t: ("".join(c if c.isalpha() else " " for c in t.lower()) + " ").split(" ")
    chars = lambda t: "".join(w + " " for w in plain(t) if w)
    grams = Counter(g for t in texts for s in ["   " + chars(t)] for g in (s[k : k + 4] for k in range(len(s) - 3)))
    levels = {4: grams}
    for n in (3, 2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])

    def p(g):
        if not g:
            return 1 / 28
        c = levels[len(g)]
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.1
        with_history = [v for k, v in c.items() if k[:-1] == g[:-1]]
        if not with_history:
            return p(g[1:])
        return max(c[g] - d, 0) / sum(with_history) + d * len(with_history) / sum(with_history) * p(g[1:])

    tests = ["the hat sat", "zebra!  that", "cat"]
    expected = [-np.mean([np.log(p(s[k : k + 4])) for s in ["   " + chars(t)] for k in range(len(s) - 3)]) for t in tests]
    assert coder.entropies(tests)[0][:, 0] == pytest.approx(expected)
    monkeypatch.setattr(language_id, "CHUNK", 3)
    assert coder.entropies(tests)[0][:, 0] == pytest.approx(expected)
    assert language_id.text_counts(texts, rank)[1].sum() == sum(grams.values())


def test_language_rejection_is_calibrated():
    rng = np.random.default_rng(5)
    model = language_id.Identifier(["a", "b", "few"], np.ones(1, np.uint16), [])
    truth, length = rng.integers(0, 2, 4000), rng.integers(20, 3000, 4000).astype(float)
    entropy = 2.0 + 0.3 * truth + 1.5 / np.sqrt(length) + (0.05 + 1 / np.sqrt(length)) * rng.exponential(0.4, 4000)
    model.calibrate(truth, entropy, length, np.zeros((4000, len(language_id.TEMPERATURES))))
    over = model.excess(truth, entropy, length) > 0
    assert over.mean() < 0.003 and np.isinf(model.levels[2, 2])
    assert (model.excess(truth, entropy + 12 * (0.05 + 1 / np.sqrt(length)), length) > 0).all()


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, 4000).astype(np.uint8)
    model = language_id.KneserNey(*language_id.counts([language_id.grams(x, 4)]), 4, 6)
    for history in ((1, 2, 3), (5, 5, 5), (9, 9, 9)):
        codes = np.array([(history[0] << 24) | (history[1] << 16) | (history[2] << 8) | c for c in range(6)], np.uint64)
        assert abs(np.exp(model.log_probability(codes)).sum() - 1) < 1e-6


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    out = quality.score(docs, model).join(labels, "doc_id").filter(held_out(F.col("doc_id"))).toPandas()
    assert (out.predicted == out.quality).mean() > 0.9 and out.score.between(0, 1).all() and ((out.score >= 0.3) == (out.predicted == 1)).all()
    odd = quality.score(spark.createDataFrame([(1, None), (2, ""), (3, "a" * 100_000)], "doc_id long, text string"), model).collect()
    assert [r.score for r in odd][0] == [r.score for r in odd][1] and all(0 <= r.score <= 1 for r in odd)
    none = quality.fit(docs, labels.limit(0))
    assert quality.score(docs.limit(5), none).count() == 5
    assert quality.score(docs.limit(0), model).count() == 0


def test_hashed_ngrams_of_parts_are_the_wholes(monkeypatch):
    """Counts of words, pairs of words and trigrams in bins, by a plain count of distinct n-grams."""
    text = "Once upon a time, once  upon\na hill: " * 40 + "日本 é"
    whole = quality.hashed(text)
    words = text.lower().split()
    assert len(whole) == 512 and whole[:256] @ whole[:256] == pytest.approx(1) and whole[256:] @ whole[256:] == pytest.approx(1)
    n = 2 * len(words) - 1
    counts = Counter(words) + Counter(zip(words, words[1:]))
    assert sorted(round(v * v * n) for v in whole[:256] if v) == sorted(counts.values()) or len([v for v in whole[:256] if v]) < len(counts)
    assert sum(round(v * v * n) for v in whole[:256]) == n and max(round(v * v * n) for v in whole[:256]) >= max(counts.values())
    monkeypatch.setattr(quality, "CHUNK", 7)
    assert quality.hashed(text) == pytest.approx(whole)
    assert quality.hashed("") == pytest.approx(0) and quality.hashed(" \n") == pytest.approx(0)


def test_quality_is_learned_from_words(spark):
    """Texts whose surface is alike; only which words they use tells the labels."""
    rng = random.Random(12)
    names = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(120)]
    rows = [(i, " ".join(rng.choice(names[:70] if i % 3 else names[50:]) for _ in range(80)), int(i % 3 > 0)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    out = quality.score(df, quality.fit(df.drop("quality"), df.drop("text"))).filter(held_out(F.col("doc_id"))).toPandas()
    assert (out.predicted == out.quality).mean() > 0.97


def test_bradley_terry_finds_the_order():
    rng = np.random.default_rng(3)
    truth, x = np.array([2.0, -1.0, 0.0]), rng.normal(size=(400, 3))
    a, b = rng.integers(0, 400, (2, 4000))
    first = rng.random(4000) < 1 / (1 + np.exp(-(x[a] - x[b]) @ truth))
    w = quality.bradley_terry(x, np.where(first, a, b), np.where(first, b, a), ridge=1e-3)
    assert np.abs(w - truth).max() < 0.25


URLS = [
    "http://www.example.com/en/a", "https://Blog.EXAMPLE.com/en/b?x=1#y", "http://example.com/enx", "ftp://a.net/es/1", "http://a.b.net/fr/", "http://net/fr/", "http://xnet/fr/1", "http://a.com", "http://a.com/",
    "http://a.org/en/?q", "no scheme/com/", "", None, "http://", "x://y://com/", "http://a.net/es", "http://www.example.com/en/a", "http://a.org/é/" + "p/" * 3000,
]


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = lambda s, ends: s[: min([s.find(e) for e in ends if e in s] + [len(s)])]
    host = cut(rest, "/?#")
    path = cut(rest[len(host):], "?#")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def test_url_rules_against_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path, name, verdict = brute_rule(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, name)
        assert got[i].verdict in ("allow", "block") and (verdict is None or got[i].verdict == verdict)
    assert url_filter.judge(df.limit(0)).count() == 0


def test_mined_verdicts_against_brute_force(spark):
    """URLs that no fixed rule fits get the surest of all pruned rules whose tokens they have; null labels are not counted."""
    from itertools import combinations
    rng = random.Random(15)
    made = lambda: f"{rng.choice(['http', 'https'])}://{rng.choice('abc')}.org/{rng.choice(['x', 'y'])}/{rng.choice(['p', 'q', 'r'])}"
    tokens = lambda u: frozenset([f"scheme:{u.split('://')[0]}", "tld:org", "host:org", f"host:{u.split('://')[1][0]}", *(f"path:{p}" for p in u.split("/")[3:])])
    labelled = [(u, "block" if "/x/p" in u or (".org/y" in u and rng.random() < 0.4) or "b.org/y/r" in u else "allow") for u in (made() for _ in range(500))]
    asked = sorted({made() for _ in range(80)}) + ["https://new.org/z", "ftp://c.org/y/q", "http://zz/"]
    every = {}
    for s in {frozenset(c) for u in {u for u, _ in labelled} for n in range(1, 7) for c in combinations(sorted(tokens(u)), n)}:
        of = [label for u, label in labelled if s <= tokens(u)]
        for label in ("allow", "block"):
            n = of.count(label)
            if n >= 0.002 * 500 and n / len(of) >= 0.6:
                every[s, label] = (n / len(of), n / 500)
    kept = {k: v for k, v in every.items() if not any(len(k[0]) > 1 and every.get((k[0] - {out}, k[1]), (-1,))[0] >= v[0] for out in k[0])}
    expected = {}
    for k, u in enumerate(asked):
        own = frozenset(["scheme:" + u.split("://")[0], *("host:" + h for h in u.split("/")[2].split(".")), "tld:" + u.split("/")[2].split(".")[-1], *("path:" + p for p in u.split("/")[3:] if p)])
        fits = [(*v, len(s), label == "block", label) for (s, label), v in kept.items() if s <= own]
        expected[k] = max(fits)[4] if fits else "allow"
    pages = spark.createDataFrame(list(enumerate(asked)), "page_id long, url string")
    noise = [(u, None) for u, _ in labelled[:200]]
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, labelled=spark.createDataFrame(labelled + noise, "url string, label string")).collect()}
    assert got == expected and set(got.values()) == {"allow", "block"}


def test_mined_rules_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(600):
        t = {rng.choice(["a", "b", "c"]), rng.choice(["d", "e"]), rng.choice(["f", "g", "h"])}
        rows.append((sorted(t), "block" if {"a", "d"} <= t or rng.random() < 0.1 else "allow"))
    got = {(tuple(r.tokens), r.label): (round(r.confidence, 9), round(r.support, 9)) for r in url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), min_support=0.02, min_confidence=0.7).collect()}
    from itertools import chain, combinations
    every = {}
    for tokens in {s for t, _ in rows for s in chain.from_iterable(combinations(t, k) for k in (1, 2, 3))}:
        of = [label for t, label in rows if set(tokens) <= set(t)]
        for label in ("block", "allow"):
            n = of.count(label)
            if n / 600 >= 0.02 and n / len(of) >= 0.7:
                every[tokens, label] = (round(n / len(of), 9), round(n / 600, 9))
    kept = {k: v for k, v in every.items() if not any((tuple(x for x in k[0] if x != out), k[1]) in every and every[tuple(x for x in k[0] if x != out), k[1]][0] >= v[0] for out in k[0] if len(k[0]) > 1)}
    assert got == kept and (("a", "d"), "block") in got


def test_mined_rules_count_whole_transactions_of_many_tokens(spark):
    """Long sets of tokens that go together, and deep chains of them: no token is left out of a count."""
    rng = random.Random(6)
    rows, fillers, depth = [], [f"f{k:02d}" for k in range(24)], [f"p{k:02d}" for k in range(30)]
    for _ in range(600):
        t = {rng.choice("ab"), rng.choice("cd")} | ({"wide"} if rng.random() < 0.8 else set())
        long = rng.random() < 0.4
        t |= set(fillers) if long else set(depth[: rng.randrange(30)])
        rows.append((sorted(t), "block" if {"a", "wide"} <= t and (long or rng.random() < 0.6) or rng.random() < 0.1 else "allow"))
    mined = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), min_support=0.02, min_confidence=0.7).collect()
    got = {(tuple(r.tokens), r.label): (round(r.confidence, 9), round(r.support, 9)) for r in mined}
    assert len(got) == len(mined)
    from itertools import combinations
    every, names = {}, ["a", "b", "c", "d", "f00", "f23", "wide", "p05", "p06", "p07"]  # by brute force over these
    for k in (1, 2, 3, 4):
        for tokens in combinations(sorted(names), k):
            of = [label for t, label in rows if set(tokens) <= set(t)]
            for label in ("block", "allow"):
                if of.count(label) / 600 >= 0.02 and of.count(label) / len(of) >= 0.7:
                    every[tokens, label] = (round(of.count(label) / len(of), 9), round(of.count(label) / 600, 9))
    less = lambda t, out: tuple(x for x in t if x != out)
    kept = {k: v for k, v in every.items() if not any(len(k[0]) > 1 and every.get((less(k[0], out), k[1]), (-1,))[0] >= v[0] for out in k[0])}
    assert {k: v for k, v in got.items() if set(k[0]) <= set(names)} == {k: v for k, v in kept.items()}
    assert (("a", "f00", "wide"), "block") in got and (("a", "f23", "wide"), "block") in got and not any({"f00", "f23"} <= set(t) for t, _ in got)


def test_shared_folder_is_the_clusters(spark):
    df = materialize(spark.range(3), "probe")
    assert df.inputFiles()[0].startswith(spark.conf.get("spark.checkpoint.dir")) and df.select(word_count(F.lit("a b"))).first()[0] == 2
