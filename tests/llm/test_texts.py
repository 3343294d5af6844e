"""Operators on single texts, against brute force, libraries and round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkwarden.llm import bpe, fingerprint, media, token_counts
from sparkwarden.llm.common import word_count

TEXTS = [
    (1, "The quick brown fox, isn't it?\nSecond line.\n\nNew section here."), (2, ""), (3, None), (4, "x" * 70_000), (5, "the " * 9_000), (6, "Straße ÀÉ \u00a0日本語 👍🏽"),
    (7, "<|endoftext|> A <|startoftext|>b"), (8, "The quick brown fox, isn't it?\nSecond line.\n\nNew section here."), (8, "again the same id"), (9, " \t\n\x0b\x0c\r "), (10, "ab"), (None, "no id"), (11, "'s'll 12 3.4 !!! e\u0301"),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({"n_tokens": F.lit("clash"), "shard": F.lit(1), "next_text": F.lit(2), "edits": F.lit(3)})


def test_bpe_is_the_librarys(spark, docs):
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = bpe.encode(docs, path).collect()
    assert len(rows) == len(TEXTS)
    expected = {}
    for i, text in TEXTS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.setdefault(i, []).append((ids, library.decode(ids, skip_special_tokens=False)))
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert (ids, r.decoded) in expected[r.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.encode(docs.limit(0), path).count() == 0


def test_bpe_on_random_words():
    coder = bpe.TrieBpe(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(4)
    texts = ["".join(rng.choice(["th", "ing", "er", "an", "ß", "é", "q", "日", " ", "'re", "7"]) for _ in range(rng.randrange(30))) for _ in range(1500)]
    for text, ids in zip(texts, coder.encode_batch(texts)):
        assert (np.frombuffer(ids, "<u4").tolist() if ids else []) == library.encode(text, add_special_tokens=False).ids


def test_bpe_on_each_code_point():
    coder = bpe.TrieBpe(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    same = lambda texts: all((np.frombuffer(x, "<u4").tolist() if x else []) == y.ids for x, y in zip(coder.encode_batch(texts), library.encode_batch(texts, add_special_tokens=False)))
    assert all(same([f"a{c}b" for c in points[k : k + 50_000]]) for k in range(0, len(points), 50_000))
    rng = random.Random(1)
    some = lambda: rng.choice([chr(rng.randrange(32, 127)), chr(rng.randrange(0x300)), chr(rng.randrange(0x300, 0x370)), rng.choice(points), " ", "'s", "<|endoftext|>"])
    assert same(["".join(some() for _ in range(rng.randrange(60))) for _ in range(3000)])


def test_bpe_keeps_few_words(monkeypatch):
    coder = bpe.TrieBpe(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())
    texts = [" ".join(f"w{'abcdefgh'[k % 8]}{'qrstuv'[k * j % 6]}x" for j in range(9)) + f" {chr(97 + k % 26) * 3} the end" for k in range(300)]
    whole = coder.encode_batch(texts)
    monkeypatch.setattr(bpe, "WORDS_KEPT", 20)
    monkeypatch.setattr(bpe, "PAIRS_KEPT", 5)
    monkeypatch.setattr(bpe, "STEPS_KEPT", 5)
    monkeypatch.setattr(bpe, "CHUNK_WORDS", 30)
    monkeypatch.setattr(bpe, "PART_CHARS", 5)
    assert bpe.TrieBpe(open(P.path("word_bpe_49k.json"), encoding="utf-8").read()).encode_batch(texts) == whole


def test_media_round_trip(spark, docs):
    rows = media.fingerprints(docs, keep_media=True).collect()
    assert len(rows) == len(TEXTS)
    by_text = {}
    for r, (i, text) in zip(rows, TEXTS):
        raw = (text or "").encode()
        back = media.from_wav(bytes(r.wav))
        assert r.doc_id == i and r.n_bytes == len(raw) and back[: len(raw)] == raw and set(back[len(raw):]) <= {255} and len(back) == r.payload_bytes and len(back) % 576 == 0 and len(back)
        assert r.payload_sha256 == hashlib.sha256(back).hexdigest() and r.tail_crc32 == zlib.crc32(back[-32:]) and r.media_sha256 == hashlib.sha256(bytes(r.wav)).hexdigest()
        assert by_text.setdefault(text or "", (r.time_codes, r.pair_codes)) == (r.time_codes, r.pair_codes)
    assert media.fingerprints(docs.limit(0)).count() == 0


def test_media_peaks_against_a_plain_transform():
    samples = media.payload("Some words, and then some other words. " * 40)
    x = np.frombuffer(samples, np.uint8).astype(float) - 128
    for k, tops in enumerate(media.peaks(samples)):
        frame = x[k * media.HOP : k * media.HOP + media.FRAME] * np.hanning(media.FRAME)
        n = np.arange(media.FRAME)
        power = np.array([abs((frame * np.exp(-2j * np.pi * f * n / media.FRAME)).sum()) for f in range(media.FRAME // 2 + 1)])
        local = [f for f in range(1, media.FRAME // 2) if power[f] > power[f - 1] and power[f] >= power[f + 1] and power[f] > media.FLOOR]
        assert tops[0] == (max(local, key=lambda f: power[f]) if local else 0)
        strong = sorted(local, key=lambda f: -power[f])[: media.PEAKS]
        assert [power[f] for f in tops if f] == pytest.approx([power[f] for f in strong], rel=1e-4)


def test_media_pairs_against_brute_force(spark):
    tops = media.peaks(media.payload("Once upon a time, some words. " * 30))
    expected = []
    for t, row in enumerate(tops):
        for d in range(media.REACH + 1):
            for a, f in enumerate(row):
                for g in row[a + 1 :] if d == 0 else tops[t + d, :1] if t + d < len(tops) else []:
                    if f and g:
                        expected.append((t, int(f) * 4096 + int(g) * 8 + d))
    times, codes = media.pairs(tops)
    assert list(zip(times.tolist(), codes.tolist())) == expected and len(expected) > 5 * len(tops)
    row = media.fingerprints(spark.createDataFrame([(1, "Once upon a time, some words. " * 30)], "doc_id long, text string")).first()
    assert list(zip(row.time_codes, row.pair_codes)) == expected


def merkle(text):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return sha("2" + "".join(sha("1" + "".join(sha("0" + p) for p in s.split("\n"))) for s in text.split("\n\n")))


def brute_likeness(a, b):
    if a == b:
        return 1.0
    both = lambda x, y: zip(x.split("\n"), y.split("\n"))
    cut = lambda x: [x[k : k + fingerprint.LEAF] for k in range(0, len(x), fingerprint.LEAF)]
    same = 0
    for s, t in zip(a.split("\n\n"), b.split("\n\n")):
        same += len(s) if s == t else sum(len(p) if p == q else sum(len(x) for x, y in zip(cut(p), cut(q)) if x == y) for p, q in both(s, t))
    return same / max(len(a), len(b))


def brute_places(a, b):
    out, x, y = set(), a.split("\n\n"), b.split("\n\n")
    for k in range(max(len(x), len(y))):
        s, t = (x[k].split("\n") if k < len(x) else []), (y[k].split("\n") if k < len(y) else [])
        out |= {(k, j) for j in range(max(len(s), len(t))) if (s[j : j + 1] or None) != (t[j : j + 1] or None)}
    return out


def test_fingerprints_against_brute_force(spark, docs):
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r.tie))
    got = {}
    for r in fingerprint.fingerprints(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(TEXTS)
    for k, (i, text, _) in enumerate(order):
        after = order[(k + 1) % len(order)].text
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        r = next(r for r in got[i] if r.fingerprint == merkle(text))
        assert r.n_chars == len(text) and r.edited_fingerprint == merkle(edited) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - brute_likeness(text, edited)) < 1e-9 and abs(r.near_next - brute_likeness(text, after)) < 1e-9
        assert {tuple(x) for x in r.edited_places} == brute_places(text, edited)
    assert fingerprint.fingerprints(docs.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_next_document_over_many_ranges(spark, kind):
    rows = spark.range(0, 5000).select(F.when(F.col("id") > 20, F.col("id") * F.col("id") % 99991).cast(kind).alias("doc_id"), F.col("id").cast("string").alias("text"))
    tie = {r.text: r.tie for r in rows.select("text", F.xxhash64("text").alias("tie")).collect()}
    got = {(r.doc_id, r.text): r.next_text for r in fingerprint.with_next(rows).collect()}
    order = sorted(got, key=lambda x: (x[0] is None, 0 if x[0] is None else x[0], tie[x[1]]))
    assert len(got) == 5000 and all(got[a] == b[1] for a, b in zip(order, order[1:] + order[:1]))


def test_differing_branches(spark):
    row = spark.sql("select 'a\nb\n\nc\nd' as x, 'a\nB\n\nc\nd' as y").select(fingerprint.differing(fingerprint.sections(F.col("x")), fingerprint.sections(F.col("y"))).alias("d")).first()
    assert [(d.section, d.paragraph) for d in row.d] == [(0, 1)]


def test_token_counts_follow_edits(spark, docs):
    edits = "array<struct<start:int,end:int,new:string>>"
    rows = docs.withColumn("edits", F.expr(f"cast(array(struct(3, 9, ' new  text'), struct(0, 0, 'x'), struct(100000, 200000, '!')) as {edits})"))
    counter = token_counts.Counter(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    got = {}
    for r in token_counts.count_edits(rows, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect():
        got.setdefault(r.doc_id, set()).add((r.n_tokens, r.n_tokens_edited))
    for i, text in TEXTS:
        t = text or ""
        after = t[:3] + " new  text" + t[9:]
        after = "x" + after + "!"
        count = lambda s: len(counter.encoding.encode_ordinary(s))
        assert (count(t), count(after)) in got[i]


@pytest.mark.parametrize("leaf", [4, 64])
def test_token_tree_on_random_edits(monkeypatch, leaf):
    """Totals and pre-tokens as of the whole text; only the edit's region is counted and only its leaves' paths summed."""
    monkeypatch.setattr(token_counts, "LEAF", leaf)
    counter = token_counts.Counter(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    rng = random.Random(7)
    parts = ["a", "B ", "  ", "\n", "12", "'s", "!", "é", "word "]
    for size in (0, 1, 3000):
        text = "".join(rng.choice(parts) for _ in range(size))
        tree = token_counts.Tree(text, counter)
        for _ in range(150):
            a = rng.randrange(-2, len(text) + 3)
            b, new = a + rng.choice([0, 1, 5, 200]), "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 30])))
            start = max(0, min(a, len(text)))
            gone = counter.split.findall(text[start : max(start, b)])
            text = text[:start] + new + text[max(start, min(b, len(text))) :]
            tree.replace(a, b, new)
            assert tree.text() == text and tree.total == len(counter.encoding.encode_ordinary(text))
            assert [n for x in tree.leaves() for n in x.lengths] == [len(x) for x in counter.split.findall(text)]
            assert tree.counted <= len(counter.split.findall(new)) + 8
            assert (tree.root.chars, sum(x.tokens for x in tree.leaves())) == (len(text), tree.total)
            leaves_met, depth = 4 + (len(gone) + tree.counted) * 2 // leaf, 2 * tree.n_leaves.bit_length() + 6
            assert tree.summed <= leaves_met * depth + tree.n_leaves  # the last: planted anew


def test_edits_of_long_texts_touch_few_sums():
    counter = token_counts.Counter(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    tree, rng = token_counts.Tree(" ".join(f"word{k}" for k in range(60_000)), counter), random.Random(8)
    for _ in range(300):
        a = rng.randrange(tree.root.chars)
        tree.replace(a, a + rng.choice([0, 3]), "x y")
        assert tree.counted <= 10 and tree.summed <= 60
    for _ in range(3000):  # all in one place
        tree.replace(200_000, 200_000, "typing ")
    assert tree.leaf_at(200_000)[2] <= 2 * tree.n_leaves.bit_length() + 4 and tree.total == len(counter.encoding.encode_ordinary(tree.text()))


def test_null_edits(spark):
    rows = [(1, "ab cd", [None, (2, None, " x"), (None, 1, None)]), (2, None, None), (3, "a", [None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,end:int,new:string>>")
    got = {r.doc_id: r for r in token_counts.count_edits(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    counter = token_counts.Counter(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    assert got[1].n_tokens_edited == len(counter.encoding.encode_ordinary("b x cd")) and (got[2].n_tokens_edited, got[3].n_summed) == (0, 0)


def test_word_count(spark, docs):
    got = {(r.doc_id, r.text): r.n for r in docs.select("doc_id", "text", word_count(F.col("text")).alias("n")).collect()}
    assert all(got[i, t] == len((t or "").encode().split()) for i, t in TEXTS)
