"""Spelling variants, packing and vector codes against brute force, libraries and SQL, edge cases included."""

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkwarden.llm import packing, queries, spelling, vector_codes

SF = "/root/testdata/sf0.001"


def brute_words(docs):
    count = Counter()
    for i, text in docs:
        for run in regex.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(docs):
    n = brute_words(docs)
    out = {}
    for w in n:
        near = [v for v in n if one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        out[w] = (best if best and n[best] >= 10 * n[w] else None, n[w], len(near))
    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w
    return {w: (form, root(w), k, near, n[form] if form else None) for w, (form, k, near) in out.items()}


def got_variants(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def near_words(rng, n, letters, least=7, most=10):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(least, most))) for _ in range(n)]


@pytest.mark.parametrize("crowd", [3, 128])
def test_variants_by_brute_force(spark, monkeypatch, crowd):
    """Two letters only: with a crowd of three, keys are split on down to one character."""
    monkeypatch.setattr(spelling, "CROWD", crowd)
    rng = random.Random(5)
    pool = near_words(rng, 150, "ab")
    weights = [rng.choice([1, 3, 40, 500]) for _ in pool]
    docs = [(k, " ".join(rng.choices(pool, weights, k=60))) for k in range(200)]
    got = got_variants(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string")))
    want = brute_variants(docs)
    assert got == want and any(v[0] and v[1] != v[0] for v in want.values()) and max(v[3] for v in want.values()) > 5


def test_variants_edge_cases(spark):
    text = "Straße ÀÉÎÕÜÿ× élèves-élèves abcdefgh'abcdefgh ABCDEFGH " + "x" * 3000 + " " + "x" * 3000
    docs = [(1, text), (1, text), (None, "abcdefgi abcdefgi"), (2, None), (3, ""), (4, "short w0rds1234567")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit("no"), "key": F.lit(0), "n": F.lit("x")})
    assert got_variants(spelling.variants(df)) == brute_variants(docs)
    assert spelling.variants(df.limit(0)).collect() == []
    one = spark.createDataFrame([("a", "zzzzzzz zzzzzzz"), ("b", "zzzzzzy zzzzzzy zzzzzzx zzzzzzx")], "doc_id string, text string")
    assert got_variants(spelling.variants(one)) == brute_variants([("a", "zzzzzzz zzzzzzz"), ("b", "zzzzzzy zzzzzzy zzzzzzx zzzzzzx")])


def sql(text):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    found = con.execute(text)
    names = [d[0] for d in found.description]
    return sorted((tuple(sorted(zip(names, map(str, r), strict=True))) for r in found.fetchall()))


@pytest.mark.parametrize("name", ["op11_spelling", "op13_vector_codes"])
def test_registered_queries_by_sql(spark, name):
    rows = queries.QUERIES[name](spark, SF).collect()
    assert rows and sorted(tuple(sorted((k, str(v)) for k, v in r.asDict().items())) for r in rows) == sql(queries.ORACLES[name])


def check_pieces(rows, docs):
    """Each id lies in one piece, sequences are gapless and full but the last of a shard. docs: id -> list of texts."""
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    wanted = Counter()
    for i, texts in docs.items():
        for text in texts:
            wanted[i, np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for (i, ids), copies in wanted.items():
        own = [r for r in pieces[i] if r.doc_tokens * 4 == len(ids) and zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32]
        covered = Counter()
        for r in own:
            covered.update(range(r.start, r.start + r.length))
        assert set(covered) == set(range(len(ids) // 4)) and set(covered.values()) == {copies}
        for r in own:
            pieces[i].remove(r)
    assert not any(pieces.values())
    short = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        short += at < 2048
    return short


def test_packing_as_registered(spark):
    docs = dict(duckdb.sql(f"select doc_id, [text] from '{SF}/documents.parquet'").fetchall())
    rows = queries.op12_packing(spark, SF).collect()
    assert check_pieces(rows, docs) <= 1
    assert {r.role for r in rows} == {"whole", "seed", "neighbour"}


def test_packing_edge_cases(spark):
    long = "many words of one text, " * 9000
    docs = [(1, "a b"), (1, "a b"), (None, "c"), (2, None), (3, ""), (4, long), (4, long), (5, "<|endoftext|> Ünï ﬁ " + "x" * 9000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"ids": F.lit(1), "start": F.lit("s"), "offset": F.lit(2)})
    by = defaultdict(list)
    for i, t in docs:
        by[i].append(t)
    rows = packing.pack(df, P.path("word_bpe_49k.json")).collect()
    assert check_pieces(rows, by) <= 1
    assert packing.pack(df.limit(0), P.path("word_bpe_49k.json")).collect() == []
    alike = spark.createDataFrame([("k", "x")] * 5000, "doc_id string, text string")
    assert check_pieces(packing.pack(alike, P.path("word_bpe_49k.json")).collect(), {"k": ["x"] * 5000}) <= 3


def test_words_of_the_library():
    """Words that are sent together get the ids that each text has alone, whatever stands in them."""
    coder, library = packing.LibraryWords(open(P.path("word_bpe_49k.json")).read()), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(3)
    odd = [chr(c) for c in [*range(32, 0x250), *range(0x300, 0x380), *range(0x3A0, 0x3FF), 0x130, 0x3A3, 0x2126, 0xFB01, 0x1F600, 0x4E2D] if chr(c).isprintable()]
    texts = ["".join(rng.choice(odd + [" "] * 60 + list("'s'tn't\n\t\x1c\xa0") + ["<|startoftext|>", "<|endoftext|>", " " + "y" * 300]) for _ in range(200)) for _ in range(300)]
    ids = coder.encode_batch(texts)
    assert all(np.frombuffer(x, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids for x, t in zip(ids, texts, strict=True))


def test_words_are_merged_in_arrays():
    """Words of up to 64 bytes get the library's ids without a call of it for each; longer ones are the library's."""
    coder, library = packing.LibraryWords(open(P.path("word_bpe_49k.json")).read()), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(11)
    runs = ["".join(rng.choice("etaoinschrpméü") for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    texts = [" ".join(rng.choice(runs) + rng.choice(["", "", ",", ".", "'s", "12", "&&&", "\t", "\xa0é"]) for _ in range(50)) for _ in range(200)]
    texts += [c * n for c in ("a", "é", "th", "1", "!", "'") for n in (1, 2, 31, 32, 33, 63, 64)]
    want = lambda t: library.encode(t, add_special_tokens=False).ids
    for long in ("x" * 65, "thé" * 5000):
        assert np.frombuffer(coder.encode_batch([long, "a " + long + " b"])[1], "<u4").tolist() == want("a " + long + " b")
    coder.library = None
    short = [t for t in texts if max(len(w.encode()) for w in t.split(" ")) <= 64]
    ids = coder.encode_batch(short)
    assert len(short) > 200 and all(np.frombuffer(x, "<u4").tolist() == want(t) for x, t in zip(ids, short, strict=True))


def brute_fill(rows, weight, mean):
    """The windows of one shard by scoring every unused row."""
    tf = [Counter(r) for r in rows]

    def score(seed, row):
        return sum(weight[t] * tf[row][t] * 2.2 / (tf[row][t] + 1.2 * (0.25 + 0.75 * len(rows[row]) / mean)) for t in tf[seed] if t in tf[row] and weight[t] > 0)

    unused, rest, out = list(range(len(rows))), None, []
    while unused or rest:
        row, at = rest or (unused.pop(0), 0)
        rest, room, window = None, packing.WINDOW, []
        seed = row
        while True:
            n = min(room, len(rows[row]) - at)
            window.append((row, at, n))
            room -= n
            if at + n < len(rows[row]):
                rest = (row, at + n)
            if not room or not unused:
                break
            row, at = min(unused, key=lambda r: (-round(score(seed, r), 9), r)), 0
            unused.remove(row)
        out.append(window)
    return out


def test_windows_hold_the_best_neighbours(monkeypatch):
    monkeypatch.setattr(packing, "WINDOW", 40)
    rng = np.random.default_rng(1)
    rows = [rng.integers(2 + 10 * (k % 5), 40 + 10 * (k % 5), rng.integers(1, 40)).astype("<u4") for k in range(90)]
    df = Counter(t for r in rows for t in set(r.tolist()))
    weight = np.zeros(100)
    for t, n in df.items():
        weight[t] = math.log((90 - n + 0.5) / (n + 0.5))
    got = defaultdict(list)
    for row, start, length, sequence, _offset, _score in packing.fill(rows, weight, 20.0):
        got[sequence].append((row, start, length))
    assert list(got.values()) == brute_fill([r.tolist() for r in rows], weight, 20.0)


def test_document_frequencies(spark):
    rests = spark.createDataFrame([(np.array(x, "<u4").tobytes(),) for x in ([5, 5, 7, 1], [7, 1], [900, 1])], "ids binary").repartition(3)
    assert {r.token: r.df for r in packing.document_frequencies(rests).collect()} == {5: 1, 7: 2, 900: 1, 1: 3, -1: 3, -2: 8}


def brute_codes(vectors, parts=16, entries=64, rounds=2):
    """vectors: rows (id, label, integers), ordered by id."""
    step = len(vectors[0][2]) // parts
    cut = [[v[p * step : (p + 1) * step] for p in range(parts)] for _, _, v in vectors]
    books = [[x[p] for x in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        at = [[near(x[p], books[p])[1] for p in range(parts)] for x in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [x[p] for x, a in zip(cut, at, strict=True) if a[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [[near(x[p], books[p]) for p in range(parts)] for x in cut]
    return [(bytes(k for _, k in f), sum(d for d, _ in f)) for f in found], books


@pytest.mark.parametrize("spread", [0.01, 3.0, 1e9, 1e30])
def test_codes_by_brute_force(spark, spread):
    """At 0.01 most parts are equal, so ties abound; at 1e9 and beyond, 64 bits do not hold the distances."""
    rng = np.random.default_rng(7)
    data = [(k, int(k) % 3 or None, (rng.normal(size=32) * spread).astype(np.float32).tolist()) for k in range(150)]
    rng.shuffle(data)
    df = spark.createDataFrame([(int(a), b, c) for a, b, c in data], "vec_id long, label int, embedding array<float>").repartition(5)
    coded, books = vector_codes.compress(df)
    kept = sorted((k, label, [int(np.floor(float(x) * 256)) for x in v]) for k, label, v in sorted(data, key=lambda r: r[0]))
    want, want_books = brute_codes(kept)
    got = {r.vec_id: r for r in coded.collect()}
    assert books == want_books
    fits = lambda x: x if x < 2**63 else None
    assert [(bytes(got[k].code), got[k].error) for k, *_ in kept] == [(c, fits(e)) for c, e in want]
    by_label = defaultdict(list)
    for (_, label, _), (_, e) in zip(kept, want, strict=True):
        by_label[label].append(e)
    sums = {label: fits(sum(e)) if all(fits(x) is not None for x in e) else None for label, e in by_label.items()}
    assert all(got[k].label_error == sums[label] for k, label, _ in kept)


def test_codes_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    good = [(3, "a", [1.0, -1.0] * 16), (3, "a", [1.0, -1.0] * 16), (None, None, [0.5] * 32), (1, None, [2.0] * 17)]
    bad = [(5, "a", None), (6, "a", [1.0, None]), (7, "a", [nan] * 32), (8, "a", [inf] * 32), (9, None, [-inf] * 32)]
    df = spark.createDataFrame(good + bad, "vec_id long, label string, embedding array<double>").withColumns({"code": F.lit(1), "vec": F.lit("v"), "error": F.lit(0)})
    coded, books = vector_codes.compress(df)
    rows = coded.collect()
    assert sorted(str(r.vec_id) for r in rows) == ["1", "3", "3", "None"] and all(r.error == 0 and r.label_error == 0 for r in rows)
    assert len({bytes(r.code) for r in rows if r.vec_id == 3}) == 1 and {len(b) for b in books} == {4}
    for none in (df.limit(0), df.filter("vec_id > 4"), spark.createDataFrame([(1, None, [])], "vec_id long, label string, embedding array<float>")):
        coded, _ = vector_codes.compress(none)
        assert [r.error for r in coded.collect()] in ([], [0])


def test_exponion_search_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(20):
        entries, points = rng.integers(-6, 6, (30, 3)), rng.integers(-9, 9, (500, 3))
        at, distance = vector_codes.exponion(points, entries, rng.integers(0, 30, 500))
        every = ((points[:, None] - entries[None]) ** 2).sum(-1)
        assert (at == every.argmin(1)).all() and (distance == every.min(1)).all()
