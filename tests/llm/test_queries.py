"""The registered queries themselves, on the smallest tables, against SQL, libraries and brute force."""

import hashlib
import zlib
from collections import Counter

import duckdb
import public_tokenizers as P
import pytest
from tests.llm.test_corpus import brute_components, brute_rule, brute_targets
from tests.llm.test_texts import brute_likeness, merkle
from tokenizers import Tokenizer

from sparkwarden.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text, lang, source from '{SF}/documents.parquet' order by doc_id").fetchall()


def rows(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_near_duplicates(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows(spark, "op1_minhash")}
    assert got == brute_components([(i, t) for i, t, *_ in docs])


def test_mixing_targets_by_sql(spark):
    """Targets in SQL: sources over their cap are taken out one round after another."""
    sizes = duckdb.sql(f"select source, sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) as n from '{SF}/documents.parquet' group by 1").fetchall()
    target = brute_targets({s: int(n) for s, n in sizes})
    got = rows(spark, "op2_mixing")
    taken = Counter()
    for r in got:
        taken[r.source_size, round(r.target, 6)] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    assert {round(r.target, 4) for r in got} == {round(t, 4) for t in target.values()} and {r.source_size for r in got} == {int(n) for _, n in sizes}
    assert all(abs(n - t) <= 1 for (_, t), n in taken.items())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_mixing_draws_for_every_source(spark, monkeypatch, sf):
    """Blocks that are drawn for: several of each source, at any size; quotas and shards add up."""
    seen = []

    def drawn(cells, n_shards, seed, draw=queries.mixing.draw_cells):
        seen.extend(draw(cells, n_shards, seed))
        return seen
    monkeypatch.setattr(queries.mixing, "draw_cells", drawn)
    got = queries.QUERIES["op2_mixing"](spark, f"/root/testdata/{sf}").groupBy("source_size", "target").agg({"taken": "sum"}).collect()
    blocks = Counter(source for source, *_ in seen)
    assert len(blocks) == 20 and min(blocks.values()) > 1 and len(seen) <= 2 * queries.mixing.MAX_BLOCKS
    assert all(abs(r["sum(taken)"] - r.target) <= 1 for r in got)


def test_token_counts(spark, docs):
    from sparkwarden.llm.token_counts import Counter as Pieces
    counter = Pieces(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    count = lambda s: len(counter.encoding.encode_ordinary(s))
    got = {r.doc_id: r for r in rows(spark, "op3_token_counts")}
    for i, text, *_ in docs:
        t = text or ""
        n = len(t)
        e = t[: n // 2] + t[:40] + t[n // 2 :]
        cut = n * 3 // 4
        e = e[:cut] + e[cut + 1 :] + " It ends here."
        assert (got[i].n_tokens, got[i].n_tokens_edited) == (count(t), count(e))


def test_predictions(spark, docs):
    lang = {r.doc_id: r for r in rows(spark, "op4_language_id")}
    good = {r.doc_id: r for r in rows(spark, "op5_quality")}
    assert set(lang) == set(good) == {i for i, *_ in docs}
    for i, text, *_ in docs:
        held = zlib.crc32(str(i).encode()) % 5 == 0
        assert lang[i].held_out == held == good[i].held_out and (lang[i].lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        assert 0 <= lang[i].score <= 1 and 0 <= good[i].score <= 1 and good[i].predicted == (good[i].score >= 0.3)


def test_bpe(spark, docs):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in rows(spark, "op6_bpe")}
    for i, text, *_ in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_fingerprints_by_sql(spark, docs):
    edited = dict(duckdb.sql(f"""with d as (select doc_id, coalesce(text, '') as t from '{SF}/documents.parquet'),
     n as (select *, coalesce(lead(t) over (order by doc_id), first_value(t) over (order by doc_id)) as nx from d)
     select doc_id, sha256(t[1:length(t) - length(t) // 4] || nx[1:length(t) // 4]) from n""").fetchall())
    texts = [t or "" for _, t, *_ in docs]
    for r, (i, *_), t, after in zip(sorted(rows(spark, "op8_fingerprints"), key=lambda r: r.doc_id), docs, texts, texts[1:] + texts[:1]):
        q = len(t) // 4
        e = t[: len(t) - q] + after[:q]
        assert r.doc_id == i and r.edited_sha256 == edited[i] and (r.fingerprint, r.edited_fingerprint) == (merkle(t), merkle(e))
        assert abs(r.near_edited - brute_likeness(t, e)) < 1e-9 and abs(r.near_next - brute_likeness(t, after)) < 1e-9
        assert bool(r.edited_places) == (t != e)


def test_media(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op9_media")}
    for i, text, *_ in docs:
        raw = (text or "").encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert len(r.time_codes) == len(r.pair_codes) and r.media_bytes > r.payload_bytes


def test_url_rules(spark):
    pages = duckdb.sql(f"select page_id, url from '{SF}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in rows(spark, "op10_url_filter")}
    assert len(got) == len(pages)
    for i, url in pages:
        host, path, rule, verdict = brute_rule(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule) and got[i].verdict in ("allow", "block") and verdict in (None, got[i].verdict)
