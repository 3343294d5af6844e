"""The pipeline against its stages by brute force."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tests.llm.test_corpus import brute_components, brute_targets
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output, with an extra column whose name clashes and rows that repeat."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"score": F.lit("own"), "copies": F.col("doc_id")})
    odd = [(9001, None, "en", "src0", 0, "own", 9001), (9002, "", None, None, 0, "own", 9002), (9003, "12 34 !!", "en", "src1", 8, "own", 9003)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).union(docs.limit(3))
    out, now = [], docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, SF)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        after.write.mode("overwrite").parquet(path)
        now_rows, now = now.collect(), spark.read.parquet(path)
        out.append((name, now_rows, now.collect()))
    return {name: (a, b) for name, a, b in out}


def test_filters_drop_what_they_reject_and_keep_the_rest(stages):
    for name in ("language_id", "quality"):
        before, after = stages[name]
        assert set(map(tuple, after)) <= set(map(tuple, before)) and all(r.score == "own" for r in after)
    before, after = stages["language_id"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert {9001, 9002, 9003} <= gone and len(gone) < 10


def test_one_of_each_group_stays(stages):
    before, after = stages["near_dedup"]
    expected = {c for _, c in brute_components([(r.doc_id, r.text) for r in before]).values()}
    assert Counter(r.doc_id for r in after) == Counter(expected)


def test_mix_meets_targets(stages):
    before, after = stages["mixing"]
    words = lambda r: len((r.text or "").encode().split())
    sizes, got, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r.source] += words(r)
        longest[r.source] = max(longest[r.source], words(r))
    for r in after:
        got[r.source] += words(r)
    target = brute_targets(sizes)
    assert all(abs(got[s] - target[s]) <= longest[s] / 2 + 1 for s in target)
    assert max(Counter(r.doc_id for r in after).values()) <= 3 and {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_mixed_documents_are_shuffled(spark):
    docs = spark.createDataFrame([(i, f"word {i}", f"src{i % 3}") for i in range(1500)], "doc_id long, text string, source string")
    rows = corpus_pipeline.mix_sources(spark, docs, SF).collect()
    share = [n / len(rows) for n in Counter(r.source for r in rows).values()]
    same = sum(a.source == b.source for a, b in zip(rows, rows[1:])) / len(rows)
    assert abs(same - sum(p * p for p in share)) < 0.08


def test_texts_are_encoded(stages):
    before, after = stages["bpe"]
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    expected = Counter()
    for r in before:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        expected[r.doc_id, hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in after) == expected


def test_run_is_the_stages_in_turn(spark, stages):
    rows = corpus_pipeline.run(spark, SF)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_dedup", "mixing", "bpe"]
    assert rows.count() > 0 and rows.columns[:2] == ["doc_id", "n_tokens"]
