"""The registered queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm import bpe, fingerprint, language_id, media, minhash, mixing, packing, quality, sharding, spelling, token_counts, url_filter, vector_codes
from sparkwarden.llm.common import held_out, read, utf8, word_count

BPE_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
COUNT_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each text and of its edited form: the first words put again before its middle, a character deleted
    three quarters in, and a sentence put at the end."""
    n, text = F.coalesce(F.char_length("text"), F.lit(0)), F.coalesce("text", F.lit(""))
    edit = lambda a, b, new: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), new.alias("new"))
    edits = F.array(
        edit(F.floor(n / 2), F.floor(n / 2), F.substring(text, 1, 40)),
        edit(F.floor(n * 3 / 4), F.floor(n * 3 / 4) + 1, F.lit("")),
        edit(n + 40, n + 40, F.lit(" It ends here.")),
    )
    docs = read(spark, sf_dir, "documents").withColumn("edits", edits)
    return token_counts.count_edits(docs, COUNT_RANKS, public_tokenizers.PATTERN)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = language_id.identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), language_id.fit(docs))
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = quality.score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), quality.fit(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", "held_out", "score", "predicted")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), BPE_VOCABULARY, keep_ids=False, keep_decoded=False)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and checksums are read from the texts of the shards, which shard() has written."""
    out, text = sharding.shard(read(spark, sf_dir, "documents"), 8), utf8(F.col("text"))
    size = (F.octet_length(text) + 1).cast("long")
    return out.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(read(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.fingerprints(read(spark, sf_dir, "documents"))
    code = F.sha2(F.to_json(F.struct("time_codes", "pair_codes")), 256)
    feature = F.concat_ws(":", F.col("n_frames").cast("string"), F.size("pair_codes").cast("string"), code)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "time_codes", "pair_codes")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that rules are mined from are the fixed rules' own verdicts: no table labels pages."""
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), BPE_VOCABULARY)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = vector_codes.compress(read(spark, sf_dir, "embeddings"))
    text = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(vector_codes.PARTS)), lambda i: F.lower(F.hex(F.substring("code", i, 1)))))
    return coded.select("vec_id", text.alias("code"), "error", "label_error", F.lit(vector_codes.digest(codebooks)).alias("codebooks_sha256"))


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_mixing": op2_mixing,
    "op3_token_counts": op3_token_counts,
    "op4_language_id": op4_language_id,
    "op5_quality": op5_quality,
    "op6_bpe": op6_bpe,
    "op7_sharding": op7_sharding,
    "op8_fingerprints": op8_fingerprints,
    "op9_media": op9_media,
    "op10_url_filter": op10_url_filter,
    "op11_spelling": op11_spelling,
    "op12_packing": op12_packing,
    "op13_vector_codes": op13_vector_codes,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {"op11_spelling": spelling.oracle_sql(), "op13_vector_codes": vector_codes.oracle_sql(64)}
