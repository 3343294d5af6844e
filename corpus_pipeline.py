"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Language ID and quality drop what they reject, near-dedup keeps one document of each group, mixing repeats or leaves out
documents so that sources meet their target weights, and the last stage encodes the texts and decodes them again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm import bpe, language_id, minhash, mixing, quality
from sparkwarden.llm.common import materialize, read, shared_dir, word_count
from sparkwarden.llm.queries import BPE_VOCABULARY


def _as_one(docs: DataFrame, *more) -> DataFrame:
    """docs with each row as one column, so that names of an operator's columns cannot clash with it."""
    return docs.select(F.struct([F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def _columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select([F.col(f"`{c}`") for c in names])


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models know; those without letters, or unlike all languages, go."""
    return language_id.identify(_as_one(docs, "text"), language_id.fit(docs)).filter(~F.col("rejected")).select("row.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be of quality 1."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(_as_one(docs, "text"), model).filter("predicted = 1").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each group of near-duplicates; of rows that share a doc_id, one. Rows without a
    doc_id stay, as no id names them."""
    found = materialize(minhash.near_duplicates(docs).select("doc_id", "kept"), "near-duplicates")
    again = found.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id")
    gone = materialize(found.filter(~F.col("kept")).select("doc_id").union(again).distinct(), "gone")
    repeated = materialize(again.join(found.filter("kept").select("doc_id").distinct(), "doc_id"), "repeated")
    few = F.broadcast if gone.count() <= minhash.MOST_BROADCAST else (lambda df: df)
    rest = docs.join(few(gone), "doc_id", "left_anti")
    if repeated.isEmpty():
        return _columns(rest, docs.columns)
    one = docs.join(few(repeated), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return _columns(rest, docs.columns).unionByName(_columns(one, docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the order of the output shards, each shuffled."""
    mixed = mixing.mix(_as_one(docs, "source", word_count(F.col("text")).alias("size")))
    return mixing.shuffle(mixing.expand(mixed)).select("row.*")


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and hashes of ids and of the text decoded from them."""
    return bpe.encode(docs, BPE_VOCABULARY, keep_decoded=False).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", keep_languages),
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

#: No stage can be told in SQL (trained models, hash draws, BPE); tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
