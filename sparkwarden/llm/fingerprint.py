"""Merkle trees over the sections and paragraphs of documents.

Sections are parted by empty lines, paragraphs by line ends. A paragraph's digest is that of its text, a section's that
of its paragraphs' digests, the root that of the sections': equal roots mean equal texts, and differing branches tell
where two texts differ. The likeness of two trees is read off their branches: branches with equal digests at the same
place count with all their characters and are not entered; below two differing paragraphs, runs of LEAF characters at the
same place are compared. It is the share of characters so found in the larger text (1 for equal roots).

A null text is an empty one. Long texts are handled whole, at any size by the same rule. Ids may be of any type that can
be ordered; null ids come last, rows with equal ids are ordered by a hash of their text. Only built-in functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of the runs below a paragraph.
LEAF = 3
ROWS_PER_RANGE = 1_000
MAX_RANGES = 16_384


def sections(text: Column) -> Column:
    """Array of sections: digest, characters, and paragraphs (digest, text)."""

    def section(s: Column) -> Column:
        paragraphs = F.transform(F.split(s, "\n"), lambda p: F.struct(F.sha2(F.concat(F.lit("0"), p), 256).alias("digest"), p.alias("text")))
        digest = F.sha2(F.concat(F.lit("1"), F.array_join(F.transform(paragraphs, lambda p: p["digest"]), "")), 256)
        return F.struct(digest.alias("digest"), F.char_length(s).alias("n"), paragraphs.alias("paragraphs"))

    return F.transform(F.split(text, "\n\n"), section)


def root(tree: Column) -> Column:
    """The digest of a tree, in hexadecimal."""
    return F.sha2(F.concat(F.lit("2"), F.array_join(F.transform(tree, lambda s: s["digest"]), "")), 256)


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, b: a + b)


def _alike(p: Column, q: Column) -> Column:
    """Characters of the runs that two texts have at the same place."""
    runs = lambda x: F.regexp_extract_all(x, F.lit(f"(?s).{{1,{LEAF}}}"), F.lit(0))
    return _sum(F.zip_with(runs(p), runs(q), lambda x, y: F.when(x == y, F.char_length(x)).otherwise(0)))


def likeness(tree_a: Column, n_a: Column, tree_b: Column, n_b: Column) -> Column:
    """Of two trees, over texts of n_a and n_b characters."""

    def paragraph(p: Column, q: Column) -> Column:
        return F.when(p.isNull() | q.isNull(), F.lit(0)).when(p["digest"] == q["digest"], F.char_length(p["text"])).otherwise(_alike(p["text"], q["text"]))

    def section(s: Column, t: Column) -> Column:
        return F.when(s.isNull() | t.isNull(), F.lit(0)).when(s["digest"] == t["digest"], s["n"]).otherwise(_sum(F.zip_with(s["paragraphs"], t["paragraphs"], paragraph)))

    most = F.greatest(n_a, n_b)
    return F.when(root(tree_a) == root(tree_b), F.lit(1.0)).when(most == 0, F.lit(0.0)).otherwise(_sum(F.zip_with(tree_a, tree_b, section)) / most)


def differing(tree_a: Column, tree_b: Column) -> Column:
    """Where two trees differ: array of (section, paragraph), from 0; sections with equal digests are not entered."""
    none = F.array().cast("array<struct<section:int,paragraph:int>>")
    digest = lambda ps, j: F.get(ps, j)["digest"]

    def within(k: Column, a: Column, b: Column) -> Column:
        longest = F.greatest(F.coalesce(F.size(a["paragraphs"]), F.lit(0)), F.coalesce(F.size(b["paragraphs"]), F.lit(0)))
        at = F.transform(F.sequence(F.lit(0), F.greatest(longest, F.lit(1)) - 1), lambda j: F.struct(k.alias("section"), j.alias("paragraph")))
        return F.filter(at, lambda x: ~digest(a["paragraphs"], x["paragraph"]).eqNullSafe(digest(b["paragraphs"], x["paragraph"])))

    longest = F.greatest(F.size(tree_a), F.size(tree_b))
    places = F.transform(F.sequence(F.lit(0), longest - 1), lambda k: F.when(digest(tree_a, k).eqNullSafe(digest(tree_b, k)), none).otherwise(within(k, F.get(tree_a, k), F.get(tree_b, k))))
    return F.flatten(places)


def with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with `next_text`: the text of the next document by ascending doc_id (null last, ties by a hash
    of the text); the last is followed by the first. Documents are dealt to ranges, and each range also gets the first
    document of the next one, so that no task sees more than a range. Only rows equal in id and text stay together."""
    kind = docs.schema["doc_id"].dataType
    n = max(1, min(MAX_RANGES, -(-docs.count() // ROWS_PER_RANGE)))
    rows = docs.select("doc_id", "text", F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie")).alias("_key"))
    if n > 1:
        dealt = rows.select("_key").repartitionByRange(n, "_key")
        ends = sorted(r["_key"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.max("_key").alias("_key")).collect())[:-1]  # n - 1 at most
        key = lambda e: F.struct(F.lit(e["last"]).alias("last"), F.lit(e["id"]).cast(kind).alias("id"), F.lit(e["tie"]).cast("long").alias("tie"))
        width = max(1, math.isqrt(n))
        coarse = [ends[k : k + width] for k in range(0, len(ends), width)]
    else:
        coarse = []
    if coarse:
        above = F.size(F.filter(F.array(*[key(c[-1]) for c in coarse]), lambda b: b < F.col("_key")))
        fine = F.get(F.array(*[F.array(*map(key, c)) for c in coarse]), above)
        part = above * width + F.coalesce(F.size(F.filter(fine, lambda b: b < F.col("_key"))), F.lit(0))
    else:
        part = F.lit(0)
    rows = rows.withColumn("_part", part.cast("int"))
    order = Window.orderBy("part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = rows.groupBy(F.col("_part").alias("part")).agg(F.min("_key").alias("first"))  # n rows at most
    firsts = firsts.withColumn("before", F.coalesce(F.lag("part").over(order), F.max("part").over(whole)))
    found = rows.join(F.broadcast(firsts), (F.col("_part") == F.col("part")) & (F.col("_key") == F.col("first")))
    guests = found.groupBy("before").agg(F.first("_key").alias("_key"), F.first("text").alias("text")).select(F.col("before").alias("_part"), "_key", "text", F.lit(True).alias("_guest"))
    both = rows.select("_part", "_key", "text", F.lit(False).alias("_guest")).unionByName(guests)
    follows = Window.partitionBy("_part").orderBy("_guest", "_key")
    return both.withColumn("next_text", F.lead("text").over(follows)).filter(~F.col("_guest")).select(F.col("_key.id").alias("doc_id"), "text", "next_text")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its tree's root, that of its text with the last quarter replaced by the beginning of the next
    document, the likeness of its tree to that text's and to the next document's, and where it differs from the first."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - quarter)
    rows = rows.withColumn("edited", F.concat(kept, F.substring(F.col("next_text"), F.lit(1), quarter)))
    rows = rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.char_length("edited").alias("_m"), F.char_length("next_text").alias("_n"),
        sections(F.col("text")).alias("_own"), sections(F.col("edited")).alias("_edited"), sections(F.col("next_text")).alias("_next"),
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", root(F.col("_own")).alias("fingerprint"), root(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("n_chars"), F.col("_edited"), F.col("_m")).alias("near_edited"),
        likeness(F.col("_own"), F.col("n_chars"), F.col("_next"), F.col("_n")).alias("near_next"),
        differing(F.col("_own"), F.col("_edited")).alias("edited_places"),
    )
