"""Spelling variants: which words of a corpus differ by one inserted, deleted or replaced character, and which word of
many more occurrences does each of them stand for?

Pairs are found by a pigeonhole join with an even partition. A word is indexed by its two halves (the first is the shorter
one, so that the cut depends on the length alone). One edit leaves one half whole, so a word of equal length has it at
the same place, and a word that is one longer has it at its start (first half) or, shifted by one, at its end (second half).
What is left beside the half is verified by edit distance. A half that many words have is split on: what is left beside it
has halves of its own, one of which is whole again. This goes on until no key has more than CROWD words, which ends at
the latest where one character is left, so crowded keys cost no candidates in the square of their words and lose none.

Results in the edge cases: a null text has no words, a null id counts as an empty one, an empty table gives no rows. A row
that is repeated counts again. Other columns are not read. Texts are taken whole, however long.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import materialize

#: Letters of a word, as a class of regular expressions.
LETTERS = r"[A-Za-zÀ-ÿ]"
#: Least characters of a word, and least occurrences.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: So many times a word's occurrences its form must have.
TIMES = 10
#: One run in so many (by checksum) loses a character.
DAMAGED = 31
#: Words of a key beyond which the key is split on; no less than there are letters.
CROWD = 128


def words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words that occur often enough, after some runs have lost a character by the checksum of id and run."""
    runs = F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(LETTERS + "{" + str(LEAST_LENGTH) + ",}"), F.lit(0)))
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), runs.alias("run"))
    lowered = each.select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    summed = lowered.withColumn("sum", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("sum") % F.char_length("run")).cast("int")
    damaged = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("sum") % DAMAGED == 0, damaged).otherwise(F.col("run"))
    return summed.select(word.alias("word")).filter(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _halves(rest: Column, length: Column, key: Column) -> Column:
    """Both (key, rest) of what is left of a word: its start and its end, as long as the halves of a word of `length`."""
    first = F.floor(length / 2).cast("int")
    second = (length - first).cast("int")
    return F.array(
        F.struct(F.concat(key, F.lit("1"), F.substring(rest, F.lit(1), first)).alias("key"), F.substring(rest, first + 1, F.char_length(rest)).alias("rest")),
        F.struct(F.concat(key, F.lit("2"), F.right(rest, second)).alias("key"), F.substring(rest, F.lit(1), F.char_length(rest) - second).alias("rest")),
    )


def _split(entries: DataFrame) -> DataFrame:
    """Entries (size, longer, key, rest, word, n) with each key split on into two."""
    length = F.char_length("rest") - F.col("longer").cast("int")
    split = entries.withColumn("half", F.explode(_halves(F.col("rest"), length, F.col("key"))))
    return split.select("size", "longer", "half.key", "half.rest", "word", "n")


def _verified(entries: DataFrame) -> DataFrame:
    """Pairs (u, nu, v, nv) of entries that share a key and are one edit apart beside it; v is probed."""
    index = entries.filter(~F.col("longer")).select("size", "key", F.col("rest").alias("ru"), F.col("word").alias("u"), F.col("n").alias("nu"))
    probe = entries.select("size", "key", "longer", F.col("rest").alias("rv"), F.col("word").alias("v"), F.col("n").alias("nv"))
    near = index.join(probe, ["size", "key"]).filter(F.col("longer") | (F.col("u") < F.col("v"))).filter(F.levenshtein("ru", "rv", 1) == 1)
    return near.select("u", "nu", "v", "nv")


def near_pairs(counted: DataFrame) -> DataFrame:
    """words (word, n) -> (u, nu, v, nv): each pair of words that one edit makes equal, once; v is not the shorter one."""
    size = F.char_length("word")
    own = counted.select(size.alias("size"), F.lit(False).alias("longer"), F.lit("").alias("key"), F.col("word").alias("rest"), "word", "n")
    shorter = counted.filter(size > LEAST_LENGTH).select((size - 1).alias("size"), F.lit(True).alias("longer"), F.lit("").alias("key"), F.col("word").alias("rest"), "word", "n")
    entries, found = _split(own.unionByName(shorter)), []
    while True:
        keys = entries.groupBy("size", "key").agg(F.count_if(~F.col("longer")).alias("words"))
        crowded = materialize(keys.filter(F.col("words") > CROWD).select("size", "key"), "crowded-keys")
        if crowded.isEmpty():
            break
        found.append(_verified(entries.join(crowded, ["size", "key"], "left_anti")))
        entries = materialize(_split(entries.join(crowded, ["size", "key"], "left_semi")), "split-keys")
    found.append(_verified(entries))
    return reduce(DataFrame.unionByName, found).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): the last word that forms lead to. Each round doubles the steps."""
    reached = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        if reached.join(further, "root", "left_semi").isEmpty():
            return reached
        reached = materialize(reached.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "roots")


def variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, n, n_near (near words), form (its near word of most occurrences, if TIMES as many as its
    own; of equal ones the least by code points), form_n, root (the end of its forms; itself without one)."""
    counted = materialize(words(docs, id_col=id_col, text_col=text_col), "words")
    both = F.explode(F.array(
        F.struct(F.col("u").alias("word"), F.struct((-F.col("nv")).alias("less"), F.col("v").alias("near")).alias("best")),
        F.struct(F.col("v").alias("word"), F.struct((-F.col("nu")).alias("less"), F.col("u").alias("near")).alias("best")),
    ))
    near = near_pairs(counted).select(both.alias("side")).groupBy("side.word").agg(F.count("*").alias("n_near"), F.min("side.best").alias("best"))
    most = -F.col("best.less")
    known = counted.join(near, "word", "left").withColumn("stands", most >= TIMES * F.col("n"))
    formed = materialize(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("stands"), F.col("best.near")).alias("form"), F.when(F.col("stands"), most).alias("form_n")), "forms")
    ends = roots(formed.filter(F.col("form").isNotNull()))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle_sql() -> str:
    """DuckDB SQL of variants(documents), by another way: words that share a pattern with one character cut or blanked."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ 0xEDB88320 * (byte & 1)
        table.append(byte)
    hexed = "0123456789ABCDEF"
    byte = f"(instr('{hexed}', substr(h, 2 * i + 1, 1)) - 1) * 16 + instr('{hexed}', substr(h, 2 * i + 2, 1)) - 1"
    return f"""
WITH RECURSIVE crc AS (SELECT {table}::BIGINT[] AS t),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
lowered AS (SELECT id, translate(run, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS run, count(*) AS k FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
hexes AS (SELECT *, hex(encode(id || ':' || run)) AS h FROM lowered),
sums AS (SELECT run, k, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ({byte})::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS s FROM hexes, crc),
cut AS (SELECT CASE WHEN s % {DAMAGED} = 0 THEN substr(run, 1, s % length(run)) || substr(run, s % length(run) + 2) ELSE run END AS word, k FROM sums),
counted AS (SELECT word, sum(k)::BIGINT AS n FROM cut WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM counted),
blanked AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS pattern FROM places),
shortened AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS pattern FROM places),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM blanked a JOIN blanked b ON a.pattern = b.pattern AND a.word <> b.word
  UNION ALL SELECT a.word, b.word, b.n FROM shortened a JOIN counted b ON a.pattern = b.word
  UNION ALL SELECT b.word, a.word, a.n FROM shortened a JOIN counted b ON a.pattern = b.word),
best AS (SELECT word, count(*) AS n_near, min({{'less': -other_n, 'other': other}}) AS b FROM near GROUP BY word),
formed AS (SELECT c.word, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= {TIMES} * c.n THEN b.other END AS form, CASE WHEN -b.less >= {TIMES} * c.n THEN -b.less END AS form_n FROM counted c LEFT JOIN best USING (word)),
steps AS (SELECT word, form AS root, 1 AS k FROM formed WHERE form IS NOT NULL UNION ALL SELECT s.word, f.form, k + 1 FROM steps s JOIN formed f ON f.word = s.root WHERE f.form IS NOT NULL),
ends AS (SELECT word, max_by(root, k) AS root FROM steps GROUP BY word)
SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, f.n_near, f.form_n FROM formed f LEFT JOIN ends e USING (word)
"""
