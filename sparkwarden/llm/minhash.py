"""Near-duplicate detection by MinHash with tensored banding, confirmed on full shingle sets.

A document's set: its distinct 5-word shingles (words: runs of other than ASCII space, A-Z in lower case), or the whole
sequence as one where there are fewer words; none without words. Two collections of HALF tuples of WIDTH minima each are
kept for a set; every pair of a tuple of one and a tuple of the other is the key of a table, so HALF * HALF tables need
only 2 * HALF * WIDTH minima. A pair of similarity s meets in some table with probability (1 - (1 - s^WIDTH)^HALF)^2:
all but 4e-5 at 0.75.

Work on candidates, none of which emits all pairs of a group:
- documents with equal sets are one node;
- tuples that no other set has make no keys;
- a set of which under 75 % of the shingles occur in another candidate has no link and goes (exact, two rounds);
- in each table, sets are compared with the table's least one; verified links join components;
- where a tuple's sets still are of several components, those outside its largest one are compared with all others:
  pair by pair in small groups, else in blocks of bounded size; only links that join components leave a block.

Null and empty texts have n_shingles 0 and stay alone. Ids are whole numbers or else text, of which the least by code
point is the component's. Rows that share a doc_id are one document: if their texts differ, it links both texts' groups
only where it is the least id of each, and each row tells the group of its own text. A row with a null id links nothing
and is no group's component; it is told the group of documents with an id that have its very words (then it is not
kept), else a null component (then it is kept). An empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import materialize, release_memory
from sparkwarden.llm.components import components
from sparkwarden.session import ship_package

SHINGLE = 5
#: A link needs PERCENT * union <= 100 * intersection.
PERCENT = 75
HALF, WIDTH = 20, 3
#: Bytes hashed at once.
CHUNK = 1 << 19
SMALL_GROUP = 24
BLOCK_FEW, BLOCK_MANY = 128, 512
#: Most ids that are broadcast; more are joined by shuffle.
MOST_BROADCAST = 500_000

_rng = np.random.default_rng(20_24)
_odd = lambda n: _rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES, _PLACES = _odd(256), _odd(SHINGLE)
_TIMES, _FLIPS = _odd(2 * HALF * WIDTH), _odd(2 * HALF * WIDTH)
_JOIN = _odd(WIDTH)
_BASE = int(_odd(1)[0])
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_POWERS: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    global _POWERS
    if _POWERS is None or len(_POWERS[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _POWERS = tuple(both)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word."""
    raw = np.frombuffer(data.lower(), np.uint8)
    solid = np.concatenate([[False], ~((raw == 32) | ((raw >= 9) & (raw <= 13))), [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * up[: len(raw)], dtype=np.uint64)])
    return mix((total[end] - total[start]) * down[start]), start


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    out: list[np.ndarray] = []
    held: list[bytes] = []

    def flush() -> None:
        if held:
            at = np.cumsum([0] + [len(h) + 1 for h in held])
            w, start = words(b"\n".join(held))
            cut = np.searchsorted(start, at)
            out.extend(_sets(w, cut))
            held.clear()

    size = 0
    for text in texts:
        data = text.encode("utf-8", "surrogatepass")
        if len(data) > CHUNK:
            flush()
            parts, at = [], 0
            while at < len(data):
                space = _SPACE.search(data, min(at + CHUNK, len(data)))
                end = space.start() if space else len(data)
                parts.append(words(data[at:end])[0])
                at = end
            w = np.concatenate(parts)
            out.extend(_sets(w, np.array([0, len(w)])))
            size = 0
            continue
        if size + len(data) > CHUNK:
            flush()
            size = 0
        held.append(data)
        size += len(data) + 1
    flush()
    return out


def _sets(w: np.ndarray, cut: np.ndarray) -> Iterator[np.ndarray]:
    n = max(0, len(w) - SHINGLE + 1)
    whole = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        whole += w[k : k + n] * _PLACES[k]
    whole = mix(whole)
    for a, b in zip(cut[:-1], cut[1:]):
        if b - a >= SHINGLE:
            yield np.unique(whole[a : b - SHINGLE + 1])
        elif b > a:
            yield mix((w[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def tuples(shingles: np.ndarray) -> np.ndarray:
    """The set's 2 * HALF tuple hashes; the lowest bit tells the collection."""
    least = np.full(len(_TIMES), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        least = np.minimum(least, ((part[:, None] ^ _FLIPS) * _TIMES).min(axis=0))
    joined = mix((least.reshape(2 * HALF, WIDTH) * _JOIN).sum(axis=1, dtype=np.uint64) + np.arange(2 * HALF, dtype=np.uint64))
    side = np.repeat(np.array([0, 1], np.uint64), HALF)
    return ((joined & ~np.uint64(1)) | side).view(np.int64)


def kind_of(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def signatures(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, set_key (null for none), tuples."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = shingle_sets(["" if t is None else t for t in batch["text"]])
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                "n_shingles": [len(s) for s in sets],
                "set_key": [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets],
                "tuples": [tuples(s) if len(s) else np.zeros(0, np.int64) for s in sets],
            })
            del batch, sets
        release_memory()

    return docs.mapInPandas(run, f"doc_id {kind_of(docs)}, n_shingles long, set_key string, tuples array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> node, n, shingles."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = shingle_sets(["" if t is None else t for t in batch["text"]])
            yield pd.DataFrame({"node": batch["doc_id"], "n": [len(s) for s in sets], "shingles": [s.view(np.int64) for s in sets]})
            del batch, sets
        release_memory()

    return docs.mapInPandas(run, f"node {kind_of(docs)}, n long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs(u, v) that are links."""
    of = lambda side: sets.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("shingles").alias(f"s_{side}"))
    both = pairs.join(of("u"), "u").join(of("v"), "v")
    common = F.size(F.array_intersect("s_u", "s_v"))
    return both.filter(100 * common >= PERCENT * (F.col("n_u") + F.col("n_v") - common)).select("u", "v")


def shared_enough(sets: DataFrame) -> DataFrame:
    """sets without those of which too few shingles occur in another one to have any link."""
    each = sets.select("node", "n", F.explode("shingles").alias("s"))
    common = each.groupBy("s").agg(F.count("*").alias("k")).filter("k > 1").select("s")
    enough = each.join(common, "s").groupBy("node").agg(F.count("*").alias("k"), F.first("n").alias("n")).filter(100 * F.col("k") >= PERCENT * F.col("n"))
    return sets.join(enough.select("node"), "node", "left_semi")


def block_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the `few` rows of a block and all its rows, as far as they join components."""
    sets = list(rows["shingles"])
    few = np.flatnonzero(rows["few"].to_numpy())
    if not len(few):
        return pd.DataFrame({"u": rows["node"].iloc[:0], "v": rows["node"].iloc[:0]})
    node, part, n = rows["node"].to_numpy(), rows["component"].to_numpy(), np.array([len(s) for s in sets])
    vocabulary, at = np.unique(np.concatenate([sets[k] for k in few]), return_inverse=True)
    has = np.zeros((len(few), len(vocabulary)), np.bool_)
    has[np.repeat(np.arange(len(few)), n[few]), at] = True
    leader: dict[int, int] = {}

    def find(x: int) -> int:
        while leader.get(x, x) != x:
            x = leader[x]
        return x

    out = []
    for k, s in enumerate(sets):
        place = np.searchsorted(vocabulary, s)
        place = place[(place < len(vocabulary)) & (vocabulary[np.minimum(place, len(vocabulary) - 1)] == s)]
        common = has[:, place].sum(axis=1)
        for f in few[100 * common >= PERCENT * (n[few] + n[k] - common)]:
            a, b = find(part[f]), find(part[k])
            if a != b:
                leader[max(a, b)] = min(a, b)
                out.append((node[f], node[k]))
    return pd.DataFrame(out, columns=["u", "v"]).astype(rows["node"].dtype)


def remaining_links(keys: DataFrame, parts: DataFrame, sets: DataFrame) -> DataFrame:
    """Links across components: keys(key, node) of one collection, parts(node, component) of some nodes (others: alone)."""
    rows = keys.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = materialize(rows, "keyed")
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("k"))
    main = sizes.groupBy("key").agg(F.sum("k").alias("size"), F.max("k").alias("most"), F.count("*").alias("parts")).filter("parts > 1")
    chosen = sizes.join(main, "key").filter("k = most").groupBy("key", "size", "most").agg(F.min("component").alias("main"))
    rows = rows.join(chosen, "key").withColumn("few", F.col("component") != F.col("main"))
    rows = materialize(rows, "mixed-keys")
    small = rows.filter(F.col("size") <= SMALL_GROUP)
    left = small.filter("few").select("key", F.col("node").alias("u"), F.col("component").alias("cu"))
    pairs = left.join(small.select("key", F.col("node").alias("v"), F.col("component").alias("cv"), "few"), "key")
    pairs = pairs.filter((F.col("cu") != F.col("cv")) & (~F.col("few") | (F.col("u") < F.col("v")))).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    links = verified(pairs, sets)

    large = rows.filter(F.col("size") > SMALL_GROUP)
    n_few = F.ceil((F.col("size") - F.col("most")) / BLOCK_FEW).cast("int")
    n_many = F.ceil(F.col("size") / BLOCK_MANY).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    of_few = large.filter("few").select("key", "node", "component", "few", F.pmod(F.xxhash64(F.lit(1), "node"), n_few).cast("int").alias("row"), all_of(n_many).alias("col"))
    of_many = large.select("key", "node", "component", F.lit(False).alias("few"), all_of(n_few).alias("row"), F.pmod(F.xxhash64(F.lit(2), "node"), n_many).cast("int").alias("col"))
    blocks = of_few.unionByName(of_many).join(sets.select("node", "shingles"), "node")
    return links.unionByName(blocks.groupBy("key", "row", "col").applyInPandas(block_links, "u {0}, v {0}".format(sets.schema["node"].dataType.simpleString())))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable by links), kept (whether it is its own)."""
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    docs = docs.select(F.col(id_col).cast("long" if whole else "string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = materialize(signatures(docs), "signatures")
    own = known.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    nodes = own.groupBy("set_key").agg(F.min("doc_id").alias("node"))
    nodes = materialize(nodes, "nodes")

    keyed = own.join(nodes, (own["set_key"] == nodes["set_key"]) & (own["doc_id"] == nodes["node"])).select("node", F.explode("tuples").alias("t")).distinct()
    keyed = materialize(keyed, "tuples")
    common = keyed.groupBy("t").agg(F.count("*").alias("k")).filter("k > 1").select("t")
    met = materialize(keyed.join(common, "t").select("node", "t"), "met")
    table = lambda side: F.array_sort(F.collect_list(F.when(F.col("t").bitwiseAND(F.lit(1).cast("long")) == side, F.col("t"))))
    sides = met.groupBy("node").agg(table(0).alias("a"), table(1).alias("b")).filter((F.size("a") > 0) & (F.size("b") > 0))
    tables = sides.select("node", F.explode("a").alias("x"), "b").select("node", "x", F.explode("b").alias("y")).select("node", F.xxhash64("x", "y").alias("key"))
    tables = materialize(tables, "tables")
    shared = tables.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key")
    candidates = materialize(tables.join(shared, "key").select("node").distinct(), "candidates")

    picked = candidates.select(F.col("node").alias("doc_id"))
    if candidates.count() <= MOST_BROADCAST:
        picked = F.broadcast(picked)
    sets = materialize(full_sets(docs.join(picked, "doc_id", "left_semi")).filter("n > 0"), "sets")
    for _ in range(2):
        sets = materialize(shared_enough(sets), "sets")
    remaining = sets.select("node").distinct()

    tables = materialize(tables.join(remaining, "node", "left_semi"), "tables")
    least = tables.groupBy("key").agg(F.min("node").alias("v"), F.count("*").alias("k")).filter("k > 1").select("key", "v")
    stars = tables.join(least, "key").filter("node <> v").select(F.col("node").alias("u"), "v").distinct()
    links = materialize(verified(stars, sets), "star-links")
    parts = components(links)
    one_side = met.filter(F.col("t").bitwiseAND(F.lit(1).cast("long")) == 0).join(remaining, "node", "left_semi").select(F.col("t").alias("key"), "node")
    more = materialize(remaining_links(one_side, parts, sets), "more-links")
    of = lambda side: parts.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
    above = more.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("c_u", "u").alias("u"), F.coalesce("c_v", "v").alias("v"))
    joined = components(above).select(F.col("node").alias("_part"), F.col("component").alias("_above"))
    labels = nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labels = labels.join(joined, F.col("component") == F.col("_part"), "left").select("set_key", "node", F.coalesce("_above", "component").alias("component"))

    out = known.select("doc_id", "n_shingles", "set_key", F.coalesce("set_key", F.concat(F.lit("-"), F.col("doc_id").cast("string"))).alias("_key"))
    out = out.join(labels.select(F.col("set_key").alias("_key"), "component"), "_key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
