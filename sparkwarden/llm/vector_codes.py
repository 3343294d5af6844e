"""Product codes of vectors: each of several equal parts of a vector becomes the index of its nearest codebook entry.

Components are integers (floor of SCALE times the value), so that distances, sums and floors are exact and results do not
depend on how rows are dealt. An assignment is an exponion search: it starts at the entry that the part had before (entry 0
in the first round) at distance d, and scans that entry's list of the other entries, which is sorted by distance. By the
triangle inequality an entry that is further than 2 d from it is further than d from the part, so the scan ends at that radius
(squared: 4 d²) and misses neither the nearest entry nor one at an equal distance; of those the least index wins.

Codebooks have parts x entries x components integers whatever the input, and are the only thing that passes the driver.

Results in the edge cases: a vector that is null, or holds a null or a component that is not finite, is dropped. With under
`entries` vectors there are as many entries as vectors. Rows that share an id stand each for themselves, null ids come last;
equal ids are ordered by vector. Vectors are filled up with zeros to the longest one's length, rounded up to a multiple
of `parts`. Components of any finite size are taken exactly; an error that needs over 63 bits is null, and so is the sum of
its label. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import materialize, release_memory
from sparkwarden.session import ship_package

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components below this size keep squared distances of vectors of up to 2 ** 16 components within 63 bits.
SMALL = 1 << 22
#: Digits of the sums that tasks hand over: 30 bits each, so that a long takes the sum of those of any number of tasks.
DIGIT_BITS = 30
#: Vectors that are compared at once.
AT_ONCE = 4096


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * value) of finite numbers: 64-bit integers if all are small, else Python's."""
    scaled = np.floor(np.asarray(values, np.float64) * SCALE)
    if scaled.size == 0 or np.abs(scaled).max() < SMALL:
        return scaled.astype(np.int64)
    exact = np.empty(scaled.shape, object)
    flat = np.asarray(values, np.float64).ravel()
    exact.ravel()[:] = [int(x) * SCALE if abs(x) >= 2**53 else math.floor(x * SCALE) for x in flat.tolist()]
    return exact


def integers(column: pa.Array, width: int) -> np.ndarray:
    """The integer components of an Arrow column of lists, filled up to `width`."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return whole(flat.reshape(-1, width))
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return whole(out)


def exponion(points: np.ndarray, entries: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each point and its squared distance; of equal distances the least index.

    before: the entry each point starts at."""
    squared = lambda a, b: ((a - b) ** 2).sum(axis=-1)
    between = squared(entries[:, None], entries[None])
    lists = np.argsort(between, axis=1, kind="stable")
    sorted_between = np.take_along_axis(between, lists, axis=1)
    best, at = squared(points, entries[before]), before.astype(np.int64)
    reach = (sorted_between[before] <= 4 * best[:, None]).astype(bool).sum(axis=1)
    # Points with the longest scans first: those that still scan at a step are then the first ones.
    order = np.argsort(-reach, kind="stable")
    points, start, best, at, reach = points[order], before[order], best[order], at[order], reach[order]
    for k in range(int(reach.max(initial=0))):
        n = int(np.searchsorted(-reach, -k, side="left"))
        entry = lists[start[:n], k]
        distance = squared(points[:n], entries[entry])
        nearer = ((distance < best[:n]) | ((distance == best[:n]) & (entry < at[:n]))).astype(bool)
        best[:n][nearer], at[:n][nearer] = distance[nearer], entry[nearer]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return at[back], best[back]


def books_of(codebooks: list, parts: int) -> list[np.ndarray]:
    """The codebook of each part as integers, of 64 bits if all are small."""
    small = all(abs(x) < SMALL for book in codebooks for entry in book for x in entry)
    return [np.array(book, np.int64 if small else object).reshape(len(book), -1) for book in codebooks]


def assign(vectors: DataFrame, codebooks: list, width: int) -> DataFrame:
    """vectors (vec_id, label, vec, code) with new codes (one byte a part), and error (text of an integer)."""
    parts = len(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = books_of(codebooks, parts)
        for big in batches:
            for k in range(0, big.num_rows, AT_ONCE):
                batch = big.slice(k, AT_ONCE)
                x = integers(batch["vec"], width).reshape(batch.num_rows, parts, width // parts)
                code = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(-1, parts).copy()
                error = np.zeros(batch.num_rows, x.dtype)
                for p, book in enumerate(books):
                    at, distance = exponion(x[:, p], book, code[:, p])
                    code[:, p], error = at, error + distance
                columns = [batch["vec_id"], batch["label"], batch["vec"], pa.array([c.tobytes() for c in code], pa.binary()), pa.array([str(e) for e in error.tolist()], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "vec", "code", "error"])
        release_memory()

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, vec {kinds['vec']}, code binary, error string")


def renewed(assigned: DataFrame, codebooks: list, width: int) -> list:
    """Each entry as the floor of the mean of its parts; entries without parts stay. Tasks hand over sums by entry and
    component, never vectors."""
    parts, most = len(codebooks), max(map(len, codebooks))
    step = width // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, most, step), object), np.zeros((parts, most), np.int64)
        for batch in batches:
            x = integers(batch["vec"], width).reshape(batch.num_rows, parts, step)
            code = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                part = np.zeros((most, step), x.dtype)
                np.add.at(part, code[:, p], x[:, p])
                sums[p] += part
                counts[p] += np.bincount(code[:, p], minlength=most)
        out: list[tuple[int, int, int, int, int]] = []
        for p, e in zip(*np.nonzero(counts), strict=True):
            out.append((p, e, -1, 0, counts[p, e]))
            for i, rest in enumerate(sums[p, e].tolist()):
                digit = 0
                while abs(rest) >> DIGIT_BITS:
                    out.append((p, e, i, digit, rest & (1 << DIGIT_BITS) - 1))
                    rest, digit = rest >> DIGIT_BITS, digit + 1
                out.append((p, e, i, digit, rest))
        for k in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array([int(row[c]) for row in out[k : k + 10_000]], pa.int64()) for c in range(5)], ["part", "entry", "place", "digit", "total"])
        release_memory()

    tasks = assigned.select("vec", "code").mapInArrow(run, "part long, entry long, place long, digit long, total long")
    total: dict[tuple[int, int, int], int] = {}
    for r in tasks.groupBy("part", "entry", "place", "digit").agg(F.sum("total").alias("total")).collect():
        key = (r.part, r.entry, r.place)
        total[key] = total.get(key, 0) + (r.total << DIGIT_BITS * r.digit)
    return [
        [[total[p, e, i] // total[p, e, -1] for i in range(step)] if (p, e, -1) in total else entry for e, entry in enumerate(book)]
        for p, book in enumerate(codebooks)
    ]


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list]:
    """(vec_id, label, code, error, label_error) of each kept vector, and the codebooks by part, entry and component.

    code: binary, one byte a part. error: squared distance of the vector to what its code stands for. label_error: error
    summed over equal labels, nulls together."""
    if entries > 256:
        raise ValueError("an entry's index is one byte")
    spark = vectors.sparkSession
    ship_package(spark)
    finite = F.forall(F.col("vec"), lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    kept = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vec")).filter(F.coalesce(finite, F.lit(False)))
    longest = kept.agg(F.max(F.size("vec"))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    first = kept.select("vec_id", "vec").orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).collect()
    start = [list(map(int, whole(np.array([*r.vec, *[0.0] * (width - len(r.vec))])).tolist())) for r in first]
    step = width // parts
    codebooks = [[v[p * step : (p + 1) * step] for v in start] or [[0] * step] for p in range(parts)]
    assigned = kept.withColumn("code", F.lit(bytes(parts)))
    for _ in range(rounds):
        assigned = materialize(assign(assigned, codebooks, width).drop("error"), "vector-codes")
        codebooks = renewed(assigned, codebooks, width)
    coded = materialize(assign(assigned, codebooks, width).select("vec_id", "label", "code", F.expr("try_cast(error as bigint)").alias("error")), "vector-codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count_if(F.col("error").isNull()).alias("lost"))
    by_label = by_label.select("of", F.when(F.col("lost") == 0, F.expr("try_cast(total as bigint)")).alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left").drop("of"), codebooks


def digest(codebooks: list) -> str:
    """SHA-256 of all components, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in codebooks for entry in book for x in entry).encode()).hexdigest()


def oracle_sql(width: int) -> str:
    """DuckDB SQL of compress(embeddings) with vectors of `width` components, by comparing every part with every entry."""
    step = width // PARTS
    assigned = "SELECT p.vec_id, p.part, min({{'distance': d, 'entry': entry}}) AS best FROM (SELECT p.vec_id, p.part, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts p JOIN {books} b USING (part)) p GROUP BY ALL"
    renewed = "SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM {books} b LEFT JOIN (SELECT part, entry, list(v ORDER BY i) AS x FROM (SELECT a.part, a.best.entry AS entry, i, floor(sum(p.x[i])::DOUBLE / count(*))::BIGINT AS v FROM {codes} a JOIN parts p USING (vec_id, part), range(1, {step} + 1) r(i) GROUP BY ALL) GROUP BY ALL) m USING (part, entry)"
    rounds, books = [], "books0"
    for k in range(ROUNDS):
        rounds.append(f"codes{k} AS MATERIALIZED ({assigned.format(books=books)})")
        rounds.append(f"books{k + 1} AS MATERIALIZED ({renewed.format(books=books, codes=f'codes{k}', step=step)})")
        books = f"books{k + 1}"
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, part, v[part * {step} + 1 : (part + 1) * {step}] AS x FROM kept, range({PARTS}) r(part)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}),
books0 AS MATERIALIZED (SELECT part, entry, x FROM parts JOIN firsts USING (vec_id)),
{", ".join(rounds)},
final AS MATERIALIZED ({assigned.format(books=books)}),
coded AS (SELECT vec_id, string_agg(printf('%02x', best.entry::INT), '' ORDER BY part) AS code, sum(best.distance)::BIGINT AS error FROM final GROUP BY vec_id),
named AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM {books})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), named
"""
