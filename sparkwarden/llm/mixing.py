"""Mixing sources to target weights by exact quotas.

Targets: sources in code-point order (null last) have the weights in turn and share the whole size by weight; a target
stops at `cap` times its source's size and the excess is shared again by weight among the others. A source is taken
whole as often as its target holds it; the rest is drawn: its quota is split among the source's blocks (multivariate
hypergeometric, exact sums), then each block's quota among the output shards by a splitting tree; a block's documents,
in permuted order, are laid along its quota, and each shard draws the disjoint run that is its own.

Null sizes are 0. Sources of size 0 have target 0. Identical rows are interchangeable. Reruns agree.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm.common import free_name, materialize
from sparkwarden.llm.quotas import communication_matrix, even_parts, small_table, spread_draws

#: Few rows, so that small sources are split by draws too; large tables get MAX_BLOCKS blocks.
ROWS_PER_BLOCK = 4
#: Blocks of all sources with more than one: what the driver holds is bounded by it.
MAX_BLOCKS = 4_096
#: Most rows of a table of sources that is broadcast; a larger one is joined by shuffle.
MOST_BROADCAST = 50_000


def targets(sources: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """sources(source, source_size, ...) with `target`. The windows run over one row for each source."""
    ranked = sources.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("_weight", weight.cast("double")).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(onward)
    levels = ranked.withColumn("_share", share)
    # Sources in order of cap / weight stop at their caps until a share of the rest fits under the next cap.
    fits = F.when(F.col("_share") * F.col("_weight") <= F.col("_cap"), F.col("_share"))
    level = F.first(fits, ignorenulls=True).over(everything)
    target = F.least(F.col("_cap"), F.coalesce(level * F.col("_weight"), F.col("_cap")))
    return levels.withColumn("target", target).drop("_rank", "_weight", "_cap", "_share")


def mix(
    df: DataFrame, *, source_col: str = "source", size_col: str = "size", weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, n_shards: int = 8, seed: int = 23
) -> DataFrame:
    """df with source_size, target (of the row's source), taken (long: units the mix takes of the row, repeats counted)
    and copies (array of copy, shard, units): where they go. Columns of these names in df are replaced."""
    df = df.drop("source_size", "target", "taken", "copies")
    cols = [F.col(f"`{c}`") for c in df.columns]
    names = ("source", "size", "block", "blocks", "whole", "rest", "order", "quota", "bounds", "upto", "block_size")
    source, size, block, blocks, whole, rest, order, quota, bounds, upto, block_size = (free_name(df, x) for x in names)
    spark = df.sparkSession
    rows = df.withColumns({source: F.col(f"`{source_col}`").cast("string"), size: F.greatest(F.coalesce(F.col(f"`{size_col}`").cast("long"), F.lit(0)), F.lit(0))})

    sources = rows.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"), F.count("*").alias("n"))
    sources = materialize(targets(sources, weights, cap), "mix-sources")
    n_sources, total = sources.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    per_block = max(ROWS_PER_BLOCK, -(-total // MAX_BLOCKS))
    full = F.least(F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0), F.lit(cap)).cast("long")
    left = F.round(F.col("target")).cast("long") - full * F.col("source_size")
    plan = sources.select(
        F.col("source").alias(source), "source_size", "target", F.ceil(F.col("n") / per_block).cast("int").alias(blocks),
        full.alias(whole), F.least(F.greatest(left, F.lit(0)), F.when(full >= cap, F.lit(0)).otherwise(F.col("source_size"))).alias(rest),
    )
    if n_sources <= MOST_BROADCAST:
        plan = F.broadcast(plan)
    plan_key = plan.withColumnRenamed(source, f"{source}_key")
    dealt = rows.join(plan_key, F.col(source).eqNullSafe(F.col(f"{source}_key"))).drop(f"{source}_key")
    dealt = dealt.withColumn(block, F.pmod(F.xxhash64(F.lit(seed), *cols), F.col(blocks)).cast("int"))

    # Only blocks of sources with several blocks are drawn: at most 2 * MAX_BLOCKS.
    cells = dealt.filter(F.col(blocks) > 1).groupBy(source, block).agg(F.sum(size).alias("s"), F.first(whole).alias("w"), F.first(rest).alias("r"))
    drawn = draw_cells(cells.orderBy(source, block).collect(), n_shards, seed)
    drawn = small_table(spark, [{f"{source}_key": a, f"{block}_key": b, quota: q, bounds: c} for a, b, q, c in drawn], f"`{source}_key` string, `{block}_key` int, `{quota}` long, `{bounds}` array<long>")
    matched = F.col(source).eqNullSafe(F.col(f"{source}_key")) & (F.col(block) == F.col(f"{block}_key"))
    dealt = dealt.join(F.broadcast(drawn), matched, "left").drop(f"{source}_key", f"{block}_key")
    dealt = dealt.withColumn(order, F.xxhash64(F.lit(seed + 1), *cols))
    in_block = Window.partitionBy(source, block).orderBy(order, *cols)
    dealt = dealt.withColumn(upto, F.sum(size).over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
    dealt = dealt.withColumn(block_size, F.sum(size).over(Window.partitionBy(source, block)))
    # A source of one block leaves nothing to draw: it keeps its whole quota, and its shards take even runs of it.
    dealt = dealt.withColumn(quota, F.coalesce(quota, rest))
    line = F.col(whole) * F.col(block_size) + F.col(quota)
    even = F.transform(F.sequence(F.lit(1), F.lit(n_shards)), lambda k: F.floor(line * k / n_shards).cast("long"))
    dealt = dealt.withColumn(bounds, F.coalesce(bounds, even))
    start = F.col(upto) - F.col(size)
    part = F.greatest(F.lit(0), F.least(F.col(size), F.col(quota) - start))

    def copy(k):
        units = F.when(k < F.col(whole), F.col(size)).otherwise(part)
        middle = k * F.col(block_size) + start + F.floor(units / 2)
        where = F.least(F.size(F.filter(bounds, lambda x: x <= middle)), F.lit(n_shards - 1))
        return F.struct(k.cast("int").alias("copy"), where.cast("int").alias("shard"), units.cast("long").alias("units"))

    copies = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col(whole)), copy), lambda c: (c["copy"] < F.col(whole)) | (c["units"] > 0))
    return dealt.select(*cols, "source_size", "target", (F.col(whole) * F.col(size) + part).cast("long").alias("taken"), copies.alias("copies"))


def draw_cells(cells: list, n_shards: int, seed: int) -> list[tuple]:
    """For each (source, block): its quota of the source's rest, and the bounds of the shards along its line."""
    rng = np.random.default_rng(seed)
    by_source = defaultdict(list)
    for row in cells:
        by_source[row[0]].append(row)
    out = []
    for name, rows in by_source.items():
        sizes = [r[2] for r in rows]
        quotas = spread_draws(rng, sizes, min(rows[0][4], sum(sizes)))
        lines = [r[3] * r[2] + q for r, q in zip(rows, quotas)]
        matrix = communication_matrix(rng, lines, even_parts(sum(lines), n_shards))
        out += [(name, r[1], q, np.cumsum(m).tolist()) for r, q, m in zip(rows, quotas, matrix)]
    return out


def expand(mixed: DataFrame, *, size_col: str = "size") -> DataFrame:
    """The mixed corpus: a row for each copy, with mix_copy, mix_shard and mix_order, which shuffles a shard when sorted by it
    (columns of these names in mixed are replaced).

    A document of which a part is drawn is there whole if that part is half of it or more, so texts are never cut.
    """
    cols = [c for c in mixed.columns if c not in ("source_size", "target", "taken", "copies", "mix_copy", "mix_shard", "mix_order")]
    one = free_name(mixed, "one")
    cols = [F.col(f"`{c}`") for c in cols]
    flat = mixed.select(*cols, F.explode("copies").alias(one))
    return flat.filter(F.col(f"{one}.units") * 2 >= F.coalesce(F.col(f"`{size_col}`"), F.lit(0))).select(*cols, F.col(f"{one}.copy").alias("mix_copy"), F.col(f"{one}.shard").alias("mix_shard"), F.xxhash64(F.lit(29), *cols, f"{one}.copy").alias("mix_order"))


def shuffle(expanded: DataFrame) -> DataFrame:
    """expanded, dealt by shard and by runs of mix_order within it, and put in that order."""
    dealt = expanded.repartition("mix_shard", F.shiftright("mix_order", 56))  # 256 runs of a shard, so none is one task
    return dealt.sortWithinPartitions("mix_shard", "mix_order")
