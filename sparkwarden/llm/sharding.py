"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows are dealt to blocks by hash; the number of rows that go from each block to each shard is drawn exactly (block sums
and shard sizes are fixed); a block's rows are permuted and cut at these counts; a shard's rows are permuted again, in
sub-blocks of bounded size. All is a function of seed and rows: reruns agree. Null columns hash like any value; identical
rows are interchangeable and share a block. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm.common import free_name, materialize
from sparkwarden.llm.quotas import communication_matrix, even_parts, small_table

#: Rows that one task permutes at a time, and the most blocks: the matrix on the driver has MAX_BLOCKS rows at most.
ROWS_PER_BLOCK = 2_000
MAX_BLOCKS = 4_096


def shard(df: DataFrame, n_shards: int = 8, *, seed: int = 17) -> DataFrame:
    """df with `shard` (0 to n_shards - 1; sizes differ by one at most) and `slot` (gapless from 0 in each shard).

    Columns of these names in df are replaced.
    """
    df = df.drop("shard", "slot")
    cols = [F.col(f"`{c}`") for c in df.columns]
    block, first, second, rank, bounds, sub, before = (free_name(df, x) for x in ("block", "first", "second", "rank", "bounds", "sub", "before"))
    total = df.count()
    n_blocks = max(1, min(MAX_BLOCKS, -(-total // ROWS_PER_BLOCK)))
    n_subs = max(1, -(-n_blocks // n_shards))
    dealt = df.withColumns({
        block: F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(n_blocks)).cast("int"),
        first: F.xxhash64(F.lit(seed + 1), *cols),
        second: F.xxhash64(F.lit(seed + 2), *cols),
    })
    sizes = [0] * n_blocks
    for b, n in dealt.groupBy(block).count().collect():  # MAX_BLOCKS rows at most
        sizes[b] = n
    matrix = communication_matrix(np.random.default_rng(seed), sizes, even_parts(sum(sizes), n_shards))
    cells = [{block: b, bounds: np.cumsum(row).tolist()} for b, row in enumerate(matrix)]
    cells = small_table(df.sparkSession, cells, f"`{block}` int, `{bounds}` array<long>")
    in_block = Window.partitionBy(block).orderBy(first, *cols)
    sent = (
        dealt.withColumn(rank, F.row_number().over(in_block))
        .join(F.broadcast(cells), block)
        .withColumn("shard", F.size(F.filter(bounds, lambda x: x < F.col(rank))).cast("int"))
        .withColumn(sub, F.pmod(second, F.lit(n_subs)).cast("int"))
        .drop(block, first, rank, bounds)
    )
    in_sub = Window.partitionBy("shard", sub).orderBy(second, *cols)
    sent = materialize(sent.withColumn("slot", F.row_number().over(in_sub)).drop(second), "shards", compression="zstd")
    by_sub = Window.partitionBy("shard").orderBy(sub)
    offsets = sent.groupBy("shard", sub).agg(F.count("*").alias(before))  # n_shards * n_subs rows at most
    offsets = offsets.withColumn(before, F.sum(before).over(by_sub) - F.col(before))
    out = sent.join(F.broadcast(offsets), ["shard", sub])
    return out.withColumn("slot", (F.col("slot") - 1 + F.col(before)).cast("long")).select(*cols, "shard", "slot")
