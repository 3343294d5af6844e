"""Exact random quotas: hypergeometric draws on the driver over a bounded table of block sizes.

Only block totals are drawn here, never rows; the DataFrame operators of sharding and mixing turn quotas into rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Standard deviation from which a draw is the rounded normal one; the sums stay exact.
WIDE = 1e5


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` items, taken without replacement, are of the `good` ones."""
    low, high = max(0, draws - bad), min(draws, good)
    if low >= high:
        return low
    total = good + bad
    mean = draws * (good / total)
    spread = math.sqrt(mean * (bad / total) * ((total - draws) / max(1, total - 1)))
    if spread > WIDE:
        return min(high, max(low, round(rng.normal(mean, spread))))
    first, last = max(low, int(mean - 12 * spread) - 12), min(high, int(mean + 12 * spread) + 12)
    x = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - x) + np.log(draws - x) - np.log(x + 1) - np.log(bad - draws + x + 1)
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    below = np.cumsum(np.exp(weight - weight.max()))
    return first + int(np.searchsorted(below, rng.random() * below[-1], side="right"))


def spread_draws(rng: np.random.Generator, sizes: Sequence[int], draws: int) -> list[int]:
    """`draws` items over groups of the given sizes, without replacement: halves of the groups get theirs first."""
    if len(sizes) == 1:
        return [draws]
    half = len(sizes) // 2
    left = hypergeometric(rng, sum(sizes[:half]), sum(sizes[half:]), draws)
    return spread_draws(rng, sizes[:half], left) + spread_draws(rng, sizes[half:], draws - left)


def communication_matrix(rng: np.random.Generator, rows: Sequence[int], columns: Sequence[int]) -> list[list[int]]:
    """Random counts with exactly these row and column sums, as a uniform shuffle of all items gives: a splitting tree
    halves the columns again and again and draws each row's part of the left half."""
    if len(columns) == 1:
        return [[n] for n in rows]
    half = len(columns) // 2
    left = spread_draws(rng, rows, sum(columns[:half]))
    right = [n - k for n, k in zip(rows, left)]
    return [a + b for a, b in zip(communication_matrix(rng, left, columns[:half]), communication_matrix(rng, right, columns[half:]))]


def even_parts(total: int, parts: int) -> list[int]:
    return [total // parts + (k < total % parts) for k in range(parts)]


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A DataFrame of a few driver rows as one literal, so that no Python runs in its plan."""
    parsed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.explode(parsed).alias("r")).select("r.*")
