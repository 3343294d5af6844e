"""Lookups, sets and merges between tables: latest rows, overlays, existence, references, pages by offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.operators.queue import MAX_PAGE


def offset_page(rows: DataFrame, order, *, limit: int, offset: int = 0) -> DataFrame:
    """A page by offset, for short lists: one row more than `limit`, so that the caller sees whether another page follows."""
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"limit must be from 1 to {MAX_PAGE}, offset not negative")
    return rows.orderBy(*[F.col(n).asc() if up else F.col(n).desc() for n, up in order]).offset(offset).limit(limit + 1)


def totals(rows: DataFrame, *keys: str) -> DataFrame:
    """How many rows a filter finds, by the given columns."""
    return rows.groupBy(*keys).agg(F.count("*").alias("total"))


def latest(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key: an aggregate with partial sums, not a sort."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in columns])


def first_rows(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each key with their place `n`; Spark cuts groups before it shuffles them."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("n", n).filter(F.col("n") <= most)


def as_of(rows: DataFrame, known: DataFrame, keys: list[str], at: str, order: str, value: str, name: str) -> DataFrame:
    """rows with `name`: the value of the key's last known row that is no later; null where there is none. One pass over
    both, ordered in time within the key; at the same time known rows come first."""
    both = rows.withColumns({"_side": F.lit(1), "_value": F.lit(None).cast(known.schema[value].dataType)})
    of = known.select(*keys, at, F.col(order).alias(order), F.lit(0).alias("_side"), F.col(value).alias("_value"))
    before = Window.partitionBy(*keys).orderBy(at, "_side", order).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.unionByName(of, allowMissingColumns=True).withColumn(name, F.last("_value", ignorenulls=True).over(before))
    return seen.filter("_side = 1").drop("_side", "_value")


def overlay(base: DataFrame, overrides: DataFrame, keys: list[str], value: str) -> DataFrame:
    """base with `overridden`, and its value replaced where overrides(keys, value) has one that is not null."""
    own = overrides.select(*keys, F.lit(True).alias("overridden"), F.col(value).alias("_own"))
    rows = base.join(own, keys, "left")
    return rows.withColumns({"overridden": F.coalesce("overridden", F.lit(False)), value: F.coalesce("_own", value)}).drop("_own")


def linked(rows: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """Rows for which a link exists."""
    return rows.join(links.select(*keys), keys, "left_semi")


def unlinked(rows: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """Rows for which no link exists yet."""
    return rows.join(links.select(*keys), keys, "left_anti")


def in_group(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with how many others share their keys (0 where a key is null): each row meets its group's count, not its members."""
    sizes = rows.groupBy(*keys).agg((F.count("*") - 1).alias("siblings"))
    return rows.join(sizes, keys, "left").withColumn("siblings", F.coalesce("siblings", F.lit(0)))


def merged(rows: DataFrame, keys: list[str], source: str, first: str, last: str) -> DataFrame:
    """What several rows of a key tell together: sorted set of sources, earliest first and latest last time."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_set(source)).alias("sources"), F.min(first).alias("first_seen"), F.max(last).alias("last_seen"))


def last_known(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """For each name the last value of its column that is not null."""
    return rows.groupBy(*keys).agg(*[F.max_by(v, F.when(v.isNotNull(), F.struct(*order))).alias(name) for name, v in values.items()])


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys in one set or the other, each once."""
    return a.unionByName(b).distinct()


def missing(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Keys that are wanted and not found, each once."""
    return wanted.subtract(found.select(*wanted.columns))


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys in both sets, each once."""
    return a.intersect(b.select(*a.columns))


def users_with_tenants(users: DataFrame, tenants: DataFrame) -> DataFrame:
    """Users that are not deleted, with the status and plan of their tenant."""
    rows = users.filter(F.col("deleted_at").isNull()) if "deleted_at" in users.columns else users
    return rows.join(tenants.select("tenant_id", F.col("status").alias("tenant_status"), "plan_id", "abuse_frozen"), "tenant_id")


def conflicts(rows: DataFrame, keys: list[str], live: Column) -> DataFrame:
    """Keys that more than one live row has: what a unique index over live rows would refuse."""
    return rows.filter(live).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
