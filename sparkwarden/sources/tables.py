"""Upserts and deletes in partitioned Parquet: only the partitions that change are written anew, each in one move.

Tables are read with their schema, as folder names alone would turn the month 2024.10 into a number. Two writers of one
partition must not run at once. A job that died before it ended is run again: both operations can be repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwarden.operators.admin import expired_partitions
from sparkwarden.schema import purge_order
from sparkwarden.storage import names_in, remove, written

#: (old row, new row) -> the column's value where a key was there already.
Merge = Callable[[Column, Column], Column]


def table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a table; none if it was never written."""
    return spark.read.schema(schema).parquet(path) if names_in(spark, path) else spark.createDataFrame([], schema)


def _replace(rows: DataFrame, path: str, by: list[str]) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _of_partitions(rows: DataFrame, partitions: DataFrame, by: list[str]) -> DataFrame:
    other = partitions.select(*[F.col(c).alias(f"_by_{c}") for c in by])
    return rows.join(other, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]), "left_semi")


def upsert(path: str, changes: DataFrame, *, keys: list[str], by: list[str], order: list[str], merge: dict[str, Merge] | None = None) -> DataFrame:
    """Insert rows of new keys and update those of known ones; returns the keys with `inserted`.

    changes have the columns of the table; of several of a key the last by `order` counts, whose columns are not stored if
    their names start with an underscore. A known key takes the change's values, or what `merge` makes of both rows for a column. The partition
    columns `by` are part of the keys; a null in a key is an error."""
    if not set(by) <= set(keys):
        raise ValueError("the columns of the partitions must be part of the keys")
    spark = changes.sparkSession
    extra = [c for c in order if c.startswith("_")]
    schema = changes.drop(*extra).schema
    given = [F.coalesce(F.col(c), F.raise_error(F.lit(f"{c} is null in a key")).cast(schema[c].dataType)).alias(c) for c in keys]
    rest = [c for c in schema.names if c not in keys]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    last = changes.withColumn("_place", place).filter("_place = 1").select(*given, *rest)
    old = table(spark, path, schema)
    known = _of_partitions(old.select(*keys), last.select(*by).distinct(), by).withColumn("_known", F.lit(True))
    last = written(last.join(known, keys, "left").withColumn("_inserted", F.col("_known").isNull()).drop("_known"), "upsert")
    before = _of_partitions(old, last.select(*by).distinct(), by).select(*keys, F.struct(F.lit(1).alias("_is"), *rest).alias("_old"))
    both = before.join(last.select(*keys, F.struct(F.lit(1).alias("_is"), *rest).alias("_new")), keys, "full")

    def value(c: str) -> Column:
        ours = merge[c](F.col("_old"), F.col("_new")) if merge and c in merge else F.col(f"_new.{c}")
        return F.when(F.col("_new").isNull(), F.col(f"_old.{c}")).when(F.col("_old").isNull(), F.col(f"_new.{c}")).otherwise(ours).cast(schema[c].dataType).alias(c)

    _replace(both.select(*[F.col(c) if c in keys else value(c) for c in schema.names]), path, by)
    return last.select(*keys, F.col("_inserted").alias("inserted"))


def delete(spark: SparkSession, path: str, schema: T.StructType, where: Column, *, by: list[str]) -> None:
    """Delete the rows for which `where` holds (null does not). Partitions without such rows are not touched; those of which
    none is left lose their folder."""
    rows = table(spark, path, schema)
    if not names_in(spark, path):
        return
    goes = F.coalesce(where, F.lit(False))
    folder = F.regexp_replace("_metadata.file_path", "/[^/]*$", "")
    hit = written(rows.withColumn("_folder", folder).filter(goes).select(*by, "_folder").distinct(), "delete")
    keep = _of_partitions(rows, hit, by).filter(~goes)
    left = hit.join(keep.select(*[F.col(c).alias(f"_by_{c}") for c in by]).distinct(), reduce(and_, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]), "left_anti")
    emptied = [r._folder for r in left.select("_folder").distinct().collect()]  # names of folders, as a listing has them
    _replace(keep, path, by)
    for name in emptied:
        remove(spark, name)


def retain_months(spark: SparkSession, path: str, schema: T.StructType, days: DataFrame, as_of) -> list[tuple[str, str]]:
    """Drop the months of a table by (tenant_id, month) that are older than days(tenant_id, days) allow; returns them."""
    rows = table(spark, path, schema)
    if not names_in(spark, path):
        return []
    folders = rows.select("tenant_id", "month", F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("_folder")).distinct()
    gone = folders.join(expired_partitions(folders.select("tenant_id", "month").distinct(), days, as_of), ["tenant_id", "month"]).collect()
    for r in gone:
        remove(spark, r._folder)
    return sorted((r.tenant_id, r.month) for r in gone)


def purge(spark: SparkSession, tables: dict[str, tuple[str, T.StructType, list[str]]], tenant_id: str, *, retained: dict[str, Column] | None = None) -> list[str]:
    """Delete a tenant's rows from all tables (name -> path, schema, partition columns), what refers to others first, but
    those that must be retained. Returns the order. Run again, it deletes nothing more."""
    order = purge_order(list(tables))
    for name in order:
        path, schema, by = tables[name]
        own = F.col("tenant_id") == tenant_id
        delete(spark, path, schema, own if not retained or name not in retained else own & ~F.coalesce(retained[name], F.lit(False)), by=by)
    return order
