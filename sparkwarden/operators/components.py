"""Connected components of links between names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.storage import written


def components(links: DataFrame) -> DataFrame:
    """links(u, v) -> (node, component): the least name that can be reached, for each name in a link.

    Each round takes the least label among a name's neighbours and itself, then that label's own label, so that paths halve
    from round to round; it ends with a round that changes nothing. A name with many links is pre-aggregated by its neighbours."""
    edges = written(links.union(links.select("v", "u")).distinct().toDF("u", "v"), "links")
    labels = written(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("near")).select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        near = edges.join(labels, F.col("v") == F.col("node")).groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        of_label = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        moved = written(lower.join(of_label, "label").select("node", "before", F.least("label", "beyond").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.filter(F.col("label") != F.col("before")).isEmpty():
            return labels.withColumnRenamed("label", "component")
