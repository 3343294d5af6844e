"""Connected components by repeated contraction, as DataFrame joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """links(u, v) of numbers -> (node, component): the least node reachable, for each node with a link.

    In each round every node moves to its least neighbour (or stays, if it is less) and links move along; rounds end when
    no link is left between different nodes. A hub's rows are pre-aggregated and spread by its neighbours.
    """
    edges = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    moves = []
    while not edges.isEmpty():
        near = edges.select("u", "v").union(edges.select("v", "u")).groupBy("u").agg(F.min("v").alias("to"))
        move = materialize(near.filter("to < u"), "moves")
        moves.append(move)
        ends = edges
        for end in ("u", "v"):
            key = move.select(F.col("u").alias("_key"), "to")
            ends = ends.join(key, F.col(end) == F.col("_key"), "left").withColumn(end, F.coalesce("to", end)).drop("_key", "to")
        edges = materialize(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    labels = nodes.withColumn("component", F.col("node"))
    for move in moves:
        key = move.select(F.col("u").alias("_key"), "to")
        labels = labels.join(key, F.col("component") == F.col("_key"), "left").withColumn("component", F.coalesce("to", "component")).drop("_key", "to")
    return materialize(labels, "components")
