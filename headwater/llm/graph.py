"""Connected components of an edge table, all of it on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    `edges` has two columns of one ordered type; loops and repeats do no harm, rows
    with a NULL end are ignored. Alternating stars: every node hangs its larger
    neighbours, then its smaller ones, on the least node it sees, until nothing
    moves. Each round is written to the shared folder, so a lost executor costs one
    round at most. No node's neighbours are ever collected; minima are pre-aggregated.
    """
    a, b = edges.columns[:2]
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    edges, before = _written(edges)
    while before[0]:
        edges, after = _written(_star(_star(edges, up=True), up=False))
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _star(edges: DataFrame, up: bool) -> DataFrame:
    """Links (v, least) of every neighbour v of u, the larger ones or the rest."""
    if up:
        edges = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    seen = edges.join(least.withColumn("least", F.least("u", "least")), "u")
    if up:
        moved = seen.filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        moved = seen.select(F.col("v").alias("u"), F.col("least").alias("v")).union(seen.select("u", F.col("least").alias("v")))
    return moved.filter("u > v").distinct()


def _written(edges: DataFrame):
    edges = materialise(edges, "edges")
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return edges, tuple(edges.agg(F.count("*"), total).first())
