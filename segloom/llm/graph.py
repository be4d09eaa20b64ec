"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over edges (u > v): neighbours of every node are linked to its least neighbour or itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.join(least, "u")
    if large:
        linked = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("u > v").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of edges(src, dst), component being the least node of its group.

    Loops, repeated edges and either direction are accepted; edges with a null end are left out. Rounds
    go on until none changes an edge, and each is written to the shared folder.
    """
    edges = edges.where("src is not null and dst is not null and src <> dst")
    edges = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    edges = materialise(edges, label)
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        done, edges = edges, materialise(_star(_star(edges, True), False), label)
        discard(done)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
