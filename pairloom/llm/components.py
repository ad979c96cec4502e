"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import discard, staged


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Point the neighbours of each vertex u to the least vertex among them and u.

    larger: only neighbours greater than u move (large-star); otherwise u and those smaller.
    The minimum is a combinable aggregate and the join splits hot vertices, so a hub costs no task
    more than its share.
    """
    if larger:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
    return moved.where("u <> v").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is a u."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    return ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) of every vertex of an edge; root is the least vertex of its component.

    edges: columns u, v of one orderable type. Loops, repeats and either direction are allowed;
    edges with a null end are no edges. An empty table gives an empty result. Each round is a table
    in the shared folder, so lineage does not grow with the rounds, and the one before it goes. Rounds end
    once all edges are stars.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = staged(edges, "edges")
    while not _are_stars(edges):
        before, edges = edges, staged(_star(_star(edges, True), False), "edges")
        discard(before)
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
