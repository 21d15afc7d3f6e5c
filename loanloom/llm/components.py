"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.operators.lineage import cut_lineage


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of the links ``a, b``; the root is the smallest node reachable.

    Each round hangs the larger neighbours of a node, then the smaller ones, on the smallest
    neighbour, until every link points at a root. All steps are joins and minima over the
    links, with a reliable checkpoint per round; a node with very many links is summed up
    before the shuffle and joined by a plain join that Spark can split. Links from a node to
    itself and links with a null end are left out; repeated links count once. No links, no rows.
    """
    ends = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    edges = cut_lineage(ends.where("hi > lo").distinct())
    while not _stars(edges):
        edges = cut_lineage(_small_star(_large_star(edges)))
    leaves = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return leaves.unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether every node is either a root or hangs on exactly one root."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("hi").alias("node"), F.lit(1).alias("up")),
                                          F.struct(F.col("lo").alias("node"), F.lit(0).alias("up")))).alias("e"))
    odd = (ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("least"))
           .where("up > 1 or (up = 1 and least = 0)"))
    return odd.isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where("v > u").join(least, "u")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
