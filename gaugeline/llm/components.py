"""Connected components of a link table by alternating stars (Kiveris et al., 2014), as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import cut


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one smaller node that hangs on none."""
    roots = edges.groupBy("u").agg(F.count("*").alias("n"), F.max("v").alias("v"))
    inner = roots.select(F.col("u").alias("w"))
    return roots.where("n > 1").select("u").unionAll(roots.join(inner, F.col("v") == F.col("w"), "left_semi").select("u")).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where("v > u").join(least, "u").where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and the node, are tied to the smallest of them (edges run from large to small)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return (joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(least.select("u", F.col("m").alias("v"))).distinct())


def connected_components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every node of ``links(a, b)``: component is the smallest id reachable.

    NULL ends and self links are ignored; an empty table gives an empty result.  Minima are aggregated
    before they meet a node's neighbours, each round is written to the shared folder, and the driver only learns
    whether there is another round to do.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .distinct(), "links")
    while not _are_stars(edges):
        edges = cut(_small_star(_large_star(edges)), "stars")
    return (edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
            .unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct())
