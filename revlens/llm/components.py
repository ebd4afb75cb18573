"""Distributed connected components: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import by_shuffle, dropped, released, stored


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of `edges`; a component is named by its
    smallest node.

    Each half round links the neighbours of a node to the smallest of them: one
    aggregate (combined before its shuffle, so a hub is no hot group) and one join
    (whose skewed side Spark splits). Rounds end when every node hangs on one root and
    no root hangs on another; every round's edges are a stored table. Rows with a null
    end are dropped, loops and repeated edges do no harm, an empty table gives an empty
    result.
    """
    a, b = F.col(u), F.col(v)
    nodes = edges.where(a.isNotNull() & b.isNotNull())
    now = stored(nodes.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    while not _is_star_forest(now):
        links = now.where("hi <> lo")
        both = links.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(
            links.select(F.col("lo").alias("n"), F.col("hi").alias("m"))
        )
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("least"))
        large = both.join(by_shuffle(least), "n").where("m > n").select(F.col("m").alias("hi"), F.col("least").alias("lo"))
        down = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = large.join(by_shuffle(down), "hi").where("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        loops = now.where("hi = lo")
        then = small.unionByName(down.select("hi", F.col("least").alias("lo"))).unionByName(loops).distinct()
        then = stored(then, "edges")
        dropped(now)
        now = then
        released(edges.sparkSession)
    named = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    return named.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))


def _is_star_forest(edges: DataFrame) -> bool:
    """Does every node hang on one other at most, and none that is hung on hang itself
    (loops aside)?"""
    links = edges.where("hi <> lo")
    ends = links.select(F.col("hi").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        links.select(F.col("lo").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
    )
    per_node = ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return per_node.where("hangs > 1 OR hangs > 0 AND holds > 0").isEmpty()
