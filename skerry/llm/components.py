"""Connected components of an edge table, without the driver: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.shared import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node has two smaller neighbours, or both a smaller and a larger one: each tree is then its smallest node and that node's children."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("downs")), F.struct(F.col("v").alias("node"), F.lit(0).alias("ups"), F.lit(1).alias("downs")))).alias("x")).select("x.*")
    per = ends.groupBy("node").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs"))
    return not per.agg(F.max((F.col("ups") + F.col("downs") > 1) & (F.col("ups") > 0))).first()[0]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node. ``edges``: long columns u, v.

    Every step is a grouped minimum and a join, so a node with very many edges is combined before the
    shuffle and its join partition can be split. Each round is written to the shared folder.
    """
    now = scratch.keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _are_stars(now):
        step = _small_star(_large_star(now)).filter("u <> v").distinct()
        following = scratch.keep(step, "edges")
        scratch.drop(now)
        now = following
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
