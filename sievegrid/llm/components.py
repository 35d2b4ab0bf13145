"""Connected components by alternating star contraction.

Links stay in DataFrames; each round is written to the shared folder.  ``a`` > ``b`` in every
stored link.  The large star sends a node's larger neighbours to its least one, the small
star its smaller ones; both keep the components, and the rounds grow with the logarithm of
the longest path.  A hub's links are combined before the minimum shuffles, and the join's
skewed side can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def _sum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One half round: every node's chosen neighbours move to its least neighbour."""
    both = links.select("a", F.col("b").alias("v"))
    if large:
        both = both.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("v")))
    least = both.groupBy("a").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "a"))
    side = both.where("v > a") if large else both
    # a node's own link to its least neighbour stays
    moved = side.join(least, "a").select(F.col("v").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m"))
    return moved.where("x != m").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): every node of (a, b) links and the least node it reaches."""
    links = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = store.keep(links, "links")
    state = _sum(links)
    while state[0]:
        links = store.keep(_star(_star(links, large=True), large=False).distinct(), "links")
        now = _sum(links)
        if now == state:
            break
        state = now
    return links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
