"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum (map-side partial) and an equi-join on the node,
so a hub with very many links is split by the skewed-join rule.  The number of
steps grows with the logarithm of the component size.  Edges stay in Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import shared_table


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    least = least.select("n", F.least("n", "m").alias("m"))
    return (both.join(least, F.col("u") == F.col("n")).filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    moved = (e.join(least, F.col("u") == F.col("n")).filter(F.col("v") != F.col("m"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, comp`` for every node of ``edges``; ``comp`` is the smallest node
    of its component.  Loops, NULL ends and repeated edges are ignored."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e = shared_table(e, "edges")
    while True:
        # a large-star step returns each edge once, so it adds no rows
        e = shared_table(_small_star(_large_star(e)).distinct(), "stars")
        # done when every node hangs on one node that hangs on no other
        ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("hub")),
                                          F.struct(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("hub")))).alias("x"))
        open_ = ends.groupBy("x.node").agg(F.sum("x.hangs").alias("hangs"), F.max("x.hub").alias("hub"))
        if open_.filter("hangs > 1 or (hangs = 1 and hub = 1)").isEmpty():
            break
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("comp", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)
