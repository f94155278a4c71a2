"""Connected components of an edge table, on the cluster.

Alternating star contraction: each round links every neighbour of a node to the
smallest neighbour, first among larger then among smaller ones, until the edge
set is a set of stars.  Only two scalars a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastate.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v): every v of u is linked to the least of u and its v's."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    out = edges.join(least, "u").select("v", "m")
    if large:
        out = out.filter("v > m")
    else:
        out = out.filter("v <> m").unionByName(least.filter("u <> m").select(F.col("u").alias("v"), "m"))
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges``
    (columns a, b; order and repeats don't matter, loops are dropped)."""
    cur = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur, before = materialize(spark, cur, "cc"), None
    while True:
        state = tuple(cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        before = state
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both.filter("u <> v"), large=True)
        cur = materialize(spark, _star(large, large=False), "cc")
