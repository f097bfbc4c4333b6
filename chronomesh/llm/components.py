"""Connected components of an edge table by alternating stars.

Each round is a handful of aggregations and joins on small integer rows; no component is
ever gathered in one task. A hub's neighbours meet it in joins whose large side Spark can
split, and its minimum is aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle


def large_star(edges: DataFrame) -> DataFrame:
    """Link every neighbour larger than a node to the smallest one around that node."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest of them; edges run from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    met = edges.join(least, "u")
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest node it reaches.

    Edges from a node to itself and repeated edges change nothing; null ends are dropped.
    An empty table gives an empty result.
    """
    now = settle(
        edges.select(F.col(u).cast("long").alias("a"), F.col(v).cast("long").alias("b"))
        .where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = mark(now)
    while before[0]:
        after = settle(small_star(large_star(now)))
        forget(now)
        now, last, before = after, before, mark(after)
        if before == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select("v", "v").toDF("node", "root").distinct())
