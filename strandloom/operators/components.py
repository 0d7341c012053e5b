"""Connected components of an edge list, by alternating large-star and small-star rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stage, unsent


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The component of every node of ``edges`` (a, b: bigint): node, component (its smallest node).

    Rows with a null end are left out; loops and repeated edges change nothing; no edges, no rows.
    Each round groups and joins by node and is written to the shared folder; rounds grow with the
    logarithm of the longest path. A node with very many neighbours is combined before the
    shuffle and its edges are split by adaptive skew joins.
    """
    now = stage(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = now.where("u > v").union(now.where("u > v").select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(unsent(least), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        loops = now.where("u = v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(unsent(least), "u").select(F.col("v"), F.col("m")).union(least.select("u", "m")).toDF("u", "v")
        now = stage(small.where("u > v").union(loops).distinct())
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    pairs = now.where("u > v")
    return pairs.union(pairs.select("v", "v")).union(now.where("u = v")).toDF("node", "component").groupBy("node").agg(F.min("component").alias("component"))
