"""Connected components by alternating large-star and small-star steps on an edge table; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwell.llm._common import cut


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); the root is the least node of the component, roots included.

    Each step keeps the number of edges, and a star with many leaves stays a star, so a large component costs no more than its edges.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e, "cc", True)
    last = _state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        big = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        e = cut(big, "cc", True)
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small, "cc", True)
        now = _state(e)
        if now == last:
            break
        last = now
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return out.unionByName(out.select(F.col("root").alias("node"), "root").distinct())
