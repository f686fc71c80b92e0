"""Connected components by alternating large-star and small-star rounds, staged between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, stage


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> one row ``(id, component)`` per node that has a link; component is the smallest id reachable.

    Every round pre-aggregates before it shuffles and joins on the aggregated side, so a node with very many
    links is a skewed join that adaptive execution splits. Rounds grow with the logarithm of the longest chain.
    No links give no rows; repeated links and loops are ignored.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stage(small.unionByName(low.withColumnRenamed("m", "b")).distinct(), "edges")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(edges)
        edges = after
        if mark == seen:
            break
        seen = mark
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
