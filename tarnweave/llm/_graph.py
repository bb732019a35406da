"""Connected components as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnweave.session import broadcast_if_small, drop_settled, settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of all nodes that have a link; root is the smallest node that can be reached.

    Large-star and small-star steps (minimum by group, join) alternate until the
    links no longer change; each round is settled in the shared folder, and only
    two numbers of it come to the driver. The rounds grow with the logarithm of
    the longest path.
    """
    hi, lo = F.greatest(a, b).alias("a"), F.least(a, b).alias("b")
    links = settle(edges.where(F.col(a) != F.col(b)).select(hi, lo).distinct(), "links")
    before = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b")).distinct()
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are settled before they are joined back, so a node with very many links can be split
        least = broadcast_if_small(settle(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = broadcast_if_small(settle(large.groupBy("a").agg(F.min("b").alias("m")), "least"))
        turned = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = settle(turned.union(least).distinct(), "links")
        drop_settled(links)
        links, before = after, now
