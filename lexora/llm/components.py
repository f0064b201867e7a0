"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexora.llm.common import stage, unstage


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """node, component (its smallest reachable node) for every node in links(a long, b long).

    Each round links every node to the smallest node it knows of, first
    outward then inward, until nothing changes. Rows never outnumber the links
    that came in; a node with very many links is aggregated map-side and its
    join is split by adaptive execution. Every round is staged in the shared
    folder.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    last = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        outward = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: each node's smaller neighbours are linked to the smallest of them
        large = stage(outward.where("a <> b").distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        inward = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        new = stage(inward.distinct(), "small")
        now = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        unstage(large, edges)
        edges = new
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
