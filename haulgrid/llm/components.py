"""Connected components of a distributed set of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulgrid.llm.scratch import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str, rows: int | None = None) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b): component is the least node that links reach.

    Each round rehangs every node on the least neighbour it knows; the number of rounds grows with the logarithm of
    a component's size, and a chain is no worse than a star. A round's result is written, so that lineage stays
    short; only a count and a checksum reach the driver. ``rows``: about how many links there are, where known.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.table(edges, f"{name}-0", rows=rows)
    mark, rounds = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        rounds += 1
        edges = scratch.table(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{rounds}", rows=rows)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
