"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctrail.llm.common import checkpoint


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) with v the smallest node of u's component, for each node that is not its own smallest.

    ``edges`` has long columns u and v. Each round hangs every node's larger
    neighbours, then its smaller ones, on its smallest neighbour; the rounds
    grow with the logarithm of the longest path. Every round is checkpointed, so
    a lost executor costs one round; only a count and two hashes reach the
    driver. Loops and repeated edges do no harm; no edges give no rows.
    """
    edges = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _signature(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = checkpoint(small.where("u <> v").distinct())
        if (now := _signature(edges)) == seen:
            break
        seen = now
    return edges
