"""Connected components by alternating stars, all of it in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.common import cut


def _stars(edges: DataFrame) -> DataFrame:
    """One round: every node's larger neighbours go to its smallest one, then its smaller neighbours do."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(low.withColumnRenamed("m", "v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) links of bigint nodes, any order, repeats allowed -> (node, component), the smallest node reachable.

    Nodes without a link to another node, and links with a null end, give no row. The number of rounds grows with
    the logarithm of the longest chain; each round is written to the checkpoint folder, so nothing is recomputed.
    """
    now = cut(
        edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    state = _state(now)
    while state[0]:
        now = cut(_stars(now))
        if (new := _state(now)) == state:
            break
        state = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
