"""Connected components of a table of links, by stars that grow and shrink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Rounds after which a graph that has not settled is reported; each at least halves the longest chain's stars.
MAX_ROUNDS = 64


def _toward_least(pairs: DataFrame, both_ways: bool) -> DataFrame:
    """Each node's (larger) neighbours linked to the least node around it."""
    if both_ways:
        pairs = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = pairs.join(least, "u")
    if both_ways:
        out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of the (a, b) links; the component is its least node.

    Alternates between linking larger neighbours and linking all smaller
    neighbours to the least one until nothing changes. Each round is one
    checkpoint; only a count and a checksum reach the driver.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, before = checkpointed(pairs), None
    for _ in range(MAX_ROUNDS):
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or now[0] == 0:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
        pairs = checkpointed(_toward_least(_toward_least(pairs, True), False))
    raise RuntimeError("components did not settle")
