"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitscope.llm.common import materialize


def _least(pairs: DataFrame) -> DataFrame:
    """Each pair (u, v) with the least neighbour of u, or u itself if less, as m."""
    least = pairs.groupBy("u").agg(F.min("v").alias("_m"))
    return pairs.join(least, "u").withColumn("m", F.least("_m", "u")).drop("_m")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the least node it is linked to, over any number of steps.

    Each step hangs neighbours below their least neighbour until every component is a
    star, so paths shorten fast and no neighbourhood is collected: the least neighbour is
    an aggregate, joined back to the links. Every round is written to the shared folder.
    Self-links and repeated links are allowed; null ends are ignored; an empty table gives
    an empty result.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    pairs = materialize(pairs, "links")
    last = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        small = _least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        pairs = materialize(small, "links")
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).union(pairs.select("v", "v").distinct())
