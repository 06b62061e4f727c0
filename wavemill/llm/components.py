"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import materialise


def connected_components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for every node of links (a long, b long); component is the smallest node that can be reached.

    Each round joins every node's larger neighbours, then its smaller ones, to the smallest it knows; trees halve their
    height in a round. Links that still change after all rounds are an error. Nothing but a count and a checksum of the links
    reaches the driver. Self-links and repeated links do no harm, and no links give no rows.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    seen = None
    for _ in range(rounds + 1):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        edges = materialise(small.select("e.u", F.col("e.m").alias("v")).filter("u <> v").distinct(), "links")
    else:
        raise RuntimeError(f"links still change after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
