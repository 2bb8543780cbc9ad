"""Connected components of a set of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node it is linked with) for every node of a link.

    Each round joins the links with one smallest neighbour for each node (an aggregate combined before the
    shuffle, so a node with very many links costs no more there), and ends when the links no longer
    change. All that the driver sees of a round is a count and a checksum. No links give no rows.
    """
    pair = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    pair, seen = written(pair, "links"), None
    while True:
        both = pair.unionByName(pair.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        pair = written(small.select("x.u", "x.v").where("u > v").distinct(), "links")
        now = pair.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == seen:
            break
        seen = now
    return pair.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pair.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
