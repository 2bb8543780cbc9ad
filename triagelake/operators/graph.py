"""Bounded searches over a property graph held as DataFrames of edges (a, b)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.sources.shared import written

MAX_LENGTH = 6


def trade_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str, str]:
    """Edges customer -> order -> part, with what sources and sinks begin with."""
    node = lambda kind, column: F.concat(F.lit(kind), F.col(column).cast("string"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(node("c", "o_custkey").alias("a"), node("o", "o_orderkey").alias("b"))
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(node("o", "l_orderkey").alias("a"), node("p", "l_partkey").alias("b"))
    return orders.unionByName(items).distinct(), "c", "p"


def flows(edges: DataFrame, source: str, sink: str, most: int = MAX_LENGTH) -> DataFrame:
    """source, sink, path, length: simple paths that stop at the first sink."""
    front = edges.where(F.col("a").startswith(source)).select("a", "b", F.array("a", "b").alias("nodes"))
    found = None
    for length in range(1, most + 1):
        here = front.where(F.col("b").startswith(sink)).select(F.col("a").alias("source"), F.col("b").alias("sink"), F.array_join("nodes", ">").alias("path"), F.lit(length).alias("length"))
        found = here if found is None else found.unionByName(here)
        front = front.where(~F.col("b").startswith(sink))
        if length == most or front.isEmpty():
            break
        step = edges.select(F.col("a").alias("b"), F.col("b").alias("next"))
        front = front.join(step, "b").where(~F.array_contains("nodes", F.col("next"))).select("a", F.col("next").alias("b"), F.array_append("nodes", F.col("next")).alias("nodes"))
    return found


def distances(edges: DataFrame, source: str, sink: str, most: int = 2 * MAX_LENGTH) -> DataFrame:
    """node, distance from the nearest source, by level: a node is visited once, in the first level that reaches it."""
    seen = edges.where(F.col("a").startswith(source)).select(F.col("a").alias("node"), F.lit(0).alias("distance")).distinct()
    front = seen
    for level in range(1, most + 1):
        reached = front.join(edges, front["node"] == edges["a"]).select(F.col("b").alias("node")).distinct()
        front = written(reached.join(seen, "node", "left_anti").withColumn("distance", F.lit(level)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen
