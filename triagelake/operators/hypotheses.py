"""Status and confidence of hypotheses, limits for each rule or action, latest attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judged(rows: DataFrame) -> DataFrame:
    """rows (n_edges, n_nodes, n_findings, contradicted, coverage) with status and confidence, in ten-thousandths exact."""
    status = F.when(F.col("contradicted"), "statically_contradicted").when(F.col("coverage") != "checked", "inconclusive").when(F.col("n_edges") == 0, "candidate").otherwise("statically_supported")
    unclear = F.when(F.col("coverage") == "failed", 1500).otherwise(2500)
    supported = F.least(F.lit(9500), 6500 + 500 * F.col("n_edges") + 100 * F.col("n_nodes") + 400 * F.col("n_findings"))
    points = F.when(F.col("contradicted"), 1000).when(F.col("coverage") != "checked", unclear).when(F.col("n_edges") == 0, 5000).otherwise(supported)
    return rows.withColumn("status", status).withColumn("confidence", points / 10000.0)


def first(rows: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each group, and their nth. Spark keeps `most` of a group in every task before it shuffles."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("nth") <= most)


def latest(rows: DataFrame, group: list[str], attempt: str, *kept: str) -> DataFrame:
    """The row with the largest attempt of each group, by an aggregate rather than a sort."""
    return rows.groupBy(*group).agg(F.max(F.struct(attempt, *kept)).alias("x")).select(*group, "x.*")


def upserted(base: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """base, and the first new row (by order) of each key that base does not have: what exists wins."""
    fresh = new.join(base.select(*key).distinct(), key, "left_anti")
    return base.unionByName(first(fresh, key, [F.col(order)], 1).drop("nth"))


def representative(rows: DataFrame, group: list[str], family: str, order: list[Column], most: int) -> DataFrame:
    """`most` rows of each group, and their nth: the first of each family in order, then the others in order."""
    in_family = first(rows, [*group, family], order, most).withColumnRenamed("nth", "family_nth")
    return first(in_family, group, [(F.col("family_nth") > 1).cast("int"), *order], most).drop("family_nth")


def merged(rows: DataFrame, key: list[str], order: str, scalars: list[str], arrays: list[str]) -> DataFrame:
    """One row a key: scalars of its first row by order, and the sorted distinct values of its arrays."""
    sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(a)))).alias(a) for a in arrays]
    return rows.groupBy(*key).agg(*(F.min_by(c, order).alias(c) for c in scalars), *sets)
