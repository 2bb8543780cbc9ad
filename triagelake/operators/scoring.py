"""Precision, recall and F-beta of findings against labelled truth, rolled up, gated and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The targets of direct findings, the weight of recall, the largest gap of splits.
TARGETS = {"precision": 0.90, "recall": 0.85, "f_half": 0.88}
BETA, GAP = 0.5, 0.10


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is 0."""
    return F.when(denominator != 0, numerator / denominator)


def f_beta(precision: Column, recall: Column, beta: float = BETA) -> Column:
    below = beta * beta * precision + recall
    return F.when(below == 0, F.lit(0.0)).when(below.isNotNull(), (1 + beta * beta) * precision * recall / below)


def rolled_up(rows: DataFrame, by: list[str] = []) -> DataFrame:
    """rows (language, family, truth, found) to tp, fp, fn for `all`, each language and each family: sums of counts, not means."""
    sets = [[*by, "language"], [*by, "family"], by]
    of = lambda truth, found: F.sum(((F.col("truth") == truth) & (F.col("found") == found)).cast("long"))
    key = F.when(F.grouping("language") == 0, F.concat(F.lit("language:"), F.coalesce("language", F.lit("none")))).when(F.grouping("family") == 0, F.concat(F.lit("family:"), F.coalesce("family", F.lit("none")))).otherwise("all")
    out = rows.groupingSets(sets, *by, "language", "family").agg(key.alias("key"), of(True, True).alias("tp"), of(False, True).alias("fp"), of(True, False).alias("fn"))
    return out.drop("language", "family")


def measured(counts: DataFrame) -> DataFrame:
    out = counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f_half", f_beta(F.col("precision"), F.col("recall")))


def gates(metrics: DataFrame) -> DataFrame:
    """key, metric, value, passed: a metric without a denominator passes, except for `all`."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(t).alias("target")) for m, t in TARGETS.items())))
    rows = metrics.select("key", each.alias("g")).select("key", "g.*")
    return rows.select("key", "metric", "value", F.coalesce(F.col("value") >= F.col("target"), F.col("key") != "all").alias("passed"))


def gap(metrics: DataFrame, split: str) -> DataFrame:
    """The largest difference of a metric between the two values of split, for each key; null if any is missing."""
    most = lambda m: F.max(m) - F.min(m)
    known = F.count("*") == 2
    for m in TARGETS:
        known = known & (F.count(m) == 2)
    out = metrics.groupBy("key").agg(F.when(known, F.greatest(*(most(m) for m in TARGETS))).alias("gap"))
    return out.withColumn("passed", F.col("gap") <= GAP)
