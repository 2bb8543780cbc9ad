"""Coverage rows: merged by area and producer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States from good to bad.
STATES = ("checked", "skipped", "partial", "degraded", "failed")


def state_rank(state: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in STATES)), state)


def merged(rows: DataFrame) -> DataFrame:
    """rows (area, producer, ord, state, covered, total, reason) to one row an area and producer.

    The worst state, the last counts that are not null, the distinct reasons in the order they first came.
    Rows are first grouped with their reason, so that a hot producer is small before its reasons meet.
    """
    counts = F.struct("ord", "covered", "total")
    by_reason = rows.groupBy("area", "producer", "reason").agg(
        F.min("ord").alias("since"), F.max(state_rank(F.col("state"))).alias("worst"), F.max(F.when(F.col("covered").isNotNull(), counts)).alias("last"))
    reasons = F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("since", "reason"))))
    out = by_reason.groupBy("area", "producer").agg(F.max("worst").alias("worst"), F.max("last").alias("last"), reasons.alias("reasons"))
    state = F.element_at(F.array(*(F.lit(s) for s in STATES)), F.col("worst").cast("int"))
    return out.select("area", "producer", state.alias("state"), "last.covered", "last.total", F.array_join(F.transform("reasons", lambda r: r["reason"]), "; ").alias("reason"))


#: Languages from first to last where scores tie, and what a file of code and a static asset count.
DOMINANT = ("typescript", "javascript", "java", "python", "go")
FILE_SCORE, ASSET_SCORE = 10, 1


def dominant(files: DataFrame, asset: Column) -> DataFrame:
    """repo_id, language, score: the language with the largest score; files are (repo_id, language)."""
    order = F.array_position(F.array(*(F.lit(x) for x in DOMINANT)), F.col("language"))
    is_asset = asset & F.col("language").isin("typescript", "javascript")
    scores = files.where(F.col("language").isin(*DOMINANT)).groupBy("repo_id", "language").agg(F.sum(F.when(is_asset, ASSET_SCORE).otherwise(FILE_SCORE)).alias("score"))
    best = F.max(F.struct("score", (-order).alias("order"), "language"))
    return scores.groupBy("repo_id").agg(best.alias("x")).select("repo_id", "x.language", "x.score")


def gaps(rows: DataFrame, areas: list[str]) -> DataFrame:
    """producer, area, state, reason for each known area that a producer does not report."""
    wanted = rows.select("producer").distinct().select("producer", F.explode(F.array(*(F.lit(a) for a in areas))).alias("area"))
    return wanted.join(rows.select("producer", "area").distinct(), ["producer", "area"], "left_anti").select("producer", "area", F.lit("skipped").alias("state"), F.lit("not reported").alias("reason"))


def worst_of(refs: Column) -> Column:
    """The worst state that a reference ends with; skipped if coverage is not available, else checked."""
    out = None
    for state in ("failed", "degraded", "partial", "skipped"):
        fits = F.exists(refs, lambda r: r.endswith(f":{state}"))  # noqa: B023
        out = F.when(fits, state) if out is None else out.when(fits, state)
    return out.when(F.array_contains(refs, "coverage-unavailable"), "skipped").otherwise("checked")


def unexplained(rows: DataFrame) -> DataFrame:
    """Rows that are not checked and give no reason."""
    return rows.where((F.col("state") != "checked") & (F.coalesce(F.trim("reason"), F.lit("")) == ""))
