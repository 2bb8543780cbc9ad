"""Findings: found in text, de-duplicated, clustered, ranked into actions and a verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagelake.functions import findings as fn
from triagelake.sources import corpus

#: Rule, category, scanner severity and pattern.
RULES = (
    ("aws-key", "secret", "critical", r"AKIA[0-9A-Z]{16}"),
    ("email", "secret", "note", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("assignment", "secret", "error", r"(?i)(password|secret|token|api_key)\s*[=:]\s*\S+"),
    ("license", "dependency", "warning", r"[Ll]icensed? under|MIT License"),
    ("shout", "code", "info", r"[A-Z]{4,}!!"),
)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.files(spark, sf_dir, "doc_id", "text")
    return docs.select("repo_id", "path", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each rule and line that it matches: a rule is an expression of the scan, not a join."""
    hits = F.array(*(F.when(F.col("line").rlike(pattern), F.struct(F.lit(k).alias("ord"), F.lit(rule).alias("rule_id"), F.lit(category).alias("category"), F.lit(severity).alias("raw_severity"))) for k, (rule, category, severity, pattern) in enumerate(RULES)))
    found = lines(spark, sf_dir).select("repo_id", "path", "doc_id", (F.col("pos") + 1).alias("line_no"), "line", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("hit"))
    return found.select("repo_id", "path", "doc_id", "line_no", "line", "hit.*").withColumn("severity", fn.normal_severity(F.col("raw_severity"), F.col("category")))


def secrets(texts: DataFrame) -> DataFrame:
    """repo_id, path, line_no, rule_id, snippet: each match of each shape of secret in whole texts, by the line it starts in, redacted.

    Texts are not split into lines first: key blocks, headers and assignments may span them. Only texts with a word of a
    shape are searched for it, and only those with a match are split at it.
    """
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    low = F.lower(F.col("text").cast("string"))
    may = [reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in fn.SECRET_WORDS[rule])) for rule, _, _ in fn.SECRETS]
    rows = texts.select("repo_id", "path", F.col("text").cast("string").alias("text")).where(reduce(lambda a, b: a | b, may))
    hits = (F.when(m, F.struct(F.lit(k).alias("ord"), F.lit(rule).alias("rule_id"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("found"))) for k, (m, (rule, pattern, _)) in enumerate(zip(may, fn.SECRETS)))
    rows = rows.select("repo_id", "path", "text", F.filter(F.array(*hits), lambda h: F.size(h["found"]) > 0).alias("hits"), F.monotonically_increasing_id().alias("row"))
    each = rows.select("repo_id", "path", "row", "text", F.explode("hits").alias("hit"))
    between = reduce(lambda out, kv: out.when(F.col("hit.ord") == kv[0], F.split("text", kv[1][1])), enumerate(fn.SECRETS), F.when(F.lit(False), F.array().cast("array<string>")))
    each = each.select("repo_id", "path", "row", "hit.ord", "hit.rule_id", F.posexplode(F.arrays_zip(F.col("hit.found").alias("found"), between.alias("between"))).alias("nth", "x")).where(F.col("x.found").isNotNull())
    so_far = Window.partitionBy("row", "ord").orderBy("nth")
    before = F.sum(breaks(F.col("x.between"))).over(so_far) + F.sum(breaks(F.col("x.found"))).over(so_far) - breaks(F.col("x.found"))
    return each.select("repo_id", "path", (before + 1).alias("line_no"), "rule_id", fn.without_secrets(F.col("x.found")).alias("snippet"))


def deduplicated(found: DataFrame) -> DataFrame:
    """The first finding of each fingerprint (repository, rule, redacted line), by path, line and rule order."""
    keyed = found.withColumn("snippet", fn.redacted(F.col("line"))).withColumn("fingerprint", fn.stable_id("fp", F.col("repo_id"), F.col("rule_id"), F.col("snippet")))
    first = F.row_number().over(Window.partitionBy("fingerprint").orderBy("path", "line_no", "ord"))
    return keyed.withColumn("nth", first).where("nth = 1").drop("nth")


def clusters(findings: DataFrame) -> DataFrame:
    worst = F.max_by("severity", fn.severity_rank(F.col("severity")))
    return findings.groupBy("repo_id", "category", "rule_id", "path").agg(F.count("*").alias("n_findings"), worst.alias("max_severity"))


def actions(findings: DataFrame) -> DataFrame:
    """One action for each repository and rule: worst severity, score, files, impact, and its rank."""
    worst = F.max_by("severity", fn.severity_rank(F.col("severity"))).alias("severity")
    grouped = findings.groupBy("repo_id", "rule_id", "category").agg(worst, F.count("*").alias("n_findings"), F.countDistinct("path").alias("n_files"))
    scored = grouped.withColumn("score", fn.priority(F.col("severity"), F.col("category"))).withColumn("impact", fn.verdict_impact(F.col("severity")))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("score"), "rule_id")))


def verdicts(findings: DataFrame) -> DataFrame:
    worst = F.max(fn.severity_rank(F.col("severity")))
    return findings.groupBy("repo_id").agg(F.when(worst == 4, "critical-fix-needed").otherwise("not-ready").alias("verdict"), F.count("*").alias("n_findings"))
