"""Reports of scanners: JSON of several shapes to one table of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RECORD = "ruleId string, level string, message struct<text string>, locations array<struct<physicalLocation struct<artifactLocation struct<uri string>, region struct<startLine int>>>>"
SARIF = f"runs array<struct<results array<struct<{_RECORD}>>>>"
SECRETS = "array<struct<RuleID string, File string, StartLine int, Secret string, Match string>>"
_FENCE = r"(?s)```(?:json)?[ \t]*\n(.*?)\n?```"


def records(reports: DataFrame) -> DataFrame:
    """reports (repo_id, raw) to repo_id, tool, rule_id, severity, path, line_no, message; `failed` where raw is no JSON.

    A fenced body is unwrapped first. An array is a report of secrets, whose secret is masked; an object with
    runs is SARIF; other objects give no rows, nor does a null.
    """
    body = F.when(F.col("raw").contains("```"), F.regexp_extract("raw", _FENCE, 1)).otherwise(F.trim("raw"))
    parsed = reports.withColumn("body", body).select("repo_id", "body", F.try_parse_json("body").isNotNull().alias("valid"))
    is_list = F.col("body").startswith("[")
    secret = lambda r: F.struct(F.lit("secrets").alias("tool"), r["RuleID"].alias("rule_id"), F.lit("high").alias("severity"), r["File"].alias("path"), r["StartLine"].alias("line_no"), F.when(F.coalesce(r["Secret"], F.lit("")) == "", "[REDACTED]").otherwise(F.replace(r["Match"], r["Secret"], F.lit("[REDACTED]"))).alias("message"))
    place = lambda r: F.get(r["locations"], F.lit(0))["physicalLocation"]
    sarif = lambda r: F.struct(F.lit("sarif").alias("tool"), r["ruleId"].alias("rule_id"), r["level"].alias("severity"), place(r)["artifactLocation"]["uri"].alias("path"), place(r)["region"]["startLine"].alias("line_no"), r["message"]["text"].alias("message"))
    results = F.flatten(F.transform(F.from_json("body", SARIF)["runs"], lambda x: x["results"]))
    found = F.when(~F.col("valid"), F.array(F.struct(F.lit("failed").alias("tool"), *(F.lit(None).cast(t).alias(n) for n, t in (("rule_id", "string"), ("severity", "string"), ("path", "string"), ("line_no", "int"), ("message", "string"))))))
    found = found.when(is_list, F.transform(F.from_json("body", SECRETS), secret)).otherwise(F.transform(results, sarif))
    return parsed.where("body IS NOT NULL").select("repo_id", F.explode(found).alias("r")).select("repo_id", "r.*")
