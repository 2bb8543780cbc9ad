"""What a repository holds: languages, manifests, workflows, and the checks that apply to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.functions import findings as fn
from triagelake.functions import paths

_MANIFESTS, _WORKFLOWS = "no dependency manifests found", "no GitHub Actions workflows found"
#: Checks in their order: name, tool, what they need, why they do not apply.
CHECKS = (
    ("secrets.gitleaks", "gitleaks", "nothing", None), ("code-patterns.opengrep", "opengrep", "code", "no supported source code files found"), ("sbom.syft", "syft", "manifests", _MANIFESTS), ("dependencies.trivy", "trivy", "manifests", _MANIFESTS),
    ("dependencies.osv", "osv", "manifests", _MANIFESTS), ("github-actions.actionlint", "actionlint", "workflows", _WORKFLOWS), ("github-actions.zizmor", "zizmor", "workflows", _WORKFLOWS), ("iac.trivy-config", "trivy", "infra", "no IaC files found"),
)


def summary(files: DataFrame) -> DataFrame:
    """repo_id, sorted lists of languages, package_manifests, workflows and infra_files, and n_code_files."""
    path, language = F.col("path"), fn.language(F.col("path"))
    listed = lambda flag: F.array_sort(F.collect_set(F.when(flag, path)))
    return files.groupBy("repo_id").agg(
        F.array_sort(F.collect_set(language)).alias("languages"), listed(paths.is_manifest(path)).alias("package_manifests"), listed(paths.is_workflow(path)).alias("workflows"),
        listed(paths.is_infra(path)).alias("infra_files"), F.count(language).alias("n_code_files"),
    )


def scan_plan(inventory: DataFrame) -> DataFrame:
    """repo_id, ord, check, tool, applicable, required, implemented, reason: eight checks for each repository."""
    has = {"code": F.col("n_code_files") > 0, "manifests": F.size("package_manifests") > 0, "workflows": F.size("workflows") > 0, "infra": F.size("infra_files") > 0, "nothing": F.lit(True)}
    rows = F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(check).alias("check"), F.lit(tool).alias("tool"), has[needs].alias("applicable"), F.lit(why).cast("string").alias("why")) for k, (check, tool, needs, why) in enumerate(CHECKS)))
    each = inventory.select("repo_id", F.explode(rows).alias("x")).select("repo_id", "x.*")
    return each.select("repo_id", "ord", "check", "tool", "applicable", F.lit(True).alias("required"), F.lit(True).alias("implemented"), F.when(~F.col("applicable"), F.col("why")).alias("reason"))


def language_support(files: DataFrame) -> DataFrame:
    """repo_id, supported and unsupported (sorted `language=files`), n_source_files, state."""
    path = F.col("path")
    known = files.select("repo_id", paths.supported(path).alias("good"), paths.unsupported(path).alias("bad"))
    counts = known.groupBy("repo_id", F.col("good").isNotNull().alias("is_good"), F.coalesce("good", "bad").alias("language")).agg(F.count("*").alias("files"))
    entry = F.struct("language", F.concat("language", F.lit("="), F.col("files").cast("string")).alias("text"))
    side = lambda good: F.transform(F.array_sort(F.collect_list(F.when(F.col("language").isNotNull() & (F.col("is_good") == good), entry))), lambda x: x["text"])
    out = counts.groupBy("repo_id").agg(side(True).alias("supported"), side(False).alias("unsupported"), F.coalesce(F.sum(F.when(F.col("language").isNotNull(), F.col("files"))), F.lit(0)).alias("n_source_files"))
    some, other = F.size("supported") > 0, F.size("unsupported") > 0
    return out.withColumn("state", F.when(some & other, "partial").when(some, "checked").when(other, "degraded").otherwise("skipped"))
