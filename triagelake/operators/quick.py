"""Quick-scan results: findings with evidence from candidates, clusters, actions, verdicts, remediation texts.

A repository is bounded by the limits of its snapshot (sources/corpus), so lists of ids are gathered for each repository
and key, never for a key over all repositories.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions import findings as fn
from triagelake.functions import paths

#: Categories by the prefix of a check, and the key of what mends a category.
CATEGORIES = {"code-patterns.": "code-pattern", "dependencies.": "dependency", "github-actions.": "github-action", "iac.": "iac", "sbom.": "sbom", "secrets.": "secret"}
REMEDIATIONS = {"secret": "live-secret-in-source", "dependency": "dependency-vulnerability", "github-action": "github-actions-hardening", "iac": "iac-hardening", "sbom": "sbom-inventory-review", "code-pattern": "code-pattern-review"}
#: The tool behind each check whose database can be stale.
CHECK_TOOLS = {"dependencies.trivy": "trivy", "iac.trivy-config": "trivy", "secrets.gitleaks": "gitleaks", "code-patterns.opengrep": "opengrep", "sbom.syft": "syft", "github-actions.actionlint": "actionlint", "github-actions.zizmor": "zizmor"}
#: The second set of redactions, in order.
PERSONAL = (
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "***REDACTED***"), (r"\b(?:sk|ghp|github_pat|AKIA|AIza)[A-Za-z0-9_-]{12,}\b", "***REDACTED***"),
    (r"(?i)\b((?:api[_-]?key|access[_-]?token|auth[_-]?token|token|secret|password|passwd|pwd)\s*[:=]\s*[\"']?)[^\"',\s\\]{8,}", "$1***REDACTED***"),
)
_AGAIN = "Run the scan again."
#: Texts of remediations by key: title, risk, first fix step (the place follows), instruction, first check.
TEXTS = {
    "live-secret-in-source": ("Remove the committed secret", "A secret-looking credential is present in source code. Anyone with repository access or a leaked copy could reuse it.", "Remove the secret from ", "Do not print, log, or keep the secret value anywhere in code, tests, comments, or docs.", "Run the app's tests or typecheck."),
    "dependency-vulnerability": ("Review the vulnerable dependency", "A dependency scanner reported a vulnerable package or dependency manifest.", "Review the dependency finding at ", "Inspect the dependency manifest or lockfile, apply the smallest safe upgrade/removal, and explain any compatibility risk.", "Run the package manager install/check command."),
    "github-actions-hardening": ("Harden the GitHub Actions workflow", "A workflow scanner reported a CI/CD configuration issue that can weaken repository or deployment security.", "Review the workflow finding at ", "Patch the workflow YAML with least privilege and safe expression handling; do not broaden permissions to silence the scanner.", "Run actionlint or the workflow parser locally."),
    "iac-hardening": ("Fix the infrastructure configuration issue", "An IaC scanner reported a configuration that may expose infrastructure or weaken runtime isolation.", "Review the IaC finding at ", "Patch the IaC file to satisfy the reported rule while preserving the intended deployment shape.", "Run the IaC validation or plan command if available."),
    "": ("Review the static analysis finding", "A code scanner reported a pattern that can become a security issue.", "Review the scanner finding at ", "Refactor the reported code pattern into a safer equivalent and keep the diff narrow.", "Run the relevant test or typecheck."),
}


def category(check: Column) -> Column:
    return reduce(lambda out, kv: F.when(check.startswith(kv[0]), kv[1]).otherwise(out), CATEGORIES.items(), F.lit("code-pattern"))


def remediation_key(category_: Column) -> Column:
    return reduce(lambda out, kv: F.when(category_ == kv[0], kv[1]).otherwise(out), REMEDIATIONS.items(), F.lit(REMEDIATIONS["code-pattern"]))


def severity(raw: Column, category_: Column) -> Column:
    low = F.lower(raw)
    named = F.when(low == "critical", "critical").when(low.isin("high", "error"), "high").when(low.isin("medium", "warning"), "medium").when(low.isin("low", "note"), "low")
    return F.coalesce(named, F.when(category_.isin("github-action", "iac"), "medium").otherwise("unknown"))


def without_personal(text: Column) -> Column:
    """E-mail addresses, provider tokens and values of secrets masked, in that order."""
    return reduce(lambda out, r: F.regexp_replace(out, F.lit(r[0]), F.lit(r[1])), PERSONAL, text)


def found(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of candidates (repo_id, check, tool, stage_ord, ord, rule_id, message, path, line_no, severity): the first of each fingerprint.

    A path is looked up with and without the source directory's own name; candidates without a path, of other files
    (see outside) or of quiet rules are no findings.
    """
    rows = _resolved(candidates, files).where("known_path IS NOT NULL")
    rule = F.coalesce("rule_id", F.concat("tool", F.lit("-finding")))
    line = F.when(F.col("line_no") > 0, F.col("line_no")).otherwise(1)
    rows = rows.withColumns({"rule_id": rule, "line": line.cast("long"), "path": F.col("known_path"), "category": category(F.col("check"))})
    rows = rows.where(~paths.is_quiet(F.col("tool"), F.col("rule_id"), F.col("path")))
    rows = rows.withColumn("snippet", F.concat("rule_id", F.lit(": "), F.coalesce("message", F.concat("tool", F.lit(" reported "), "rule_id")))).withColumn("hash", F.sha2("snippet", 256))
    parts = (F.col("tool"), F.col("rule_id"), F.col("path"), F.col("line"), F.col("hash"))
    rows = rows.withColumns({"fingerprint": fn.stable_id("fp", *parts), "evidence_id": fn.stable_id("ev", *parts), "severity": severity(F.col("severity"), F.col("category"))})
    first = F.row_number().over(Window.partitionBy("repo_id", "fingerprint").orderBy("stage_ord", "ord"))
    rows = rows.withColumn("nth", first).where("nth = 1")
    return rows.select("repo_id", fn.stable_id("finding", F.col("fingerprint")).alias("finding_id"), "tool", "rule_id", "category", "severity", "path", "line", "snippet", "evidence_id", "fingerprint", remediation_key(F.col("category")).alias("remediation_key"), F.struct("stage_ord", "ord").alias("at"))


def _resolved(candidates: DataFrame, files: DataFrame) -> DataFrame:
    base = paths.SOURCE_DIR.rsplit("/", 1)[1]
    known = files.select("repo_id", F.col("path").alias("one"), F.lit(True).alias("has_one"))
    two = known.withColumnsRenamed({"one": "two", "has_one": "has_two"})
    rows = candidates.where("path IS NOT NULL").withColumns({"one": F.col("path"), "two": F.regexp_replace("path", f"^{base}/", "")})
    rows = rows.join(known, ["repo_id", "one"], "left").join(two, ["repo_id", "two"], "left")
    return rows.withColumn("known_path", F.when(F.col("has_one"), F.col("one")).when(F.col("has_two"), F.col("two"))).drop("has_one", "has_two", "one", "two")


def outside(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """repo_id, tool, path of candidates that point outside their snapshot."""
    return _resolved(candidates, files).where("known_path IS NULL").select("repo_id", "tool", "path").distinct()


def _worst(column: str = "severity") -> Column:
    return F.max_by(column, fn.severity_rank(F.col(column)))


def _ordered(*columns: str) -> Column:
    """Records of columns in the order of `at`, gathered and sorted once for all of them."""
    return F.sort_array(F.collect_list(F.struct("at", *columns)))


def clusters(findings: DataFrame) -> DataFrame:
    """repo_id, cluster_id, category, finding_ids in order, max_severity: of a category, key and file."""
    out = findings.groupBy("repo_id", "category", "remediation_key", "path").agg(_ordered("finding_id")["finding_id"].alias("finding_ids"), _worst().alias("max_severity"))
    return out.select("repo_id", fn.stable_id("cluster", F.col("category"), F.col("remediation_key"), F.col("path")).alias("cluster_id"), "category", "path", "finding_ids", "max_severity")


def actions(findings: DataFrame) -> DataFrame:
    """repo_id, action_id (of the sorted fingerprints), key, score of the worst severity and the first finding's category, ids, files, impact, rules, first place, rank."""
    grouped = findings.groupBy("repo_id", "remediation_key").agg(
        F.sort_array(F.collect_list("fingerprint")).alias("fingerprints"), _worst().alias("severity"), F.min_by("category", "at").alias("category"), _ordered("finding_id", "evidence_id", "path", "rule_id").alias("all"), F.min_by(F.concat("path", F.lit(":"), F.col("line").cast("string")), "at").alias("place"),
    )
    score = fn.priority(F.col("severity"), F.col("category"))
    rows = grouped.select(
        "repo_id", fn.stable_id("action", F.array_join("fingerprints", "\0")).alias("action_id"), "remediation_key", score.alias("score"), "severity", F.col("all.finding_id").alias("finding_ids"), F.array_distinct("all.evidence_id").alias("evidence_ids"), F.array_distinct("all.path").alias("files"), fn.verdict_impact(F.col("severity")).alias("impact"), F.array_distinct("all.rule_id").alias("rules"), "place",
    )
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("score"), "remediation_key")))


def locations(actions_: DataFrame, findings: DataFrame) -> DataFrame:
    """repo_id, action_id, nth, place: distinct `path:line` of an action's findings, in the order of its findings.

    A place is one row before it meets its action, and lists of findings are not gathered for it.
    """
    key = ["repo_id", "remediation_key"]
    first = findings.groupBy(*key, F.concat("path", F.lit(":"), F.col("line").cast("string")).alias("place")).agg(F.min(F.struct("at", "finding_id")).alias("first"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("first"))
    return actions_.select(*key, "action_id").join(first.withColumn("nth", nth), key).select("repo_id", "action_id", "nth", "place")


def remediations(actions_: DataFrame) -> DataFrame:
    """repo_id, action_id, title, risk, first_step, prompt, check from the catalog, with the action's first place and its rules."""
    key = F.col("remediation_key")
    text = lambda k: reduce(lambda out, kv: F.when(key == kv[0], kv[1][k]).otherwise(out), TEXTS.items(), F.lit(TEXTS[""][k]))
    prompt = F.concat(text(0), F.lit(" at "), "place", F.lit(" (detected rule: "), F.array_join("rules", ", "), F.lit(").\n"), text(3))
    return actions_.select("repo_id", "action_id", text(0).alias("title"), text(1).alias("risk"), F.concat(text(2), "place", F.lit(".")).alias("first_step"), prompt.alias("prompt"), F.concat_ws(" ", text(4), F.lit(_AGAIN)).alias("checks"))


def stale(coverage: DataFrame, tools: DataFrame) -> DataFrame:
    """Coverage (repo_id, check, status, reason) with checks degraded whose tool's (repo_id, tool, stale) database is stale."""
    of = reduce(lambda out, kv: F.when(F.col("check") == kv[0], kv[1]).otherwise(out), CHECK_TOOLS.items(), F.lit(None).cast("string"))
    rows = coverage.withColumn("tool", of).join(tools.where("stale").select("repo_id", "tool", "stale").distinct(), ["repo_id", "tool"], "left")
    hit = (F.col("status") == "checked") & F.col("stale").isNotNull()
    return rows.select("repo_id", "check", F.when(hit, "degraded").otherwise(F.col("status")).alias("status"), F.when(hit, F.concat("tool", F.lit(" database freshness is stale; refresh failed before scan"))).otherwise(F.col("reason")).alias("reason"))


def verdicts(repositories: DataFrame, findings: DataFrame, coverage: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """repo_id, verdict of every repository: a supported hypothesis outweighs even a critical finding, lost coverage counts only without findings."""
    worst = findings.groupBy("repo_id").agg(F.max(F.col("severity") == "critical").alias("critical"))
    lost = coverage.groupBy("repo_id").agg(F.max(F.col("status").isin("failed", "degraded")).alias("lost"))
    proven = hypotheses.where("status = 'statically_supported'").select("repo_id").distinct().withColumn("supported", F.lit(True))
    rows = repositories.select("repo_id").distinct().join(worst, "repo_id", "left").join(lost, "repo_id", "left").join(proven, "repo_id", "left")
    verdict = F.when(F.col("supported"), "not-ready-to-deploy").when(F.col("critical"), "critical-fix-needed").when(F.col("critical").isNotNull(), "not-ready-to-deploy").when(F.col("lost"), "scan-incomplete").otherwise("looks-ok-for-now")
    return rows.select("repo_id", verdict.alias("verdict"))


def limitations(coverage: DataFrame) -> DataFrame:
    """repo_id, text: one sentence for each coverage entry (area, state, reason) that is not checked."""
    tail = F.when(F.col("reason").isNull(), ".").otherwise(F.concat(F.lit(": "), "reason"))
    return coverage.where("state <> 'checked'").select("repo_id", F.concat(F.lit("Deep Static "), "area", F.lit(" coverage is "), "state", tail).alias("text"))


def replaced(coverage: DataFrame, new: DataFrame) -> DataFrame:
    """coverage with the rows of `new` in place of those of the same graph, area and producer."""
    key = ["graph_id", "area", "producer"]
    return coverage.join(new.select(*key).distinct(), key, "left_anti").unionByName(new.select(*coverage.columns))


def repository(sources: DataFrame) -> DataFrame:
    """name, origin_url, local_path, commit of sources (kind, url, path, origin_url, manifest_origin, commit)."""
    github = F.col("kind") == "github"
    last = lambda c: F.element_at(F.split(F.regexp_replace(c, r"(\.git)?/*$", ""), "/"), -1)
    return sources.select("repo_id", F.when(github, last("url")).otherwise(last("path")).alias("name"), F.when(github, F.col("url")).otherwise(F.coalesce("origin_url", "manifest_origin")).alias("origin_url"), F.when(~github, F.col("path")).alias("local_path"), "commit")


def attack_paths(hypotheses: DataFrame) -> DataFrame:
    """Hypotheses that are not contradicted, the most confident of each family and reason without places. hypotheses: repo_id, hypothesis_id, family, title, reason, status, confidence."""
    key = F.regexp_replace("reason", r"\s\([^()\n]+:\d+\)", "")
    first = F.row_number().over(Window.partitionBy("repo_id", "family", "key").orderBy(F.desc("confidence"), "title", "hypothesis_id"))
    return hypotheses.where("status <> 'statically_contradicted'").withColumn("key", key).withColumn("nth", first).where("nth = 1").drop("key", "nth")


def signals(hypotheses: DataFrame, evidence: DataFrame) -> DataFrame:
    """repo_id, hypothesis_id, nth, tool, place: distinct tools and places of a hypothesis's evidence, in its order. evidence: repo_id, evidence_id, tool, path, line."""
    each = hypotheses.select("repo_id", "hypothesis_id", F.posexplode("supporting_evidence_ids").alias("ord", "evidence_id")).join(evidence.select("repo_id", "evidence_id", "tool", F.concat("path", F.lit(":"), F.col("line").cast("string")).alias("place")), ["repo_id", "evidence_id"])
    first = each.groupBy("repo_id", "hypothesis_id", "tool", "place").agg(F.min("ord").alias("ord"))
    return first.select("repo_id", "hypothesis_id", F.row_number().over(Window.partitionBy("repo_id", "hypothesis_id").orderBy("ord")).alias("nth"), "tool", "place")


def with_evidence(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """repo_id, finding_id, evidence_id, tool, place, snippet of every evidence id that a finding lists."""
    each = findings.select("repo_id", "finding_id", F.explode("evidence_ids").alias("evidence_id"))
    return each.join(evidence, ["repo_id", "evidence_id"]).select("repo_id", "finding_id", "evidence_id", "tool", F.concat("path", F.lit(":"), F.col("line").cast("string")).alias("place"), "snippet")
