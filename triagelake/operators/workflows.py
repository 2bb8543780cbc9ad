"""CI workflows as tables: names, triggers, steps, token permissions and artifacts, from lines of their files.

Input is a table (repo_id, path, n, line) of workflow files. A window never spans more than one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions import findings as fn
from triagelake.functions import paths

FILE = ("repo_id", "path")
#: Events that trigger a workflow.
EVENTS = (
    "branch_protection_rule", "check_run", "check_suite", "create", "delete", "deployment", "deployment_status", "discussion", "fork", "gollum", "issue_comment", "issues", "label", "merge_group", "milestone", "page_build", "project",
    "project_card", "project_column", "public", "pull_request", "pull_request_review", "pull_request_review_comment", "pull_request_target", "push", "registry_package", "release", "repository_dispatch", "schedule", "status", "watch", "workflow_call", "workflow_dispatch", "workflow_run",
)
#: Scopes of a workflow's token.
SCOPES = ("actions", "attestations", "checks", "contents", "deployments", "discussions", "id-token", "issues", "packages", "pages", "pull-requests", "repository-projects", "security-events", "statuses")
PERMISSION = rf"(?i)^\s*({'|'.join(SCOPES)})\s*:\s*(read|write|none)\b"
UPLOAD, REACH_BACK, REACH_ON = "actions/upload-artifact", 4, 11


def scalar(value: Column) -> Column:
    """A YAML scalar without its quotes and comment; null if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(value), "^[\"']|[\"']$", ""), r"\s+#.*$", "")
    return F.when(~bare.isin("", "{}"), bare)


def value(line: Column, key: str) -> Column:
    return scalar(F.regexp_extract(line, rf"^\s*-?\s*{key}\s*:\s*(.+?)\s*$", 1))


def evidence(kind: str, body: Column) -> Column:
    return fn.stable_id("ci_iac", F.lit(kind), F.col("path"), body)


def names(lines: DataFrame) -> DataFrame:
    """repo_id, path, name, n_lines: the first `name:` of a file, else its stem."""
    plain = F.regexp_extract("line", r"^\s*name\s*:\s*(.+?)\s*$", 1)
    first = F.min_by(plain, F.when(plain != "", F.col("n")))
    return lines.groupBy(*FILE).agg(F.coalesce(scalar(first), paths.stem(F.first("path"))).alias("name"), F.max("n").alias("n_lines"))


def triggers(lines: DataFrame) -> DataFrame:
    """repo_id, path, event, n, evidence_id: known events after `on:` or as an indented key; the last line wins."""
    inline = scalar(F.regexp_extract("line", r"^\s*on\s*:\s*(.+?)\s*$", 1))
    listed = F.when(inline.startswith("[") & inline.endswith("]"), F.transform(F.split(F.substring(inline, 2, 100_000), ","), lambda x: scalar(F.regexp_replace(x, r"\]\s*$", "")))).when(inline.isNotNull(), F.array(inline))
    block = F.array(F.regexp_extract("line", r"^\s{2,}([A-Za-z_][\w-]*)\s*:", 1))
    found = lines.select(*FILE, "n", "line", F.explode(F.concat(F.coalesce(listed, F.array().cast("array<string>")), block)).alias("event")).where(F.col("event").isin(*EVENTS))
    last = F.max_by(F.struct("n", "line"), "n").alias("at")
    return found.groupBy(*FILE, "event").agg(last).select(*FILE, "event", "at.n", evidence("workflow-trigger", F.col("at.line")).alias("evidence_id"))


def steps(lines: DataFrame) -> DataFrame:
    """repo_id, path, n, step_id, name, uses, run, pinned, evidence_id: one row for each `uses:` or `run:` line.

    The name is looked for in the line and the four before it.
    """
    near = Window.partitionBy(*FILE).orderBy("n").rowsBetween(-REACH_BACK, 0)
    rows = lines.withColumns({"uses": value(F.col("line"), "uses"), "run": value(F.col("line"), "run"), "named": F.last(value(F.col("line"), "name"), ignorenulls=True).over(near)})
    rows = rows.where("uses IS NOT NULL OR run IS NOT NULL").withColumn("what", F.coalesce("uses", "run"))
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower("what"), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 40)
    return rows.select(*FILE, "n", F.concat(F.col("n").cast("string"), F.lit("-"), slug).alias("step_id"), F.coalesce("named", "what").alias("name"), "uses", "run", is_pinned(F.col("uses")).alias("pinned"), evidence("workflow-step", F.col("line")).alias("evidence_id"))


def is_pinned(uses: Column) -> Column:
    """An action named by a whole commit hash."""
    return uses.rlike("(?i)@[0-9a-f]{40}$")


def permissions(lines: DataFrame, found: DataFrame) -> DataFrame:
    """repo_id, path, n, scope, access, step_id, evidence_id: rights of the token, held by the file's first step, if any."""
    first = found.groupBy(*FILE).agg(F.min_by("step_id", "n").alias("step_id"))
    scope = F.lower(F.regexp_extract("line", PERMISSION, 1))
    rows = lines.withColumns({"scope": scope, "access": F.lower(F.regexp_extract("line", PERMISSION, 2))}).where("scope <> ''")
    return rows.join(first, [*FILE], "left").select(*FILE, "n", "scope", "access", "step_id", evidence("workflow-token", F.col("line")).alias("evidence_id"))


def artifacts(lines: DataFrame, found: DataFrame) -> DataFrame:
    """repo_id, path, n, step_id, name, artifact_path: uploads, named in the step's line and the eleven after it."""
    ahead = Window.partitionBy(*FILE).orderBy("n").rowsBetween(0, REACH_ON)
    first = lambda key: F.first(value(F.col("line"), key), ignorenulls=True).over(ahead)
    around = lines.select(*FILE, "n", first("name").alias("named"), first("path").alias("artifact_path"))
    uploads = found.where(F.lower("uses").contains(UPLOAD)).select(*FILE, "n", "step_id")
    name = F.coalesce("named", "artifact_path", F.concat(F.lit("artifact-"), F.col("step_id")))
    return uploads.join(around, [*FILE, "n"]).select(*FILE, "n", "step_id", name.alias("name"), "artifact_path")
