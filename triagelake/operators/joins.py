"""Joins of findings, plans, components, calls, actions and expectations: equi-joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contained(rows: DataFrame, files: DataFrame, prefix: str) -> DataFrame:
    """rows (repo_id, path, ...) with `known_path`: the path, or the path without prefix, if files has it; else null."""
    stripped = F.regexp_replace("path", f"^{prefix}", "")
    known = files.select("repo_id", F.col("path").alias("known_path")).distinct()
    tried = rows.select("*", F.posexplode(F.array_distinct(F.array("path", stripped))).alias("nth", "known_path"))
    found = tried.join(known.withColumn("is_known", F.lit(True)), ["repo_id", "known_path"], "left")
    keys = [F.col(c) for c in rows.columns]
    return found.groupBy(*keys).agg(F.min_by(F.when(F.col("is_known"), F.col("known_path")), F.when(F.col("is_known"), F.col("nth"))).alias("known_path"))


def planned(plan: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """plan (key, applicable, implemented) with the worst state of its runs; without a run skipped, failed or degraded."""
    state = F.when(~F.col("applicable"), "skipped").when(F.col("implemented"), "failed").otherwise("degraded")
    return plan.join(runs, key, "left").select(key, F.coalesce("state", state).alias("state"))


def _suffixes(name):
    parts = F.split(name, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def by_suffix(components: DataFrame, usages: DataFrame) -> DataFrame:
    """components (component) and usages (usage, ...) where one name equals the other or ends with / and the other.

    Each side's suffixes are looked up as whole names of the other, so no pair is tried that does not match.
    """
    longer = components.select("component", F.explode(F.array_distinct(_suffixes(F.col("component")))).alias("usage"))
    shorter = usages.select("*", F.explode(F.array_distinct(_suffixes(F.col("usage")))).alias("component")).where("component <> usage")
    return usages.join(longer, "usage").unionByName(shorter.join(components, "component").select(*usages.columns, "component"))


def resolved(calls: DataFrame, entities: DataFrame) -> DataFrame:
    """calls (name, symbol, sink, ...) with target and how: the full name, else a symbol only one entity has, else the sink; others leave."""
    full = entities.select(F.col("name"), F.col("name").alias("exact")).distinct()
    lone = entities.groupBy("symbol").agg(F.min("name").alias("lone"), F.count("*").alias("n")).where("n = 1").drop("n")
    found = calls.join(full, "name", "left").join(lone, "symbol", "left")
    how = F.when(F.col("exact").isNotNull(), "name").when(F.col("lone").isNotNull(), "symbol").otherwise("sink")
    return found.withColumn("target", F.coalesce("exact", "lone", "sink")).withColumn("how", how).where("target IS NOT NULL").drop("exact", "lone")


def linked(actions: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """action, hypothesis, n: how many findings both name. Rows are (action, finding_ids) and (hypothesis, finding_ids)."""
    ends = lambda rows, name: rows.select(name, F.explode(F.array_distinct("finding_ids")).alias("finding"))
    return ends(actions, "action").join(ends(hypotheses, "hypothesis"), "finding").groupBy("action", "hypothesis").agg(F.count("*").alias("n"))


def unlinked(actions: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Hypotheses that share no finding with any action. A finding is looked up once, whoever names it."""
    known = actions.select(F.explode("finding_ids").alias("finding")).distinct()
    ends = hypotheses.select("hypothesis", F.explode("finding_ids").alias("finding"))
    return hypotheses.join(ends.join(known, "finding", "left_semi").select("hypothesis").distinct(), "hypothesis", "left_anti")


def expected(expectations: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """key, outcome: matched, missing (no report), repeated (more than one) or unexpected. Both sides are counted first."""
    count = lambda rows, name: rows.groupBy(key).agg(F.count("*").alias(name))
    both = count(expectations, "n_expected").join(count(reports, "n_reports"), key, "full")
    outcome = F.when(F.col("n_expected").isNull(), "unexpected").when(F.col("n_reports").isNull(), "missing").when(F.col("n_reports") > 1, "repeated").otherwise("matched")
    return both.select(key, outcome.alias("outcome"))


def labelled(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges (a, b, ...) with the labels of both ends from nodes (node, label); the id where there is none."""
    out = edges
    for end in ("a", "b"):
        out = out.join(nodes.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")), end, "left").withColumn(f"{end}_label", F.coalesce(f"{end}_label", end))
    return out


def audited(inventory: DataFrame, policy: DataFrame, key: str) -> DataFrame:
    """key, n, status: covered, gap (no policy) or unused (a policy for nothing). The inventory is counted before it is joined."""
    both = inventory.groupBy(key).agg(F.count("*").alias("n")).join(policy.select(key, F.lit(True).alias("has_policy")).distinct(), key, "full")
    status = F.when(F.col("n").isNull(), "unused").when(F.col("has_policy"), "covered").otherwise("gap")
    return both.select(key, F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))
