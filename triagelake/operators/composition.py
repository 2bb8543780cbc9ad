"""Contexts, hypotheses, recipes and action groups of findings, in two passes over written results."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.sources.shared import written

from . import assessment, correlation, integrity

_STRINGS = "array<string>"
LINKS = "graph_id string, finding_id string, hypothesis_id string, node_ids array<string>, edge_ids array<string>"
UNAVAILABLE = "Deep Static graph context was unavailable for this finding."


class Unsound(Exception):
    """A pass gave records that do not hold together."""


#: What ends a pass: an error of Spark, in its plan or in a task, or records that do not hold together.
FAILURES = (PySparkException, Py4JJavaError, Unsound)


def standalone(findings: DataFrame) -> DataFrame:
    """Contexts that say nothing, for when there is no graph to ask."""
    none = F.array().cast(_STRINGS)
    return findings.select("graph_id", "finding_id").distinct().select("graph_id", "finding_id", F.lit("standalone").alias("status"), none.alias("node_ids"), none.alias("edge_ids"), none.alias("hypothesis_ids"), F.lit(UNAVAILABLE).alias("reason"), F.lit("failed").alias("state"))


def links(hypotheses: DataFrame, candidates: DataFrame) -> DataFrame:
    """graph_id, finding_id, hypothesis_id, node_ids, edge_ids: the findings of hypotheses that nothing contradicts, with the path that supports them."""
    on = candidates.select("graph_id", "candidate_id", F.col("supporting_node_ids").alias("node_ids"), F.col("supporting_edge_ids").alias("edge_ids"))
    rows = hypotheses.where("status <> 'statically_contradicted'").select("graph_id", "candidate_id", "hypothesis_id", F.explode("finding_ids").alias("finding_id"))
    return rows.join(on, ["graph_id", "candidate_id"]).select("graph_id", "finding_id", "hypothesis_id", "node_ids", "edge_ids")


def _sound(violations: DataFrame, what: str) -> None:
    first = violations.limit(1).collect()
    if first:
        raise Unsound(f"{what} {first[0]['record_id']} {first[0]['message']}")


def _why(what: str, e: Exception) -> str:
    return f"{what} failed: {(str(e).splitlines() or [type(e).__name__])[0][:200]}"


def _contexts(findings, nodes, edges, flows, components, of, failures: list[str] | None = None) -> DataFrame:
    """Contexts, or standalone ones where they cannot be made or do not hold together; why is added to failures."""
    try:
        made = written(assessment.contexts(findings, nodes, edges, flows, components, of), "contexts")
        _sound(integrity.contexts(made, findings), "context of")
    except FAILURES as e:
        if failures is not None:
            failures.append(_why("context assessment", e))
        return written(standalone(findings), "contexts")
    return made


def composed(findings: DataFrame, nodes: DataFrame, edges: DataFrame, flows: DataFrame, components: DataFrame, coverage: DataFrame, actions: DataFrame, hints: DataFrame, rules: tuple[correlation.Rule, ...] = correlation.RULES) -> tuple[dict[str, DataFrame], str | None]:
    """contexts, candidates, hypotheses, recipes and groups, all written, and why they are those of a failure, else null.

    The first pass reads the graph without hypotheses; candidates take findings from its written contexts,
    hypotheses are judged from the candidates, and the second pass reads the graph with the links of those
    hypotheses. Recipes and groups follow. Contexts that cannot be made or do not hold together are standalone in
    their pass; standalone contexts name no findings, so candidates that need one are missing, and the reason
    says that this is no result. Candidates, hypotheses, recipes and groups are checked too; if any of
    them cannot be made or does not hold together, all of it goes: contexts are standalone, there are no
    candidates, hypotheses and recipes, and groups are those of actions alone. Empty tables give empty
    results; findings are (graph_id, finding_id, node_id), other tables as in operators/assessment.
    """
    spark = findings.sparkSession
    none = F.array().cast(_STRINGS)
    failures: list[str] = []
    first = _contexts(findings, nodes, edges, flows, components, spark.createDataFrame([], LINKS), failures)
    try:
        known = first.select("graph_id", "finding_id", "status", "node_ids", "edge_ids")
        candidates = correlation.with_context(correlation.merged(written(correlation.candidates(nodes, edges, known, coverage, rules), "candidates")))
        candidates = written(candidates, "candidates")
        _sound(integrity.candidates(candidates, findings, nodes, edges), "candidate")
        hypotheses = written(assessment.static_hypotheses(candidates, nodes, edges), "hypotheses")
        _sound(integrity.hypotheses(hypotheses, candidates), "hypothesis")
        second = _contexts(findings, nodes, edges, flows, components, links(hypotheses, candidates), failures)
        recipes = written(assessment.recipes(hypotheses, hints), "recipes")
        _sound(integrity.recipes(recipes, hypotheses), "recipe of")
        groups = written(assessment.action_groups(actions, hypotheses, second), "groups")
        _sound(integrity.groups(groups, actions), "group")
        return {"contexts": second, "candidates": candidates, "hypotheses": hypotheses, "recipes": recipes, "groups": groups}, "; ".join(failures) or None
    except FAILURES as e:
        reason = "; ".join([*failures, _why("hypothesis composition", e)])
    ids = {c: none for c in ("required_validation", "finding_ids", "supporting_evidence_ids", "contradicting_evidence_ids")}
    blank = findings.where("false").select("graph_id", *(F.lit(None).cast("string").alias(c) for c in ("hypothesis_id", "candidate_id", "family", "rule_id", "title", "status", "state", "summary")), F.lit(None).cast("double").alias("confidence"), *(v.alias(c) for c, v in ids.items()))
    alone = written(standalone(findings), "contexts")
    groups = written(assessment.action_groups(actions, blank, alone), "groups")
    lost = findings.where("false").select("graph_id", *(F.lit(None).cast("string").alias(c) for c in ("candidate_id", "rule_id", "family", "title", "reason")))
    return {"contexts": alone, "candidates": lost, "hypotheses": blank, "recipes": assessment.recipes(blank, hints.where("false")), "groups": groups}, reason
