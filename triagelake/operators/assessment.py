"""Contexts of findings, static hypotheses, groups of actions, validation recipes and the map of a repository.

Tables, all with graph_id: findings (finding_id, node_id); edges (edge_id, kind, from_id, to_id, state); nodes (node_id,
kind, label, state); flows (flow_id, source_id, sink_id, edge_ids, control_ids, state); components (component_id,
level, path_edge_ids, finding_ids, state); links (finding_id, hypothesis_id, node_ids, edge_ids).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions import findings as fn
from triagelake.sources.shared import written

from . import hypotheses

#: Coverage states from worst to best; levels of components that corroborate a finding.
STATES = ("failed", "degraded", "partial", "skipped", "checked")
CORROBORATING = ("imported", "used", "reachable_from_boundary", "affected_symbol_reachable")
#: Groups of kinds in the map of a repository, and areas that should be covered.
GROUPS = {"boundaries": ("Boundary",), "codeEntities": ("CodeEntity",), "integrations": ("Component", "ExternalService"), "dataStores": ("DataStore",), "ciIacResources": ("BuildStep", "InfraResource"), "resources": ("Resource",), "securityFacts": ("Source", "Sink", "Control", "Flow", "Finding", "Secret")}
AREAS = ("boundaries", "call_graph", "data_flow", "dependency_usage", "ci_iac", "content_assets", "smart_contracts", "language_support")
#: Texts of recipes.
SAFETY = ("Run only in an isolated disposable environment, never against production systems or real customer data.", "Use least-privilege credentials and reversible fixture changes only.")
EXPECTED = {
    "statically_supported": "Future runtime validation should gather controlled evidence for or against the statically supported path; this recipe does not claim runtime confirmation.",
    "inconclusive": "Future runtime validation should determine whether the unobserved control exists on the analyzed path; this recipe does not claim runtime confirmation.",
    "candidate": "Future runtime validation should prove or disprove this candidate before remediation priority changes; this recipe does not claim runtime confirmation.",
}
#: Status and reason of each kind of context, the first that a finding has decides.
CONTEXTS = (
    ("contradicted", "explicit graph contradiction is attached to the finding context"), ("linked_to_hypothesis", "linked to deterministic hypothesis context"), ("corroborated", "finding is supported by explicit graph context"),
    ("corroborated", "finding subject appears on a checked security-flow path"), ("corroborated", "component reachability corroborates the dependency finding"), ("weakened", "component is present but no import, use, or boundary reachability was observed"),
    ("weakened", "finding subject has explicit protective-control context"), ("standalone", "no qualifying graph, reachability, or hypothesis context found"),
)
NONE = len(CONTEXTS) - 1
KEY = ["graph_id", "finding_id"]
_STRINGS = "array<string>"


def worst(states: Column) -> Column:
    """The worst of an array of coverage states; checked if there is none."""
    out = F.lit("checked")
    for state in reversed(STATES):
        out = F.when(F.array_contains(states, state), state).otherwise(out)
    return out


def _all(column: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(column)))).alias(column)


def _touching(edges: DataFrame, kind: str) -> DataFrame:
    """Edges of a kind at each node that is an end of some, as lists."""
    ends = edges.where(F.col("kind") == kind).select("graph_id", "edge_id", "state", F.array("from_id", "to_id").alias("ends"))
    return ends.select("*", F.explode(F.array_distinct("ends")).alias("node_id")).groupBy("graph_id", "node_id").agg(
        F.array_distinct(F.flatten(F.collect_set("ends"))).alias("node_ids"), F.collect_set("edge_id").alias("edge_ids"), F.collect_set("state").alias("states")
    )


def subjects(findings: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, finding_id, node_id: what a finding affects."""
    affected = edges.where("kind = 'affects'").select("graph_id", F.col("from_id").alias("node_id"), "to_id")
    return findings.select("graph_id", "finding_id", "node_id").join(affected, ["graph_id", "node_id"]).select("graph_id", "finding_id", F.col("to_id").alias("node_id")).distinct()


def touched_flows(of: DataFrame, flows: DataFrame, edges: DataFrame) -> DataFrame:
    """For each finding with subjects (graph_id, finding_id, node_id) the first checked flow, by id, that a subject is an end, a control or a step of."""
    checked = flows.where("state = 'checked'")
    return _first_flows(of, checked, checked.select("graph_id", "flow_id", F.explode("edge_ids").alias("edge_id")).join(edges.select("graph_id", "edge_id", "from_id", "to_id"), ["graph_id", "edge_id"]))


def _first_flows(of: DataFrame, checked: DataFrame, steps: DataFrame) -> DataFrame:
    """The first flow of each node, then of each finding: a node's flows do not meet its findings one by one."""
    on = checked.select("graph_id", "flow_id", F.explode(F.concat(F.array("source_id", "sink_id"), "control_ids")).alias("node_id")).unionByName(steps.select("graph_id", "flow_id", F.explode(F.array("from_id", "to_id")).alias("node_id")))
    first = on.groupBy("graph_id", "node_id").agg(F.min("flow_id").alias("flow_id"))
    return of.join(first, ["graph_id", "node_id"]).groupBy(*KEY).agg(F.min("flow_id").alias("flow_id"))


def contexts(findings: DataFrame, nodes: DataFrame, edges: DataFrame, flows: DataFrame, components: DataFrame, links: DataFrame, flow_edges: DataFrame | None = None) -> DataFrame:
    """One row for each finding: status, node_ids, edge_ids, hypothesis_ids, reason, state. What contradicts comes before links, corroboration and weakening.

    Of nodes only those that a supported_by edge leads to are read; flow_edges are the edges that flows may name, where not
    all may be. What a finding may be is gathered once, by finding, and only
    findings that nothing else decides are looked up among protected nodes.
    """
    none = F.array().cast(_STRINGS)
    own = written(subjects(findings, edges), "subjects")
    roots = findings.select(*KEY, "node_id").unionByName(own)
    plain = nodes.where("kind <> 'Finding'").select("graph_id", F.col("node_id").alias("to_id"))
    supports = edges.where("kind = 'supported_by'").join(plain, ["graph_id", "to_id"], "left_semi").select("graph_id", F.col("from_id").alias("node_id"), F.array("from_id", "to_id").alias("node_ids"), F.array("edge_id").alias("edge_ids"), F.array("state").alias("states"))
    checked = F.col("state") == "checked"
    ends = (edges if flow_edges is None else flow_edges).select("graph_id", "edge_id", "from_id", "to_id", F.col("state").alias("step_state"))
    steps = flows.select("graph_id", "flow_id", checked.alias("checked"), F.explode("edge_ids").alias("edge_id")).join(ends, ["graph_id", "edge_id"])
    steps = written(steps, "flow-steps")
    states = steps.groupBy("graph_id", "flow_id").agg(F.collect_set("step_state").alias("states"), F.collect_set("edge_id").alias("step_ids"))
    touched = _first_flows(own, flows.where(checked), steps.where("checked"))
    touched = touched.join(flows.select("graph_id", "flow_id", F.concat(F.array("source_id", "sink_id"), "control_ids").alias("node_ids")), ["graph_id", "flow_id"]).join(states, ["graph_id", "flow_id"], "left")
    of = components.select("graph_id", F.explode("finding_ids").alias("finding_id"), "level", F.array("component_id").alias("node_ids"), F.col("path_edge_ids").alias("edge_ids"), F.array("state").alias("states"))
    weak = (F.col("level") == "present") & F.array_contains("states", "checked")

    def ranked(rows: DataFrame, rank: Column | int, node_ids: Column | str = "node_ids", edge_ids: Column | str = "edge_ids", states: Column | str = "states", ids: Column = none) -> DataFrame:
        known = rows.where("graph_id IS NOT NULL AND finding_id IS NOT NULL")
        rank = F.lit(rank) if isinstance(rank, int) else rank
        return known.select(*KEY, rank.alias("rank"), F.coalesce(node_ids, none).alias("node_ids"), F.coalesce(edge_ids, none).alias("edge_ids"), F.coalesce(states, none).alias("states"), ids.alias("ids"))

    found = ranked(roots.join(_touching(edges, "contradicted_by"), ["graph_id", "node_id"]), 0)
    found = found.unionByName(ranked(links, 1, states=none, ids=F.array("hypothesis_id"))).unionByName(ranked(findings.join(supports, ["graph_id", "node_id"]), 2))
    found = found.unionByName(ranked(touched, 3, edge_ids="step_ids"))
    found = found.unionByName(ranked(of.where(F.col("level").isin(*CORROBORATING) | weak), F.when(F.col("level").isin(*CORROBORATING), 4).otherwise(5)))
    # a subject alone decides nothing, but belongs to the nodes of the flow that decides; a finding that nothing decides keeps NONE
    found = found.withColumns({"decides": F.col("rank"), "known": F.lit(False)})
    found = found.unionByName(ranked(own, 3, F.array("node_id"), none, none).withColumns({"decides": F.lit(NONE), "known": F.lit(False)}))
    every = findings.select(*KEY, F.lit(NONE).alias("rank"), none.alias("node_ids"), none.alias("edge_ids"), none.alias("states"), none.alias("ids"), F.lit(NONE).alias("decides"), F.lit(True).alias("known"))
    of_finding = Window.partitionBy(*KEY)
    found = found.unionByName(every).withColumns({"least": F.min("decides").over(of_finding), "known": F.max("known").over(of_finding)}).where("known AND rank = least")
    early = found.groupBy(*KEY).agg(F.min("rank").alias("rank"), _all("node_ids"), _all("edge_ids"), _all("ids"), F.array_distinct(F.flatten(F.collect_set("states"))).alias("states"))
    early = written(early, "decided-contexts")
    late = roots.join(early.where(F.col("rank") == NONE).select(*KEY), KEY, "left_semi").join(_touching(edges, "protected_by"), ["graph_id", "node_id"])
    late = late.groupBy(*KEY).agg(_all("node_ids"), _all("edge_ids"), F.flatten(F.collect_set("states")).alias("states"))
    guarded = early.where(F.col("rank") == NONE).select(*KEY, "ids").join(late, KEY, "left")
    guarded = guarded.select(*KEY, F.when(F.col("states").isNotNull(), NONE - 1).otherwise(NONE).alias("rank"), F.coalesce("node_ids", none).alias("node_ids"), F.coalesce("edge_ids", none).alias("edge_ids"), "ids", F.coalesce("states", none).alias("states"))
    rows = early.where(F.col("rank") < NONE).unionByName(guarded)
    status, reason = (F.element_at(F.array(*(F.lit(x[k]) for x in CONTEXTS)), F.col("rank") + 1) for k in (0, 1))
    return rows.select(*KEY, status.alias("status"), "node_ids", "edge_ids", F.col("ids").alias("hypothesis_ids"), reason.alias("reason"), worst(F.col("states")).alias("state"))


def static_hypotheses(candidates: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates (of operators/correlation) judged: hypothesis_id, status, confidence, coverage state, evidence of what supports and contradicts, summary.

    nodes and edges need evidence_ids only.
    """
    held = nodes.select("graph_id", F.col("node_id").alias("id"), "evidence_ids").unionByName(edges.select("graph_id", F.col("edge_id").alias("id"), "evidence_ids"))

    def evidence(side: str) -> DataFrame:
        ids = candidates.select("graph_id", "candidate_id", F.explode(F.array_union(f"{side}_node_ids", f"{side}_edge_ids")).alias("id"))
        return ids.join(held, ["graph_id", "id"]).groupBy("graph_id", "candidate_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidence_ids")))).alias(f"{side}_evidence_ids"))

    ends = lambda s: F.exists("coverage_refs", lambda r: r.endswith(f":{s}"))
    coverage = reduce(lambda out, s: out.when(ends(s), s), STATES[1:4], F.when(ends(STATES[0]), STATES[0]))
    coverage = coverage.when(F.exists("coverage_refs", lambda r: r.contains("coverage-unavailable")), "skipped").otherwise("checked")
    counts = candidates.withColumns({"coverage": coverage, "contradicted": (F.size("contradicting_node_ids") > 0) | (F.size("contradicting_edge_ids") > 0), "n_edges": F.size("supporting_edge_ids"), "n_nodes": F.size("supporting_node_ids"), "n_findings": F.size("finding_ids")})
    rows = hypotheses.judged(counts).join(evidence("supporting"), ["graph_id", "candidate_id"], "left").join(evidence("contradicting"), ["graph_id", "candidate_id"], "left")
    quoted = F.concat(F.lit('"'), "title", F.lit('"'))
    summary = F.when(F.col("status") == "statically_supported", F.concat(F.lit("Static graph evidence supports "), quoted, F.lit(" across "), F.col("n_edges").cast("string"), F.lit(" graph edges; runtime validation is still required.")))
    summary = summary.when(F.col("status") == "statically_contradicted", F.concat(F.lit("Observed graph controls or contradictions block static support for "), quoted, F.lit(".")))
    summary = summary.when(F.col("status") == "inconclusive", F.concat(F.lit("Static support for "), quoted, F.lit(" is inconclusive because graph coverage is "), "coverage", F.lit("; destination allowlist was not observed on the analyzed path.")))
    summary = summary.otherwise(F.concat(F.lit("Candidate graph references exist for "), quoted, F.lit(", but there is no supporting path edge strong enough for static support.")))
    none = F.array().cast(_STRINGS)
    return rows.select(
        "graph_id", fn.stable_id("hypothesis", F.col("graph_id"), F.col("candidate_id")).alias("hypothesis_id"), "candidate_id", "family", "rule_id", "title", "status", "confidence", F.col("coverage").alias("state"), summary.alias("summary"), "finding_ids", "required_validation",
        F.coalesce("supporting_evidence_ids", none).alias("supporting_evidence_ids"), F.coalesce("contradicting_evidence_ids", none).alias("contradicting_evidence_ids"),
    )


def finding_links(hypotheses_: DataFrame) -> DataFrame:
    """graph_id, finding_id, hypothesis_id: one for each finding of a hypothesis that is not contradicted."""
    return hypotheses_.where("status <> 'statically_contradicted'").select("graph_id", F.explode("finding_ids").alias("finding_id"), "hypothesis_id").distinct()


def action_links(actions: DataFrame, hypotheses_: DataFrame, contexts_: DataFrame) -> DataFrame:
    """graph_id, action_id, hypothesis_id: hypotheses that share a finding with an action, or that a finding's context names; none that is contradicted.

    Pairs may be the square of the tables: an action meets its set's list in the last stage, which takes it apart, and no pair is shuffled.
    """
    asked = _asked(actions)
    sets = _set_links(asked, hypotheses_, contexts_).groupBy("graph_id", "asked").agg(F.collect_list("hypothesis_id").alias("hypothesis_ids"))
    return asked.join(sets, ["graph_id", "asked"]).select("graph_id", "action_id", F.explode("hypothesis_ids").alias("hypothesis_id"))


def _asked(actions: DataFrame) -> DataFrame:
    """graph_id, action_id, asked: the findings of each action as one sorted set."""
    return actions.groupBy("graph_id", "action_id").agg(_all("finding_ids").alias("asked"))


def _set_links(asked: DataFrame, hypotheses_: DataFrame, contexts_: DataFrame) -> DataFrame:
    """graph_id, asked, hypothesis_id: hypotheses of each set of findings that some action has, once for all actions of that set."""
    named = contexts_.where("status = 'linked_to_hypothesis'").select(*KEY, F.explode("hypothesis_ids").alias("hypothesis_id"))
    known = hypotheses_.where("status <> 'statically_contradicted'").select("graph_id", "hypothesis_id")
    of = finding_links(hypotheses_).unionByName(named.join(known, ["graph_id", "hypothesis_id"], "left_semi").select(*KEY, "hypothesis_id"))
    sets = asked.select("graph_id", "asked").distinct()
    return sets.select("*", F.explode("asked").alias("finding_id")).join(of, KEY).select("graph_id", "asked", "hypothesis_id").distinct()


def action_groups(actions: DataFrame, hypotheses_: DataFrame, contexts_: DataFrame) -> DataFrame:
    """Groups led by an action, with its hypotheses, and by each hypothesis that belongs to no action: key, score, impact, ids, reason.

    actions are (graph_id, action_id, remediation_key, score, impact, finding_ids). Lists, of ids and as texts, are made once for a
    set of findings; actions meet them in the last join, so that no list is shuffled for each action.
    """
    asked = _asked(actions)
    links = written(_set_links(asked, hypotheses_, contexts_), "set-links")
    sets = links.groupBy("graph_id", "asked").agg(F.array_sort(F.collect_set("hypothesis_id")).alias("hypothesis_ids"))
    sets = sets.select("*", F.array_join("hypothesis_ids", "\0").alias("joined"), F.array_join("hypothesis_ids", ", ").alias("shown"))
    none = F.array().cast(_STRINGS)
    direct = actions.join(asked, ["graph_id", "action_id"], "left").join(sets, ["graph_id", "asked"], "left")
    alone = F.col("joined").isNull()
    reason = F.when(alone, F.concat(F.lit("Direct action "), "action_id", F.lit(" has no linked static hypotheses."))).otherwise(F.concat(F.lit("Direct action "), "action_id", F.lit(" includes linked static hypotheses: "), "shown", F.lit(".")))
    group_id = F.when(alone, fn.stable_id("group", F.lit("direct"), F.col("action_id"))).otherwise(fn.stable_id("group", F.lit("direct"), F.col("action_id"), F.col("joined")))
    direct = direct.select("graph_id", group_id.alias("group_id"), F.lit("direct_finding").alias("lead"), "remediation_key", F.col("score").cast("long").alias("score"), "impact", F.array("action_id").alias("action_ids"), "finding_ids", F.coalesce("hypothesis_ids", none).alias("hypothesis_ids"), reason.alias("reason"))
    rest = hypotheses_.where("status <> 'statically_contradicted'").join(links, ["graph_id", "hypothesis_id"], "left_anti")
    base = F.when(F.col("status") == "statically_supported", 80).when(F.col("status") == "candidate", 50).otherwise(30)
    text = F.concat(F.lit("Static hypothesis "), "hypothesis_id", F.lit(" has no matching direct action and should be shown as a likely attack path."))
    lone = rest.select(
        "graph_id", fn.stable_id("group", F.lit("hypothesis"), F.col("hypothesis_id")).alias("group_id"), F.lit("hypothesis").alias("lead"), F.concat(F.lit("hypothesis:"), "family").alias("remediation_key"), (base + F.floor(F.col("confidence") * 10 + 0.5)).cast("long").alias("score"),
        F.when(F.col("status") == "statically_supported", "degrades").otherwise("informational").alias("impact"), none.alias("action_ids"), F.array_sort("finding_ids").alias("finding_ids"), F.array("hypothesis_id").alias("hypothesis_ids"), text.alias("reason"),
    )
    return direct.unionByName(lone)


def hinted(hypotheses_: DataFrame, hints: DataFrame) -> DataFrame:
    """graph_id, hypothesis_id and lists of the hints (hypothesis_id or candidate_id, fixtures, notes, gaps) that name a hypothesis or its candidate."""
    by_id = hints.where("hypothesis_id IS NOT NULL")
    by_candidate = hints.where("candidate_id IS NOT NULL").drop("hypothesis_id").join(hypotheses_.select("graph_id", "candidate_id", "hypothesis_id"), ["graph_id", "candidate_id"])
    both = by_id.select("graph_id", "hypothesis_id", "hint_id", "fixtures", "notes", "gaps").unionByName(by_candidate.select("graph_id", "hypothesis_id", "hint_id", "fixtures", "notes", "gaps")).distinct()
    return both.groupBy("graph_id", "hypothesis_id").agg(_all("fixtures"), _all("notes"), _all("gaps"))


def bad_hints(hypotheses_: DataFrame, hints: DataFrame) -> DataFrame:
    """graph_id, hint_id, message of hints that name nothing, something unknown, or two things that do not belong together."""
    known = hypotheses_.select("graph_id", "hypothesis_id", F.col("candidate_id").alias("its_candidate"))
    candidates = hypotheses_.select("graph_id", "candidate_id", F.lit(True).alias("known_candidate")).distinct()
    rows = hints.join(known, ["graph_id", "hypothesis_id"], "left").join(candidates, ["graph_id", "candidate_id"], "left")
    h, c = F.col("hypothesis_id"), F.col("candidate_id")
    message = F.when(h.isNull() & c.isNull(), "names neither a hypothesis nor a candidate").when(h.isNotNull() & F.col("its_candidate").isNull(), "unknown hypothesis").when(c.isNotNull() & F.col("known_candidate").isNull(), "unknown candidate").when(h.isNotNull() & c.isNotNull() & (F.col("its_candidate") != c), "hypothesis of another candidate")
    return rows.select("graph_id", "hint_id", message.alias("message")).where("message IS NOT NULL")


def recipes(hypotheses_: DataFrame, hints: DataFrame) -> DataFrame:
    """One recipe for each hypothesis that is not contradicted: fixtures, steps, expected result, notes, materialization hints, gaps."""
    rows = hypotheses_.where("status <> 'statically_contradicted'").join(hinted(hypotheses_, hints), ["graph_id", "hypothesis_id"], "left")
    none = F.array().cast(_STRINGS)
    listed = lambda c: F.coalesce(c, none)
    fixtures = F.array_sort(F.array_union("required_validation", listed("fixtures")))
    steps = F.array(F.concat(F.lit("Prepare isolated runtime fixtures: "), F.array_join(fixtures, ", "), F.lit(".")), F.concat(F.lit("Replay the static path described by hypothesis "), "hypothesis_id", F.lit(" against a disposable environment.")), F.lit("Record whether the expected protection blocks the impact without changing production data."))
    expected = reduce(lambda out, kv: out.when(F.col("status") == kv[0], kv[1]), EXPECTED.items(), F.when(F.lit(False), ""))
    own = F.concat(F.array(F.concat(F.lit("candidate:"), "candidate_id"), F.concat(F.lit("family:"), "family"), F.concat(F.lit("rule:"), "rule_id")), F.transform("finding_ids", lambda f: F.concat(F.lit("finding:"), f)))
    gaps = F.array_sort(F.array_union(F.when(F.col("status") == "inconclusive", F.array("summary")).otherwise(none), listed("gaps")))
    return rows.select(
        "graph_id", fn.stable_id("recipe", F.col("hypothesis_id")).alias("recipe_id"), "hypothesis_id", fixtures.alias("fixtures"), steps.alias("steps"), expected.alias("expected"), F.array_union(F.array(*(F.lit(x) for x in SAFETY)), listed("notes")).alias("notes"), F.array_sort(F.array_distinct(own)).alias("materialization"), gaps.alias("gaps")
    )


def map_groups(nodes: DataFrame) -> DataFrame:
    """Nodes with the section, of seven, that shows them in their repository's map; nodes stay rows, however many a graph has."""
    section = reduce(lambda out, kv: out.when(F.col("kind").isin(*kv[1]), kv[0]), GROUPS.items(), F.when(F.lit(False), ""))
    return nodes.withColumn("section", section).where("section IS NOT NULL")


def fact_gaps(nodes: DataFrame, edges: DataFrame, flows: DataFrame, coverage: DataFrame) -> DataFrame:
    """graph_id, gap_id, source, state, label, description: incomplete coverage, nodes, edges and flows, and expected areas that nobody reported."""
    bad = F.col("state") != "checked"
    text = lambda what: F.concat(what, F.lit(" is "), "state", F.lit("."))
    of_area = coverage.where(bad).select("graph_id", F.concat(F.lit("coverage:"), "area", F.lit(":"), "producer").alias("gap_id"), F.lit("coverage").alias("source"), "state", F.col("area").alias("label"), F.coalesce("reason", text(F.concat(F.lit("Coverage for "), "area"))).alias("description"))
    expected = nodes.select("graph_id").distinct().select("graph_id", F.explode(F.array(*(F.lit(a) for a in AREAS))).alias("area"))
    missing = expected.join(coverage.select("graph_id", "area"), ["graph_id", "area"], "left_anti").select("graph_id", F.concat(F.lit("coverage:"), "area", F.lit(":missing")).alias("gap_id"), F.lit("coverage").alias("source"), F.lit("skipped").alias("state"), F.col("area").alias("label"), F.concat(F.lit("No graph coverage was recorded for "), "area", F.lit(".")).alias("description"))
    of_node = nodes.where(bad).select("graph_id", F.concat(F.lit("node:"), "node_id").alias("gap_id"), F.lit("node").alias("source"), "state", "label", text(F.concat("kind", F.lit(" coverage"))).alias("description"))
    label = nodes.select("graph_id", "node_id", "label")

    def labelled(rows: DataFrame, start: str, end: str) -> DataFrame:
        for side, column in (("start", start), ("end", end)):
            rows = rows.join(label.select("graph_id", F.col("node_id").alias(column), F.col("label").alias(side)), ["graph_id", column], "left").withColumn(side, F.coalesce(side, column))
        return rows

    of_edge = labelled(edges.where(bad), "from_id", "to_id").select("graph_id", F.concat(F.lit("edge:"), "edge_id").alias("gap_id"), F.lit("edge").alias("source"), "state", F.concat_ws(" ", "start", "kind", "end").alias("label"), text(F.concat("kind", F.lit(" relationship coverage"))).alias("description"))
    of_flow = labelled(flows.where(bad), "source_id", "sink_id").select("graph_id", F.concat(F.lit("flow:"), "flow_id").alias("gap_id"), F.lit("flow").alias("source"), "state", F.concat_ws(" -> ", "start", "end").alias("label"), text(F.lit("Flow coverage")).alias("description"))
    return of_area.unionByName(missing).unionByName(of_node).unionByName(of_edge).unionByName(of_flow)
