"""Integrity checks, returned as rows of violations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """record_id, n for each key that more than one row has."""
    return rows.groupBy(F.col(key).alias("record_id")).agg(F.count("*").alias("n")).where("n > 1")


def dangling(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """record_id, n for each reference that is not known. References are counted before they are looked up."""
    asked = rows.groupBy(F.col(key).alias("record_id")).agg(F.count("*").alias("n"))
    return asked.join(known.select(F.col(known_key).alias("record_id")), "record_id", "left_anti")


def unallowed(rules: DataFrame, rule: str) -> DataFrame:
    """rule, violation for rules (required, allowed): no kind allowed, or one required that is not allowed."""
    kind = F.when(F.size("allowed") == 0, "none_allowed").when(F.size(F.array_except("required", "allowed")) > 0, "required_not_allowed")
    return rules.select(rule, kind.alias("violation")).where("violation IS NOT NULL")


def incompatible(rows: DataFrame, base: DataFrame, key: str, *equal: str) -> DataFrame:
    """key, violation for each column that is not equal to the base's row of that key; `missing` without one."""
    right = base.select(key, F.lit(True).alias("has_base"), *(F.col(c).alias(f"base_{c}") for c in equal))
    wrong = F.array(F.when(F.col("has_base").isNull(), "missing"), *(F.when(F.col("has_base") & ~F.col(c).eqNullSafe(F.col(f"base_{c}")), c) for c in equal))
    return rows.join(right, key, "left").select(key, F.explode(F.filter(wrong, lambda x: x.isNotNull())).alias("violation"))


#: What records may say.
HYPOTHESIS_STATUSES = ("candidate", "statically_supported", "statically_contradicted", "inconclusive")
CONTEXT_STATUSES = ("standalone", "linked_to_hypothesis", "corroborated", "weakened", "contradicted")
STATES = ("checked", "partial", "degraded", "skipped", "failed")
LEVELS = ("present", "imported", "used", "reachable_from_boundary", "affected_symbol_reachable", "unknown")
LEADS = ("direct_finding", "hypothesis")
IMPACTS = ("blocks-deploy", "degrades", "informational")


def _violations(rows: DataFrame, record: str, *checks: tuple[str, Column, str]) -> DataFrame:
    """check_id, record_id, message for each check that a row fails, in one pass; a test that is null is not failed."""
    failed = F.array(*(F.when(test, F.struct(F.lit(check).alias("check_id"), F.lit(message).alias("message"))) for check, test, message in checks))
    return rows.select(F.col(record).alias("record_id"), F.explode(F.filter(failed, lambda x: x.isNotNull())).alias("x")).select("x.check_id", "record_id", "x.message")


def _unknown(rows: DataFrame, record: str, ids: Column, known: DataFrame, key: str, what: str) -> DataFrame:
    """The same for each id of a list, once, that the table of known ids of its graph lacks."""
    asked = rows.select("graph_id", F.col(record).alias("record_id"), F.explode(ids).alias(key)).distinct()
    lost = asked.join(known.select("graph_id", key).distinct(), ["graph_id", key], "left_anti")
    return lost.select(F.lit(f"unknown_{what}").alias("check_id"), "record_id", F.lit(f"references an unknown {what}").alias("message"))


def _duplicates(rows: DataFrame, record: str) -> DataFrame:
    again = rows.groupBy("graph_id", record).agg(F.count("*").alias("n")).where("n > 1")
    return again.select(F.lit("duplicate").alias("check_id"), F.col(record).alias("record_id"), F.lit("is not unique").alias("message"))


def _all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def _blank(column: str) -> Column:
    return F.trim(F.coalesce(column, F.lit(""))) == ""


def candidates(rows: DataFrame, findings: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates need texts, references, validation and support, and may name only what their graph has."""
    own = _violations(
        rows, "candidate_id", ("blank_title", _blank("title"), "has no title"), ("no_coverage", F.size("coverage_refs") == 0, "has no coverage references"), ("no_validation", F.size("required_validation") == 0, "has no required validation"),
        ("no_support", (F.size("supporting_node_ids") == 0) & (F.size("supporting_edge_ids") == 0), "has no supporting references"),
    )
    both = lambda kind: F.concat(f"supporting_{kind}_ids", f"contradicting_{kind}_ids")
    return _all(own, _duplicates(rows, "candidate_id"), _unknown(rows, "candidate_id", F.col("finding_ids"), findings, "finding_id", "finding"), _unknown(rows, "candidate_id", both("node"), nodes, "node_id", "node"), _unknown(rows, "candidate_id", both("edge"), edges, "edge_id", "edge"))


def hypotheses(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Hypotheses need texts, a known status and state, a confidence from 0 to 1, a known candidate of their own, and the evidence their status claims."""
    s = F.col("status")
    own = _violations(
        rows, "hypothesis_id", ("blank_title", _blank("title"), "has no title"), ("blank_summary", _blank("summary"), "has no summary"), ("unknown_status", ~s.isin(*HYPOTHESIS_STATUSES), "has an unknown status"), ("unknown_state", ~F.col("state").isin(*STATES), "has an unknown coverage state"),
        ("confidence", ~F.col("confidence").between(0, 1), "has a confidence out of range"), ("unsupported", (s == "statically_supported") & (F.size("supporting_evidence_ids") == 0), "is supported without supporting evidence"),
        ("uncontradicted", (s == "statically_contradicted") & (F.size("contradicting_evidence_ids") == 0), "is contradicted without contradicting evidence"),
    )
    return _all(own, _duplicates(rows, "hypothesis_id"), _unknown(rows, "hypothesis_id", F.array("candidate_id"), known, "candidate_id", "candidate"))


def contexts(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """Contexts need a known status, one for each finding, and exactly the ids that their status allows."""
    s, bare, named = F.col("status"), (F.size("node_ids") == 0) & (F.size("edge_ids") == 0), F.size("hypothesis_ids") > 0
    graph = s.isin("corroborated", "weakened", "contradicted")
    own = _violations(
        rows, "finding_id", ("unknown_status", ~s.isin(*CONTEXT_STATUSES), "has an unknown status"), ("unknown_state", ~F.col("state").isin(*STATES), "has an unknown coverage state"), ("blank_reason", _blank("reason"), "has no reason"),
        ("standalone_context", (s == "standalone") & (~bare | named), "is standalone but has context"), ("unlinked", (s == "linked_to_hypothesis") & ~named, "is linked without hypotheses"),
        ("stray_hypotheses", graph & named, "has hypotheses that its status does not allow"), ("no_context", graph & bare, "has no context that its status needs"),
    )
    lost = findings.select("graph_id", "finding_id").distinct().join(rows.select("graph_id", "finding_id"), ["graph_id", "finding_id"], "left_anti")
    missing = lost.select(F.lit("missing").alias("check_id"), F.col("finding_id").alias("record_id"), F.lit("has no context").alias("message"))
    return _all(own, _duplicates(rows, "finding_id"), _unknown(rows, "finding_id", F.array("finding_id"), findings, "finding_id", "finding"), missing)


def components(rows: DataFrame) -> DataFrame:
    """Components need a known level and state, and a path where their level speaks of one."""
    own = _violations(
        rows, "component_id", ("unknown_level", ~F.col("level").isin(*LEVELS), "has an unknown level"), ("unknown_state", ~F.col("state").isin(*STATES), "has an unknown coverage state"),
        ("no_path", ~F.col("level").isin("present", "unknown") & (F.size("path_edge_ids") == 0), "has no path that its level needs"),
    )
    return _all(own, _duplicates(rows, "component_id"))


def recipes(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Recipes need one known hypothesis each, and lists that are not empty."""
    own = _violations(
        rows, "hypothesis_id", ("no_fixtures", F.size("fixtures") == 0, "has no fixtures"), ("no_steps", F.size("steps") == 0, "has no steps"), ("no_expectation", _blank("expected"), "has no expected result"),
        ("no_notes", F.size("notes") == 0, "has no safety notes"), ("no_materialization", F.size("materialization") == 0, "has no materialization hints"),
    )
    return _all(own, _duplicates(rows, "hypothesis_id"), _unknown(rows, "hypothesis_id", F.array("hypothesis_id"), known, "hypothesis_id", "hypothesis"))


def groups(rows: DataFrame, actions: DataFrame) -> DataFrame:
    """Groups need a known lead and impact, a key, a score, and the ids that their lead implies."""
    lead = F.col("lead")
    own = _violations(
        rows, "group_id", ("unknown_lead", ~lead.isin(*LEADS), "has an unknown lead"), ("unknown_impact", ~F.col("impact").isin(*IMPACTS), "has an unknown impact"), ("blank_key", _blank("remediation_key"), "has no remediation key"), ("score", F.col("score") < 0, "has a negative score"),
        ("no_action", (lead == "direct_finding") & (F.size("action_ids") == 0), "is led by a finding without an action"), ("stray_action", (lead == "hypothesis") & (F.size("action_ids") > 0), "is led by a hypothesis but has actions"),
        ("no_hypothesis", (lead == "hypothesis") & (F.size("hypothesis_ids") == 0), "is led by a hypothesis without one"),
    )
    return _all(own, _duplicates(rows, "group_id"), _unknown(rows, "group_id", F.col("action_ids"), actions, "action_id", "action"))


def missing_evidence(rows: DataFrame, record: str, evidence: DataFrame) -> DataFrame:
    """Evidence ids of records that no evidence has."""
    asked = rows.select(F.col(record).alias("record_id"), F.explode("evidence_ids").alias("evidence_id"))
    lost = asked.join(evidence.select("evidence_id").distinct(), "evidence_id", "left_anti")
    return lost.select(F.lit("missing_evidence").alias("check_id"), "record_id", F.concat(F.lit("references missing evidence "), "evidence_id").alias("message"))


#: Kinds of nodes and edges, and areas of coverage.
NODE_KINDS = ("Boundary", "CodeEntity", "Source", "Sink", "Control", "Flow", "Component", "Finding", "Secret", "BuildStep", "InfraResource", "ExternalService", "DataStore", "Resource")
EDGE_KINDS = ("contains", "imports", "calls", "registers", "receives", "flows_to", "uses", "reads", "writes", "protected_by", "exposes", "depends_on", "located_in", "affects", "supported_by", "contradicted_by")
COVERAGE_AREAS = ("entities", "boundaries", "call_graph", "data_flow", "dependency_usage", "ci_iac", "content_assets", "smart_contracts", "language_support")


def broken_flows(flows: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, flow_id, check_id, place of flows (source_id, sink_id, edge_ids) whose edges do not lead from source to sink.

    The first fault of a flow counts: dangling (no such edge), not_connected (it does not start where the one
    before ends, or at the source), wrong_end (place: behind the last edge). An empty path is no fault.
    Of edges that share an id in a graph the first by its ends is taken; flows that repeat a row are told once.
    """
    ends = edges.groupBy("graph_id", "edge_id").agg(F.min(F.struct("from_id", "to_id")).alias("ends"))
    steps = flows.select("graph_id", "flow_id", "source_id", "sink_id", F.posexplode("edge_ids").alias("place", "edge_id")).distinct().join(ends, ["graph_id", "edge_id"], "left")
    rows = steps.groupBy("graph_id", "flow_id", "source_id", "sink_id").agg(F.array_sort(F.collect_list(F.struct("place", "edge_id", "ends"))).alias("steps"))
    step = F.col("steps")
    before = lambda i: F.when(i == 0, F.col("source_id")).otherwise(F.get(step, i - 1)["ends"]["to_id"])
    faults = F.transform("steps", lambda x, i: F.when(x["ends"].isNull(), F.struct(F.lit("dangling").alias("check_id"), x["place"].alias("place"))).when(~x["ends"]["from_id"].eqNullSafe(before(i)), F.struct(F.lit("not_connected").alias("check_id"), x["place"].alias("place"))))
    last = F.try_element_at("steps", F.lit(-1))
    end = F.when(~last["ends"]["to_id"].eqNullSafe(F.col("sink_id")), F.struct(F.lit("wrong_end").alias("check_id"), (last["place"] + 1).alias("place")))
    first = F.coalesce(F.get(F.array_compact(faults), F.lit(0)), end)
    return rows.select("graph_id", "flow_id", first.alias("x")).where("x IS NOT NULL").select("graph_id", "flow_id", "x.check_id", "x.place").distinct()


def graph_records(nodes: DataFrame, edges: DataFrame, flows: DataFrame, coverage: DataFrame, files: DataFrame, evidence: DataFrame) -> DataFrame:
    """check_id, record_id, message for values outside of their lists and ranges, dangling ends, evidence and paths.

    nodes: node_id, kind, stable_key, producer, confidence, state, path, line, end_line, evidence_ids; edges the
    same without a place, with from_id and to_id; flows: source_id, sink_id, control_ids, confidence, state,
    evidence_ids; coverage: area, producer, state, covered, total; files (graph_id, path) and evidence
    (graph_id, evidence_id) are those of the snapshot. All have graph_id.
    """
    sure = lambda c: ("confidence", ~F.coalesce(F.col(c).between(0, 1) & ~F.isnan(c), F.lit(False)), "confidence is not between 0 and 1")
    listed = lambda c, values, what: (f"unknown_{what}", ~F.coalesce(F.col(c).isin(*values), F.lit(False)), f"{what} is invalid")
    shared = (("blank_key", _blank("stable_key"), "stable key is empty"), ("blank_producer", _blank("producer"), "producer is empty"), sure("confidence"), listed("state", STATES, "state"))
    path = F.col("path")
    unsafe = path.isNotNull() & (path.rlike(r"^$|^/|\\|\x00") | F.exists(F.split(path, "/"), lambda p: p.isin("", ".", "..")))
    of_nodes = _violations(nodes, "node_id", listed("kind", NODE_KINDS, "kind"), *shared, ("unsafe_path", unsafe, "path is unsafe"), ("line", F.col("line") < 1, "line is not positive"), ("line_range", F.col("end_line") < F.col("line"), "ends before it starts"))
    of_edges = _violations(edges, "edge_id", listed("kind", EDGE_KINDS, "kind"), *shared)
    of_flows = _violations(flows, "flow_id", sure("confidence"), listed("state", STATES, "state"))
    area = coverage.withColumn("record", F.concat_ws(":", "area", "producer"))
    of_areas = _violations(area, "record", listed("area", COVERAGE_AREAS, "area"), listed("state", STATES, "state"), ("blank_producer", _blank("producer"), "producer is empty"), ("negative", (F.col("covered") < 0) | (F.col("total") < 0), "a count is negative"), ("excess", F.col("covered") > F.col("total"), "covers more than there is"))
    outside = nodes.where(path.isNotNull() & ~unsafe).select("graph_id", "node_id", "path").join(files.select("graph_id", "path").distinct(), ["graph_id", "path"], "left_anti")
    outside = outside.select(F.lit("outside").alias("check_id"), F.col("node_id").alias("record_id"), F.lit("points outside the snapshot").alias("message"))
    held = [_unknown(rows, key, F.col("evidence_ids"), evidence, "evidence_id", "evidence") for rows, key in ((nodes, "node_id"), (edges, "edge_id"), (flows, "flow_id"))]
    ends = [_unknown(edges, "edge_id", F.array("from_id", "to_id"), nodes, "node_id", "node"), _unknown(flows, "flow_id", F.concat(F.array("source_id", "sink_id"), "control_ids"), nodes, "node_id", "node")]
    again = [_duplicates(rows, key) for rows, key in ((nodes, "node_id"), (nodes, "stable_key"), (edges, "edge_id"), (edges, "stable_key"), (flows, "flow_id"), (area, "record"))]
    return _all(of_nodes, of_edges, of_flows, of_areas, outside, *held, *ends, *again)


def rules(rows: DataFrame) -> DataFrame:
    """check_id, record_id, message for rules (rule_id, family, title, source_kinds, target_kinds, allowed, required, max_length, validation, source_other, target_other).

    source_other and target_other say whether a selector constrains something besides kinds; a null list of kinds constrains none.
    """
    empty = lambda c: F.coalesce(F.size(c) <= 0, F.lit(True)) | F.coalesce(F.exists(c, lambda x: F.coalesce(F.trim(x) == "", F.lit(True))), F.lit(False))
    side = lambda s: (f"{s}_selector", F.when(F.col(f"{s}_kinds").isNull(), ~F.coalesce(F.col(f"{s}_other"), F.lit(False))).otherwise(empty(f"{s}_kinds")), f"{s} selector constrains nothing or is empty")
    return _violations(
        rows, "rule_id", *((f"blank_{c}", _blank(c), f"{c} is empty") for c in ("rule_id", "family", "title")), side("source"), side("target"), ("no_edges", empty("allowed"), "allows no edge"), ("no_validation", empty("validation"), "needs no validation"),
        ("length", ~F.coalesce(F.col("max_length") > 0, F.lit(False)), "path length is not positive"), ("required", F.size(F.array_except(F.coalesce("required", F.array().cast("array<string>")), F.coalesce("allowed", F.array().cast("array<string>")))) > 0, "requires an edge that it does not allow"),
    )
