"""Rules over property graphs: bounded path search, candidates, their findings, contradictions, titles and reasons.

All rules and all graphs are searched together, one level of edges at a time; each level is written, so that
lineage stays short and a lost executor costs a level.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagelake.functions import findings as fn
from triagelake.sources.shared import written

#: Edges that contradict a path; families that need a linked finding; edges of a path at most.
CONTRADICTIONS = ("protected_by", "contradicted_by")
NEED_FINDINGS = ("sast_reachable_path", "dependency_usage_path", "ci_supply_chain_path", "secret_impact_chain")
MAX_LENGTH = 6
_FLOW = ("receives", "registers", "calls", "flows_to")


@dataclasses.dataclass(frozen=True)
class Rule:
    rule_id: str
    family: str
    title: str
    source_kinds: tuple[str, ...]
    target_kinds: tuple[str, ...]
    allowed: tuple[str, ...]
    validation: tuple[str, ...]
    coverage: tuple[str, ...]
    required: tuple[str, ...] = ()
    source_equals: tuple[tuple[str, str], ...] = ()
    target_equals: tuple[tuple[str, str], ...] = ()
    target_not_equals: tuple[tuple[str, str], ...] = ()
    max_length: int = MAX_LENGTH


#: The standard rules, one for each family.
RULES = (
    Rule("stage2.external-input-dangerous-operation", "external_input_to_dangerous_operation", "External input reaches a dangerous operation", ("Boundary", "Source"), ("Sink",), _FLOW, ("boundary_input_fixture", "dangerous_operation_repro"), ("stage2:boundaries", "stage2:call_graph", "stage2:data_flow"), target_not_equals=(("sinkType", "outbound_http"),)),
    Rule("stage2.sast-reachable-path", "sast_reachable_path", "Quick SAST finding is reachable from an analyzed boundary", ("Boundary", "Source"), ("CodeEntity",), _FLOW, ("sast_reachability_review",), ("stage2:boundaries", "stage2:call_graph"), required=("calls",)),
    Rule("stage2.dependency-usage-path", "dependency_usage_path", "Vulnerable component is imported, used, or reachable in the dependency graph", ("Boundary", "Source", "CodeEntity"), ("Component",), ("receives", "registers", "calls", "imports", "uses", "depends_on"), ("dependency_usage_review",), ("stage2:dependency_usage", "stage2:call_graph")),
    Rule("stage2.ci-supply-chain-path", "ci_supply_chain_path", "Build workflow can reach a mutable or privileged build resource", ("BuildStep",), ("Resource",), ("contains", "depends_on", "uses", "writes"), ("ci_supply_chain_review",), ("stage2:ci_iac",)),
    Rule("stage2.secret-impact-chain", "secret_impact_chain", "Secret context reaches a privileged integration or exposed resource", ("Secret",), ("ExternalService", "InfraResource", "BuildStep"), ("reads", "uses", "depends_on", "flows_to", "writes", "exposes"), ("secret_rotation_review", "integration_scope_review"), ("stage2:secret_impact", "stage2:ci_iac")),
    Rule("stage2.content-resource-exposure-path", "content_resource_exposure_path", "Hidden content/resource exposure path: static content exposes hidden or private resources", ("Resource",), ("Sink",), ("exposes",), ("content_route_review", "asset_exposure_review"), ("stage2:content_assets",), source_equals=(("resourceType", "content_resource"),), target_equals=(("sinkType", "hidden_content_exposure"),), max_length=1),
    Rule("stage2.smart-contract-risk-path", "smart_contract_risk_path", "Smart contract risk path: contract sends value before updating state", ("Resource",), ("Sink",), ("flows_to",), ("smart_contract_reentrancy_review", "contract_unit_or_fork_test"), ("stage2:smart_contracts",), source_equals=(("resourceType", "smart_contract"),), target_equals=(("sinkType", "smart_contract_reentrancy"),), max_length=1),
)
#: Titles of dangerous operations by the type of their sink.
TITLES = {
    "sql_execution": "SQL injection path: external input reaches SQL execution", "no_sql_execution": "NoSQL injection path: external input reaches NoSQL query execution", "xml_processing": "XXE path: external input reaches XML processing", "deserialization": "Insecure deserialization path: external input reaches deserialization",
    "file_system": "Path traversal or file access path: external input reaches filesystem access", "log_disclosure": "Log disclosure path: external input reaches exposed server log access", "file_upload_validation": "File upload validation path: external input reaches upload validation logic", "redirect": "Open redirect path: external input reaches a redirect",
    "template_render": "Server-side template injection path: external input reaches template rendering", "code_execution": "Code execution path: external input reaches command or code execution", "hidden_content_exposure": "Hidden content/resource exposure path: external input reaches hidden content", "server_side_request": "Server-side request forgery path: external input reaches a server-side HTTP client",
    "outbound_http": "Outbound request path: external input reaches an HTTP client", "cross_site_scripting": "Cross-site scripting path: external input reaches HTML or script output", "crypto_weakness": "Cryptographic weakness path: external input reaches cryptographic or encoding logic", "jwt_token_trust": "JWT token trust path: external input reaches JWT signing or parsing logic",
    "password_reset_trust": "Password reset path: request-controlled recovery data reaches password reset flow", "authentication_bypass": "Authentication bypass path: request-controlled verification data reaches account verification logic",
    "access_control": "Access control path: request-controlled resource id reaches owned data access", "csrf_state_change": "CSRF path: state-changing request reaches mutable server-side state without a strong CSRF control",
}
IDOR_TITLE = "IDOR path: request-controlled resource id reaches object access"
OPEN_DATA_TITLE = "Access control path: public route reaches SQL-backed data access without observed authorization"
SAFE, OPEN_DATA = "(?:^|-)(?:fix|fixed|safe|secure)(?:$|-)", "access-control|missing-function-ac|missingac"


def selected(node: DataFrame, kinds: tuple[str, ...] = (), stable_keys: tuple[str, ...] = (), equals: tuple[tuple[str, str], ...] = (), not_equals: tuple[tuple[str, str], ...] = ()) -> Column:
    """Whether a node fits a selector; a missing property fails an equality and passes an inequality."""
    out = F.lit(True)
    if kinds:
        out = out & F.col("kind").isin(*kinds)
    if stable_keys:
        out = out & F.col("stable_key").isin(*stable_keys)
    for key, value in equals:
        out = out & F.col("properties")[key].eqNullSafe(F.lit(value))
    for key, value in not_equals:
        out = out & ~F.col("properties")[key].eqNullSafe(F.lit(value))
    return out


def _ends(nodes: DataFrame, rules: tuple[Rule, ...], side: str) -> DataFrame:
    """rule_id, graph_id, node_id of the nodes that a rule starts or ends at."""
    fits = lambda r: selected(nodes, r.source_kinds, (), r.source_equals) if side == "source" else selected(nodes, r.target_kinds, (), r.target_equals, r.target_not_equals)
    named = F.filter(F.array(*(F.when(fits(r), F.lit(r.rule_id)) for r in rules)), lambda x: x.isNotNull())
    return nodes.select("graph_id", "node_id", F.explode(named).alias("rule_id"))


def _leading(steps: DataFrame, targets: DataFrame, rounds: int) -> DataFrame:
    """steps that lead to a target of their rule, with after: the fewest edges from a step's end to one (0: it ends there).

    Found by sets of nodes, backwards from the targets, so each node of a rule is visited once.
    """
    front = seen = written(targets.distinct().withColumn("after", F.lit(0)), "leading")
    back = steps.select("rule_id", "graph_id", F.col("from_id").alias("before"), F.col("to_id").alias("node_id")).distinct()
    for n in range(1, rounds):
        step = front.join(back, ["rule_id", "graph_id", "node_id"]).select("rule_id", "graph_id", F.col("before").alias("node_id")).distinct()
        front = written(step.join(seen.select("rule_id", "graph_id", "node_id"), ["rule_id", "graph_id", "node_id"], "left_anti").withColumn("after", F.lit(n)), "leading")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return steps.join(seen.withColumnRenamed("node_id", "to_id"), ["rule_id", "graph_id", "to_id"])


def paths(nodes: DataFrame, edges: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """rule_id, graph_id, start_id, end_id, edge_ids, node_ids: every simple path of a rule, also on through its targets.

    A path grows only along edges from whose end a target is still near enough, so fronts that lead nowhere
    end at once and no path is lost.
    """
    allowed = F.filter(F.array(*(F.when(F.col("kind").isin(*r.allowed), F.lit(r.rule_id)) for r in rules)), lambda x: x.isNotNull())
    lengths = {r.rule_id: r.max_length for r in rules}
    most = max(lengths.values())
    targets = _ends(nodes, rules, "target").select("rule_id", "graph_id", "node_id")
    steps = written(edges.select("graph_id", "edge_id", "kind", "from_id", "to_id", F.explode(allowed).alias("rule_id")), "rule-edges")
    steps = written(_leading(steps, targets, most), "leading-edges")
    limit = F.coalesce(*(F.when(F.col("rule_id") == r, n) for r, n in lengths.items()))
    first = _ends(nodes, rules, "source")
    front = first.select("rule_id", "graph_id", F.col("node_id").alias("start_id"), F.col("node_id").alias("end_id"), F.array().cast("array<string>").alias("edge_ids"), F.array("node_id").alias("node_ids"), F.array().cast("array<string>").alias("kinds"))
    required = {r.rule_id: r.required for r in rules if r.required}
    found = []
    for depth in range(1, most + 1):
        ahead = front.join(steps.where(F.col("after") <= limit - depth).withColumnRenamed("from_id", "end_id"), ["rule_id", "graph_id", "end_id"])
        ahead = ahead.where(~F.array_contains("node_ids", F.col("to_id")))
        front = written(ahead.select("rule_id", "graph_id", "start_id", F.col("to_id").alias("end_id"), F.array_append("edge_ids", F.col("edge_id")).alias("edge_ids"), F.array_append("node_ids", F.col("to_id")).alias("node_ids"), F.array_append("kinds", F.col("kind")).alias("kinds"), (F.col("after") == 0).alias("hit")), "paths")
        if front.isEmpty():
            break
        hit = front.where("hit")
        for rule_id, kinds in required.items():
            hit = hit.where((F.col("rule_id") != rule_id) | (F.size(F.array_except(F.array(*(F.lit(k) for k in kinds)), "kinds")) == 0))
        found.append(hit.drop("hit"))
        front = front.drop("hit")
    out = found[0] if found else front.drop("hit")
    for more in found[1:]:
        out = out.unionByName(more)
    return out.drop("kinds")


def linked_findings(found: DataFrame, contexts: DataFrame) -> DataFrame:
    """graph_id, candidate_id, finding_ids: findings whose context (graph_id, finding_id, status, node_ids, edge_ids) shares a node or an edge with a candidate's path."""
    known = contexts.where("status <> 'standalone'")
    ours = found.select("graph_id", "candidate_id", F.explode(F.array_union("supporting_node_ids", "supporting_edge_ids")).alias("id"))
    theirs = known.select("graph_id", "finding_id", F.explode(F.array_union("node_ids", "edge_ids")).alias("id"))
    return ours.join(theirs, ["graph_id", "id"]).groupBy("graph_id", "candidate_id").agg(F.array_sort(F.collect_set("finding_id")).alias("finding_ids"))


def contradictions(found: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, candidate_id, contradicting_node_ids, contradicting_edge_ids: protecting or contradicting edges that touch a supporting node."""
    against = edges.where(F.col("kind").isin(*CONTRADICTIONS)).select("graph_id", "edge_id", F.array("from_id", "to_id").alias("ends"))
    touching = against.select("*", F.explode("ends").alias("node_id"))
    ours = found.select("graph_id", "candidate_id", F.explode("supporting_node_ids").alias("node_id"))
    return ours.join(touching, ["graph_id", "node_id"]).groupBy("graph_id", "candidate_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ends")))).alias("contradicting_node_ids"), F.array_sort(F.collect_set("edge_id")).alias("contradicting_edge_ids"))


def place(path: Column, line: Column) -> Column:
    """`path:line`; null without either."""
    return F.concat(path, F.lit(":"), line.cast("string"))


def plain_label(node: dict[str, Column]) -> Column:
    """A node's label for a reason: compacted if it is content, replaced by its place if it is verbose code."""
    spaced = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    label, at, text = node["label"], place(node["path"], node["line"]), spaced(node["label"])
    with_place = lambda x: F.when(at.isNull(), x).otherwise(F.concat(x, F.lit(" ("), at, F.lit(")")))
    subject = spaced(F.coalesce(*(node["properties"][k] for k in ("route", "assetPath", "matcher", "clue")), label))
    content = with_place(F.when(F.length(subject) > 120, F.concat(F.rtrim(F.substring(subject, 1, 117)), F.lit("..."))).otherwise(subject))
    verbose = label.contains("\n") | (F.length(text) > 80) | text.rlike(r"^(async )?function |^app\.use\(|=>")
    code = F.coalesce(at, F.substring(text, 1, 80))
    return F.when(node["properties"]["resourceType"].eqNullSafe(F.lit("content_resource")), content).when(verbose, code).when(at.isNotNull() & text.contains(at), text).otherwise(with_place(text))


def semantic_key(node: dict[str, Column]) -> Column:
    """What makes two ends of paths the same for a reader: kind and place, a sink's type, an entry's place alone."""
    at, p, kind = place(node["path"], node["line"]), node["properties"], node["kind"]
    entry = at.isNotNull() & kind.isin("Boundary", "Source")
    described = F.when(kind == "Boundary", p["routeOrName"]).when(kind == "Sink", p["sinkType"]).when(kind == "Component", p["packageName"]).when(kind == "Resource", p["resourceType"]).when(kind == "ExternalService", p["serviceType"]).when(at.isNull(), p["fullName"])
    return F.when(entry, F.concat(F.lit("Entry::"), at)).when(at.isNotNull(), F.concat_ws(":", kind, F.coalesce(described, F.lit("")), at)).otherwise(F.concat_ws(":", kind, F.coalesce(described, node["stable_key"])))


def _rules_frame(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    rows = [(r.rule_id, r.family, r.title, sorted(r.validation), sorted(r.coverage)) for r in rules]
    return F.broadcast(spark.createDataFrame(rows, "rule_id string, family string, rule_title string, required_validation array<string>, rule_coverage array<string>"))


def candidates(nodes: DataFrame, edges: DataFrame, contexts: DataFrame, coverage: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One candidate for each path of a rule: ids, title, reason, supporting and contradicting ids, findings, coverage references.

    coverage is (graph_id, area, state). path_ord, a struct, orders a rule's candidates of a graph as the search finds them.
    """
    found = paths(nodes, edges, rules).join(_rules_frame(nodes.sparkSession, rules), "rule_id")
    sorted_edges = F.array_sort(F.array_distinct("edge_ids"))
    found = found.withColumns({"supporting_node_ids": F.array_sort(F.array_distinct("node_ids")), "supporting_edge_ids": sorted_edges, "candidate_id": fn.stable_id("candidate", F.col("graph_id"), F.col("rule_id"), F.col("start_id"), F.col("end_id"), F.array_join(sorted_edges, "\0"))})
    found = written(found, "found-paths")
    shown = nodes.select("graph_id", "node_id", F.struct("kind", "stable_key", "label", "path", "line", "symbol", "properties").alias("node"))
    start, end = (shown.select("graph_id", F.col("node_id").alias(f"{s}_id"), F.col("node").alias(s)) for s in ("start", "end"))
    rows = found.join(start, ["graph_id", "start_id"]).join(end, ["graph_id", "end_id"])
    entries = nodes.where(F.col("kind").isin("Boundary", "Source")).select("graph_id", "node_id", F.array(F.col("label"), F.col("path"), F.col("symbol"), *(F.col("properties")[k] for k in ("routeOrName", "fullName", "callName"))).alias("said"))
    said = found.select("graph_id", "candidate_id", F.explode("node_ids").alias("node_id")).join(entries, ["graph_id", "node_id"]).select("graph_id", "candidate_id", F.explode("said").alias("said"))
    normal = F.regexp_replace(F.lower("said"), "[^a-z0-9]+", "-")
    open_data = said.where("said IS NOT NULL").groupBy("graph_id", "candidate_id").agg((F.max(normal.rlike(OPEN_DATA)) & ~F.max(normal.rlike(SAFE))).alias("open_data"))
    refs = coverage.groupBy("graph_id").agg(F.collect_set(F.concat("area", F.lit(":"), "state")).alias("refs"))
    rows = rows.join(open_data, ["graph_id", "candidate_id"], "left").join(linked_findings(found, contexts), ["graph_id", "candidate_id"], "left").join(contradictions(found, edges), ["graph_id", "candidate_id"], "left").join(refs, ["graph_id"], "left")
    ends = lambda s: {k: F.col(f"{s}.{k}") for k in ("kind", "stable_key", "label", "path", "line", "symbol", "properties")}
    none = F.array().cast("array<string>")
    title = title_of(F.col("family"), F.col("rule_title"), ends("end"), F.coalesce("open_data", F.lit(False)))
    reason = F.concat(title, F.lit(": "), plain_label(ends("start")), F.lit(" reaches "), plain_label(ends("end")), F.lit(" across "), F.size("edge_ids").cast("string"), F.lit(" graph edges"))
    order = F.struct("start_id", "end_id", F.array_join("edge_ids", "\0").alias("edges"))
    return rows.select(
        "graph_id", "candidate_id", "rule_id", "family", title.alias("title"), "start_id", "end_id", F.coalesce("finding_ids", none).alias("finding_ids"), "supporting_node_ids", "supporting_edge_ids", F.coalesce("contradicting_node_ids", none).alias("contradicting_node_ids"),
        F.coalesce("contradicting_edge_ids", none).alias("contradicting_edge_ids"), F.array_sort(F.array_union("rule_coverage", F.coalesce("refs", F.array(F.lit("graph:coverage-unavailable"))))).alias("coverage_refs"), "required_validation", reason.alias("reason"),
        semantic_key(ends("start")).alias("start_key"), semantic_key(ends("end")).alias("end_key"), order.alias("path_ord"),
    )


def title_of(family: Column, title: Column, end: dict[str, Column], open_data: Column) -> Column:
    """The title of a candidate: of dangerous operations by the sink's type, others by their rule."""
    sink = end["properties"]["sinkType"]
    out = F.when((sink == "sql_execution") & open_data, OPEN_DATA_TITLE).when((sink == "access_control") & F.lower(end["label"]).contains("idor"), IDOR_TITLE)
    for kind, text in TITLES.items():
        out = out.when(sink == kind, text)
    special = (family == "external_input_to_dangerous_operation") & (end["kind"] == "Sink")
    return F.when(special, F.coalesce(out, title)).otherwise(title)


def merged(found: DataFrame) -> DataFrame:
    """Candidates that read the same, as one: the first's own values, and all ids, references and validations."""
    lists = ("finding_ids", "supporting_node_ids", "supporting_edge_ids", "contradicting_node_ids", "contradicting_edge_ids", "coverage_refs", "required_validation")
    scalars = ("candidate_id", "start_id", "end_id", "reason", "path_ord")
    together = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in lists]
    out = found.groupBy("graph_id", "rule_id", "family", "title", "start_key", "end_key").agg(F.min_by(F.struct(*scalars), "path_ord").alias("first"), F.count("*").alias("n_paths"), *together)
    return out.select("graph_id", "rule_id", "family", "title", "start_key", "end_key", "n_paths", *lists, *(F.col(f"first.{c}").alias(c) for c in scalars))


def with_context(found: DataFrame) -> DataFrame:
    """Candidates of families that need a linked finding only with one. Contexts that could not be made link none: who made them says so."""
    return found.where(~F.col("family").isin(*NEED_FINDINGS) | (F.size("finding_ids") > 0))


def limited(found: DataFrame, most: int) -> DataFrame:
    """The first candidates of each rule and graph, of those that with_context leaves."""
    nth = F.row_number().over(Window.partitionBy("graph_id", "rule_id").orderBy("path_ord"))
    return with_context(found).withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def flows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, flow_id, source_id, sink_id, edge_ids: simple paths from sources that stop at their first sink."""
    sinks = nodes.where("kind = 'Sink'").select("graph_id", F.col("node_id").alias("sink_id"))
    sinks = written(sinks, "flow-sinks")
    steps = written(edges.where(F.col("kind").isin(*_FLOW)).select("graph_id", "edge_id", "from_id", "to_id"), "flow-edges")
    front = nodes.where("kind = 'Source'").select("graph_id", F.col("node_id").alias("source_id"), F.col("node_id").alias("end_id"), F.array().cast("array<string>").alias("edge_ids"), F.array("node_id").alias("node_ids"))
    found = []
    for _ in range(MAX_LENGTH):
        ahead = front.join(steps, [front["graph_id"] == steps["graph_id"], front["end_id"] == steps["from_id"]]).where(~F.array_contains("node_ids", F.col("to_id")))
        ahead = ahead.select(front["graph_id"], "source_id", F.col("to_id").alias("end_id"), F.array_append("edge_ids", F.col("edge_id")).alias("edge_ids"), F.array_append("node_ids", F.col("to_id")).alias("node_ids"))
        ahead = written(ahead.join(sinks, [ahead["graph_id"] == sinks["graph_id"], ahead["end_id"] == sinks["sink_id"]], "left").select(ahead["graph_id"], "source_id", "end_id", "edge_ids", "node_ids", F.col("sink_id").isNotNull().alias("hit")), "flow-paths")
        found.append(ahead.where("hit"))
        front = ahead.where("NOT hit").drop("hit")
        if front.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    stable = F.concat(F.lit("flow:"), "source_id", F.lit(":"), "end_id", F.lit(":"), F.array_join("edge_ids", ">"))
    return out.select("graph_id", fn.stable_id("flow", F.col("graph_id"), stable).alias("flow_id"), "source_id", F.col("end_id").alias("sink_id"), "edge_ids", "node_ids")


def flow_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, n: how many flows a graph has, for graphs that have some.

    Paths are listed without their last edge. Edges from there into sinks are counted for each node: no path
    has met a sink before, so each of these edges ends one flow.
    """
    sinks = nodes.where("kind = 'Sink'").select("graph_id", F.col("node_id").alias("to_id"), F.lit(True).alias("is_sink")).distinct()
    steps = written(edges.where(F.col("kind").isin(*_FLOW)).select("graph_id", "from_id", "to_id").join(sinks, ["graph_id", "to_id"], "left"), "flow-edges")
    into = written(steps.where("is_sink").groupBy("graph_id", F.col("from_id").alias("end_id")).agg(F.count("*").alias("n")), "flow-ends")
    steps = steps.where("is_sink IS NULL").select("graph_id", F.col("from_id").alias("end_id"), "to_id")
    front = nodes.where("kind = 'Source'").select("graph_id", F.col("node_id").alias("end_id"), F.array("node_id").alias("node_ids"))
    found = []
    for length in range(1, MAX_LENGTH + 1):
        found.append(front.join(into, ["graph_id", "end_id"]).groupBy("graph_id").agg(F.sum("n").alias("n")))
        if length == MAX_LENGTH or front.isEmpty():
            break
        ahead = front.join(steps, ["graph_id", "end_id"]).where(~F.array_contains("node_ids", F.col("to_id")))
        front = written(ahead.select("graph_id", F.col("to_id").alias("end_id"), F.array_append("node_ids", F.col("to_id")).alias("node_ids")), "flow-fronts")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("graph_id").agg(F.sum("n").alias("n"))


def reached(nodes: DataFrame, edges: DataFrame, most: int = 12) -> DataFrame:
    """graph_id, node_id, edge_ids: the shortest path to each node from any source or boundary, the least by (start, edge ids) of equal ones.

    A start has an empty path. One search serves all nodes.
    """
    steps = written(edges.select("graph_id", "edge_id", "from_id", "to_id"), "reach-edges")
    start = nodes.where(F.col("kind").isin("Source", "Boundary")).select("graph_id", "node_id", F.col("node_id").alias("start_id"), F.array().cast("array<string>").alias("edge_ids"))
    seen = front = written(start, "reached")
    for _ in range(most):
        ahead = front.join(steps, [front["graph_id"] == steps["graph_id"], front["node_id"] == steps["from_id"]]).select(front["graph_id"], F.col("to_id").alias("node_id"), "start_id", F.array_append("edge_ids", F.col("edge_id")).alias("edge_ids"))
        best = ahead.groupBy("graph_id", "node_id").agg(F.min(F.struct("start_id", "edge_ids")).alias("best")).select("graph_id", "node_id", "best.start_id", "best.edge_ids")
        front = written(best.join(seen.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_anti"), "reached")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen
