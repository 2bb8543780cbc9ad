"""Detail records of hypotheses with their catalog texts, and checks of what comes back for a batch of them.

Hypotheses are those of operators/assessment.static_hypotheses, candidates those of operators/correlation, both
with one row for each; findings are (graph_id, finding_id, evidence_ids), evidence (graph_id, evidence_id, tool,
path, line, end_line, snippet), recipes those of operators/assessment.recipes. Every child list is gathered on
its own key and joined to its parent alone, so lists never multiply each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions import findings as fn
from triagelake.functions import texts
from triagelake.sources.shared import written

from .quick import without_personal

KEY = ("graph_id", "hypothesis_id")
_STRINGS = "array<string>"
#: References, snippets and places of a record at most.
REFERENCES, SNIPPETS, PLACES = 20, 12, 4
#: What a family means for its owner; the text of other families.
IMPACT = {
    "external_input_to_dangerous_operation": "User-controlled input may reach a dangerous operation unless a validated control blocks this path.",
    "sast_reachable_path": "A direct static finding appears reachable from analyzed application entry points.",
    "dependency_usage_path": "A vulnerable component is connected to observed code usage or the package dependency graph and may matter more than a presence-only dependency finding.",
    "ci_supply_chain_path": "Build automation may reach mutable or privileged resources and could affect release integrity.",
    "secret_impact_chain": "A secret context may reach a privileged integration or exposed resource, increasing operational impact.",
    "content_resource_exposure_path": "Hidden routes, private assets, or content clues may be exposed through static application content rather than protected by authorization.",
    "smart_contract_risk_path": "A smart contract may transfer value before updating internal accounting, which can enable reentrancy or repeated withdrawal.",
}
#: What is wrong, and what mends it.
CONCERN = {
    "external_input_to_dangerous_operation": "Untrusted input can reach a sensitive operation in this project without a validated check in between.",
    "sast_reachable_path": "A scanner flagged code that looks reachable from how this app is entered.",
    "dependency_usage_path": "A vulnerable dependency is connected to this project by an observed import, use site, or package dependency graph path.",
    "ci_supply_chain_path": "A build or CI step can reach privileged or mutable resources.",
    "secret_impact_chain": "A secret is connected to a privileged integration or an exposed resource.",
    "content_resource_exposure_path": "Static application content exposes a hidden route, private asset, or content clue that should not rely on obscurity.",
    "smart_contract_risk_path": "A smart contract sends value before updating internal state for the withdrawing account.",
}
FIX = {
    "external_input_to_dangerous_operation": "Validate, escape, or allowlist the untrusted value before it reaches that operation — or confirm an existing check already covers this case.",
    "sast_reachable_path": "Fix the flagged code and make sure nothing else reachable still hits the same unsafe pattern.",
    "dependency_usage_path": "Upgrade or replace the affected dependency, or remove the dependency graph path that brings it into the project.",
    "ci_supply_chain_path": "Pin the step and cut its privileges so it cannot reach resources it should not touch during a release.",
    "secret_impact_chain": "Scope the secret down and make sure it cannot reach the exposed resource without a control in front of it.",
    "content_resource_exposure_path": "Protect the route or asset with an explicit authorization check, remove the exposed clue, or confirm the resource is intentionally public.",
    "smart_contract_risk_path": "Move state updates before external calls, add a reentrancy guard, or otherwise prove the external call cannot reenter the withdrawal path.",
}
OTHER_FIX = "Add or verify a control that breaks this path."
UNPROVEN = "This was found by static analysis, which did not run your app — confirm the path is real, make the change, then re-check that it closes the path."
CRITERIA = ("The untrusted path is blocked by a validated control, or shown not to be reachable.", "The change is checked against the real code, not just this report.")
NO_RUN = "Runtime confirmation is still open — treat this path as unproven until the running app is exercised."
NO_RECIPE = "No runtime validation recipe was generated for this hypothesis."
NO_FINDING, A_FINDING = "No Quick Scan finding is directly linked to this path.", "A Quick Scan finding is linked to this path."
#: Edges and nodes that are controls.
CONTROL_EDGES, CONTROL_NODE = ("protected_by", "contradicted_by"), "Control"


def _by_family(values: dict[str, str], other: Column) -> Column:
    return reduce(lambda out, kv: out.when(F.col("family") == kv[0], kv[1]), values.items(), F.when(F.lit(False), "")).otherwise(other)


def references(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, hypothesis_id, graph_refs: known nodes by id, then known edges by id, of what supports and contradicts; the first 20.

    Of repeated ids in nodes or edges one is taken.
    """
    listed = lambda a, b: F.explode(F.array_union(F.coalesce(a, F.array().cast(_STRINGS)), F.coalesce(b, F.array().cast(_STRINGS)))).alias("id")
    none = F.lit(None).cast("string")
    of_node = nodes.select("graph_id", F.col("node_id").alias("id"), F.struct(F.lit("node").alias("type"), F.col("node_id").alias("id"), "kind", "label", "path", "line", none.alias("from_id"), none.alias("to_id")).alias("ref"))
    of_edge = edges.select("graph_id", F.col("edge_id").alias("id"), F.struct(F.lit("edge").alias("type"), F.col("edge_id").alias("id"), "kind", none.alias("label"), none.alias("path"), F.lit(None).cast("long").alias("line"), "from_id", "to_id").alias("ref"))
    found = rows.select(*KEY, listed("supporting_node_ids", "contradicting_node_ids")).join(of_node, ["graph_id", "id"]).select(*KEY, F.struct(F.lit(0).alias("rank"), "ref").alias("x"))
    found = found.unionByName(rows.select(*KEY, listed("supporting_edge_ids", "contradicting_edge_ids")).join(of_edge, ["graph_id", "id"]).select(*KEY, F.struct(F.lit(1).alias("rank"), "ref").alias("x")))
    first = found.groupBy(*KEY, "x.rank", "x.ref.id").agg(F.min("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("x.rank", "x.ref.id", "x.ref")))
    return first.groupBy(*KEY).agg(F.transform(F.slice(ordered, 1, REFERENCES), lambda r: r["ref"]).alias("graph_refs"))


def evidence_of(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """graph_id, hypothesis_id, evidence_id, ord: what a hypothesis rests on, what contradicts it, then the evidence of its findings; each once, where it comes first."""
    own = rows.select(*KEY, F.posexplode(F.concat("supporting_evidence_ids", "contradicting_evidence_ids")).alias("at", "evidence_id")).select(*KEY, "evidence_id", F.struct(F.lit(0).alias("part"), F.col("at").alias("a"), F.lit(0).alias("b")).alias("ord"))
    held = findings.select("graph_id", "finding_id", F.posexplode("evidence_ids").alias("b", "evidence_id"))
    theirs = rows.select(*KEY, F.posexplode("finding_ids").alias("a", "finding_id")).join(held, ["graph_id", "finding_id"]).select(*KEY, "evidence_id", F.struct(F.lit(1).alias("part"), "a", "b").alias("ord"))
    return own.unionByName(theirs).groupBy(*KEY, "evidence_id").agg(F.min("ord").alias("ord"))


def snippets(rows: DataFrame, findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """graph_id, hypothesis_id, snippets: the first 12 pieces of known evidence, redacted and cut to 500 characters."""
    said = texts.truncated(without_personal(F.col("snippet")))
    known = evidence.select("graph_id", "evidence_id", F.struct("evidence_id", "tool", "path", "line", "end_line", said.alias("snippet")).alias("e"))
    found = evidence_of(rows, findings).join(known, ["graph_id", "evidence_id"])
    ordered = F.array_sort(F.collect_list(F.struct("ord", "e")))
    return found.groupBy(*KEY).agg(F.transform(F.slice(ordered, 1, SNIPPETS), lambda x: x["e"]).alias("snippets"))


def places(rows: DataFrame, nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """graph_id, hypothesis_id, source, sink, spots: where a path starts and ends, and its places in order, each once."""
    at = lambda path, line: F.when(line.isNull(), path).otherwise(F.concat(path, F.lit(":"), line.cast("string")))
    on = nodes.select("graph_id", F.col("node_id").alias("id"), "kind", at(F.col("path"), F.col("line")).alias("place"))
    of_nodes = rows.select(*KEY, F.posexplode("supporting_node_ids").alias("a", "id")).join(on, ["graph_id", "id"]).select(*KEY, F.struct(F.lit(0).alias("part"), "a").alias("ord"), "kind", "place")
    spot = evidence.select("graph_id", F.col("evidence_id").alias("id"), at(F.col("path"), F.col("line")).alias("place"))
    of_evidence = rows.select(*KEY, F.posexplode("supporting_evidence_ids").alias("a", "id")).join(spot, ["graph_id", "id"]).select(*KEY, F.struct(F.lit(1).alias("part"), "a").alias("ord"), F.lit("").alias("kind"), "place")
    found = of_nodes.unionByName(of_evidence)
    first = lambda *kinds: F.min_by(F.when(F.col("kind").isin(*kinds), F.struct("place")), F.when(F.col("kind").isin(*kinds), F.col("ord")))["place"]
    spots = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("ord", "place")))), lambda x: x["place"]))
    return found.groupBy(*KEY).agg(first("Source", "Boundary").alias("source"), first("Sink").alias("sink"), spots.alias("spots"))


def catalog(rows: DataFrame) -> DataFrame:
    """rows (with family, title, status, confidence, finding_ids, source, sink, spots, recipe) and the texts that the catalog has for them."""
    concern, fix = _by_family(CONCERN, F.col("title")), _by_family(FIX, F.lit(OTHER_FIX))
    spots = F.coalesce("spots", F.array().cast(_STRINGS))
    few = F.array_join(F.slice(spots, 1, PLACES), ", ")
    source, sink, none = F.col("source"), F.col("sink"), F.size(spots) == 0
    both = source.isNotNull() & sink.isNotNull() & (source != sink)
    where = F.when(both, F.concat(F.lit(" It starts at "), source, F.lit(" and reaches "), sink, F.lit("."))).when(sink.isNotNull(), F.concat(F.lit(" The operation is at "), sink, F.lit("."))).when(source.isNotNull(), F.concat(F.lit(" It starts at "), source, F.lit(".")))
    where = where.when(~none, F.concat(F.lit(" Relevant code: "), few, F.lit("."))).otherwise("")
    percent = F.floor(F.col("confidence") * 100 + 0.5).cast("long").cast("string")
    sure = F.concat(F.lit("Static analysis supports this path with about "), percent, F.lit("% confidence; it has not been confirmed by running the app."))
    recipe, fixtures = F.col("recipe"), F.array_join("recipe.fixtures", ", ")
    last = F.when(recipe.isNull(), NO_RUN).otherwise(F.concat(F.lit("Runtime confirmation can later use these fixtures: "), fixtures, F.lit(".")))
    joined = lambda c: F.array_join(c, " ")
    known = F.when(F.size("recipe.gaps") > 0, F.concat(F.lit("Known gaps: "), joined("recipe.gaps")))
    lines = F.concat_ws("\n", F.concat(F.lit("Required fixtures: "), fixtures, F.lit(".")), F.concat(F.lit("Steps: "), joined("recipe.steps")), F.concat(F.lit("Expected result: "), "recipe.expected"), F.concat(F.lit("Safety notes: "), joined("recipe.notes")), known)
    attack = F.concat(concern, where)
    return rows.withColumn("catalog", F.struct(
        fn.stable_id("hypothesis_enrichment", F.col("hypothesis_id")).alias("enrichment_id"), F.lit("catalog").alias("source"), attack.alias("attack"), F.array(sure, F.when(F.size("finding_ids") == 0, NO_FINDING).otherwise(A_FINDING)).alias("assumptions"),
        _by_family(IMPACT, F.concat(F.lit("Static graph evidence produced "), "status", F.lit(" support for this hypothesis."))).alias("impact"), F.when(none, fix).otherwise(F.concat(fix, F.lit(" Focus on "), few, F.lit("."))).alias("remediation"),
        F.concat_ws(" ", attack, fix, F.lit(UNPROVEN)).alias("prompt"), F.array(*(F.lit(c) for c in CRITERIA), last).alias("criteria"), F.when(recipe.isNull(), NO_RECIPE).otherwise(lines).alias("validation"),
    ))


def details(hypotheses: DataFrame, candidates: DataFrame, nodes: DataFrame, edges: DataFrame, findings: DataFrame, evidence: DataFrame, recipes: DataFrame) -> DataFrame:
    """One nested record for each hypothesis of a known candidate: its own values, graph_refs, controls, gaps, snippets, recipe and catalog texts.

    Lists are empty where there is nothing, the recipe null. Hypotheses without their candidate have no record.
    """
    ids = ("finding_ids", "supporting_node_ids", "supporting_edge_ids", "contradicting_node_ids", "contradicting_edge_ids", "coverage_refs", "required_validation")
    own = hypotheses.select(*KEY, "candidate_id", "title", "status", "confidence", "state", "summary", "supporting_evidence_ids", "contradicting_evidence_ids")
    rows = own.join(candidates.select("graph_id", "candidate_id", "family", "rule_id", *(F.array_sort(F.array_distinct(c)).alias(c) for c in ids)), ["graph_id", "candidate_id"])
    # each child list reads the rows again
    rows = written(rows, "detail-rows")
    steps = recipes.select(*KEY, F.struct("recipe_id", "fixtures", "steps", "expected", "notes", "gaps").alias("recipe"))
    for children in (references(rows, nodes, edges), snippets(rows, findings, evidence), places(rows, nodes, evidence), steps):
        rows = rows.join(children, list(KEY), "left")
    ref = F.col("graph_refs")
    controls = F.filter(ref, lambda r: F.when(r["type"] == "node", r["kind"] == CONTROL_NODE).otherwise(r["kind"].isin(*CONTROL_EDGES)))
    gaps = F.concat(F.filter("coverage_refs", lambda r: ~r.endswith(":checked")), F.when(F.col("state") == "checked", F.array().cast(_STRINGS)).otherwise(F.array(F.concat(F.lit("static_coverage:"), "state"))), F.when(F.col("status") == "inconclusive", F.array("summary")).otherwise(F.array().cast(_STRINGS)))
    empty = lambda c: F.coalesce(c, F.filter(c, lambda x: F.lit(False)), F.from_json(F.lit("[]"), rows.schema[c].dataType))
    rows = rows.withColumns({"graph_refs": empty("graph_refs"), "snippets": empty("snippets")})
    rows = rows.withColumns({"controls": controls, "gaps": F.array_sort(F.array_distinct(gaps))})
    return catalog(rows).drop("source", "sink", "spots")


#: Fields that a returned record may not have at any depth, and those that it must have.
PROHIBITED = (
    "id", "source", "candidateId", "candidate_id", "family", "ruleId", "rule_id", "status", "staticStatus", "static_status", "staticConfidence", "static_confidence", "priority", "priorityScore", "priority_score",
    "verdict", "verdictImpact", "verdict_impact", "runtimeValidationRequired", "runtime_validation_required", "findingIds", "finding_ids", "supportingNodeIds", "supporting_node_ids", "supportingEdgeIds", "supporting_edge_ids", "contradictingNodeIds", "contradicting_node_ids",
    "contradictingEdgeIds", "contradicting_edge_ids", "coverageState", "coverage_state", "coverageRefs", "coverage_refs", "requiredValidation", "required_validation", "graphRefs", "graph_refs", "path", "paths",
)
TEXTS, LISTS = ("attackDescription", "impact", "remediation", "agentPrompt", "validationRecipeText"), ("assumptions", "acceptanceCriteria")


def returned(records: DataFrame, expected: DataFrame, prohibited: tuple[str, ...] = PROHIBITED, deep: bool = True) -> DataFrame:
    """graph_id, hypothesis_id, ord, verdict of a batch's records (graph_id, ord, raw: JSON), and of what is missing from it (ord null).

    The first that applies: not_an_object, prohibited_field (at any depth; without deep, of the record itself), unknown_id, repeated_id (an earlier
    record of the same id is accepted), empty_text, unsafe_text; else accepted. `missing` is an expected id
    without an accepted record. Ids are joined from both sides, so neither side's strays are lost.
    """
    parsed = records.select("graph_id", "ord", F.try_parse_json("raw").alias("v"))
    kind = F.schema_of_variant("v")
    keys = _keys(F.col("v")) if deep else F.map_keys(F.try_variant_get("v", "$", "map<string,variant>"))
    text = lambda name: F.try_variant_get("v", f"$.{name}", "string")
    bad = lambda t: F.coalesce(F.trim(t) == "", F.lit(True))
    lists = [F.try_variant_get("v", f"$.{n}", "array<variant>") for n in LISTS]
    is_text = lambda name: F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant")) == "STRING"
    items = [F.transform(x, lambda y: F.when(F.schema_of_variant(y) == "STRING", F.try_variant_get(y, "$", "string"))) for x in lists]
    blank = reduce(lambda a, b: a | b, [~F.coalesce(is_text(n), F.lit(False)) | bad(text(n)) for n in TEXTS] + [x.isNull() | (F.size(x) == 0) | F.exists(x, bad) for x in items])
    all_texts = F.concat(F.array(*(text(n) for n in TEXTS)), *(F.coalesce(x, F.array().cast(_STRINGS)) for x in items))
    unsafe = F.exists(all_texts, lambda t: F.coalesce(~texts.safe(without_personal(t)), F.lit(False)))
    object_ = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    hyp = F.when(object_ & F.coalesce(is_text("hypothesisId"), F.lit(False)), text("hypothesisId"))
    rows = parsed.select("graph_id", "ord", hyp.alias("hypothesis_id"), object_.alias("is_object"), F.arrays_overlap(keys, F.array(*(F.lit(p) for p in prohibited))).alias("has_prohibited"), blank.alias("blank"), unsafe.alias("unsafe"))
    known = expected.select("graph_id", "hypothesis_id").distinct().withColumn("asked", F.lit(True))
    rows = rows.join(known, ["graph_id", "hypothesis_id"], "full")
    first = F.when(F.col("ord").isNull(), "missing").when(~F.col("is_object"), "not_an_object").when(F.coalesce("has_prohibited", F.lit(False)), "prohibited_field").when(F.col("asked").isNull(), "unknown_id").when(F.col("blank"), "empty_text").when(F.col("unsafe"), "unsafe_text").otherwise("accepted")
    rows = rows.withColumn("verdict", first)
    good = rows.where("verdict = 'accepted'").groupBy("graph_id", "hypothesis_id").agg(F.min("ord").alias("taken"))
    rows = rows.join(good, ["graph_id", "hypothesis_id"], "left")
    later = (F.col("verdict").isin("accepted", "empty_text", "unsafe_text")) & (F.col("ord") > F.col("taken"))
    out = rows.select("graph_id", "hypothesis_id", "ord", F.when(later, "repeated_id").otherwise(F.col("verdict")).alias("verdict"))
    lost = known.select("graph_id", "hypothesis_id").join(good, ["graph_id", "hypothesis_id"], "left_anti").join(out.where("verdict = 'missing'").select("graph_id", "hypothesis_id"), ["graph_id", "hypothesis_id"], "left_anti")
    return out.unionByName(lost.select("graph_id", "hypothesis_id", F.lit(None).cast(out.schema["ord"].dataType).alias("ord"), F.lit("missing").alias("verdict")))


def _keys(value: Column) -> Column:
    """The names of all fields of a variant, at any depth: texts of its JSON that a colon follows."""
    said = F.regexp_extract_all(F.to_json(value), F.lit(r'"(?:[^"\\]|\\.)*":?'), F.lit(0))
    return F.transform(F.filter(said, lambda x: x.endswith(":")), lambda x: F.substring(x, F.lit(2), F.length(x) - 3))


def invalid(records: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """check_id, record_id, message: enrichments (graph_id, enrichment_id, hypothesis_id, source, texts and lists of catalog) that are repeated, unknown, of another source or without a text."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    tests = [("source", ~F.coalesce(F.col("source").isin("catalog", "model"), F.lit(False)), "source is invalid"), *((c, blank(F.col(c)), f"{c} is empty") for c in ("enrichment_id", "hypothesis_id", "attack", "impact", "remediation", "prompt", "validation"))]
    tests += [(c, F.coalesce((F.size(c) <= 0) | F.exists(c, blank), F.lit(True)), f"{c} is empty or holds an empty text") for c in ("assumptions", "criteria")]
    failed = F.array(*(F.when(test, F.struct(F.lit(f"empty_{name}" if name != "source" else "invalid_source").alias("check_id"), F.lit(message).alias("message"))) for name, test, message in tests))
    out = records.select("graph_id", F.col("enrichment_id").alias("record_id"), F.explode(F.array_compact(failed)).alias("x")).select("x.check_id", "record_id", "x.message")
    for column in ("enrichment_id", "hypothesis_id"):
        again = records.groupBy("graph_id", column).agg(F.count("*").alias("n")).where("n > 1")
        out = out.unionByName(again.select(F.lit(f"duplicate_{column}").alias("check_id"), F.col(column).alias("record_id"), F.lit("is not unique").alias("message")))
    lost = records.join(hypotheses.select("graph_id", "hypothesis_id"), ["graph_id", "hypothesis_id"], "left_anti")
    return out.unionByName(lost.select(F.lit("unknown_hypothesis").alias("check_id"), F.col("enrichment_id").alias("record_id"), F.lit("references an unknown hypothesis").alias("message")))
