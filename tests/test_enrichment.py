"""Detail records, catalog texts, checks of returned batches and of stored records, by hand and by plain Python."""

import json
import random

from triagelake.operators import enrichment

CANDIDATES = "graph_id string, candidate_id string, family string, rule_id string, finding_ids array<string>, supporting_node_ids array<string>, supporting_edge_ids array<string>, contradicting_node_ids array<string>, contradicting_edge_ids array<string>, coverage_refs array<string>, required_validation array<string>"
HYPOTHESES = "graph_id string, hypothesis_id string, candidate_id string, title string, status string, confidence double, state string, summary string, supporting_evidence_ids array<string>, contradicting_evidence_ids array<string>"
NODES, EDGES = "graph_id string, node_id string, kind string, label string, path string, line long", "graph_id string, edge_id string, kind string, from_id string, to_id string"
FINDINGS, EVIDENCE = "graph_id string, finding_id string, evidence_ids array<string>", "graph_id string, evidence_id string, tool string, path string, line long, end_line long, snippet string"
RECIPES = "graph_id string, hypothesis_id string, recipe_id string, fixtures array<string>, steps array<string>, expected string, notes array<string>, gaps array<string>"
FLOW = "external_input_to_dangerous_operation"


def made(spark, hypotheses, candidates, nodes=(), edges=(), findings=(), evidence=(), recipes=()):
    frames = [spark.createDataFrame(list(r), t) for r, t in ((hypotheses, HYPOTHESES), (candidates, CANDIDATES), (nodes, NODES), (edges, EDGES), (findings, FINDINGS), (evidence, EVIDENCE), (recipes, RECIPES))]
    return {r["hypothesis_id"]: r.asDict(True) for r in enrichment.details(*frames).collect()}


def test_a_whole_record(spark):
    candidate = ("g", "k", FLOW, "r", ["f2", "f1"], ["n2", "n1", "n9"], ["e1"], ["n3"], ["e2"], ["x:checked", "y:partial"], ["v", "v"])
    nodes = [("g", "n1", "Source", "S", "a.ts", 3), ("g", "n2", "Sink", "T", "b.ts", None), ("g", "n3", "Control", "C", None, None), ("h", "n9", "Sink", "other graph", "z.ts", 1)]
    edges = [("g", "e1", "calls", "n1", "n2"), ("g", "e2", "protected_by", "n2", "n3")]
    evidence = [("g", "v1", "t", "c.ts", 7, 8, "password = 'hunter2hunter2'"), ("g", "v2", "t", "d.ts", 9, 9, "x" * 600), ("g", "v3", "t", "e.ts", 1, 1, "y")]
    got = made(spark, [("g", "h", "k", "T1", "inconclusive", 0.655, "partial", "why", ["v2", "lost"], ["v3"])], [candidate], nodes, edges, [("g", "f1", ["v1", "v2"]), ("g", "f2", ["v3"])], evidence, [("g", "h", "p", ["fx", "fy"], ["One.", "Two."], "None.", ["Safe."], [])])["h"]
    assert [(r["type"], r["id"]) for r in got["graph_refs"]] == [("node", "n1"), ("node", "n2"), ("node", "n3"), ("edge", "e1"), ("edge", "e2")] and [r["id"] for r in got["controls"]] == ["n3", "e2"]
    assert got["gaps"] == ["static_coverage:partial", "why", "y:partial"] and got["finding_ids"] == ["f1", "f2"] and got["required_validation"] == ["v"]
    assert [s["evidence_id"] for s in got["snippets"]] == ["v2", "v3", "v1"] and "hunter2" not in got["snippets"][2]["snippet"] and got["snippets"][0]["snippet"] == "x" * 500 + "... [truncated]"
    c = got["catalog"]
    assert c["attack"] == "Untrusted input can reach a sensitive operation in this project without a validated check in between. It starts at a.ts:3 and reaches b.ts."
    assert c["remediation"].endswith(" Focus on a.ts:3, b.ts, d.ts:9.") and c["assumptions"] == ["Static analysis supports this path with about 66% confidence; it has not been confirmed by running the app.", "A Quick Scan finding is linked to this path."]
    assert c["criteria"][2] == "Runtime confirmation can later use these fixtures: fx, fy." and c["validation"] == "Required fixtures: fx, fy.\nSteps: One. Two.\nExpected result: None.\nSafety notes: Safe."


def test_texts_without_places_and_records_without_parts(spark):
    bare = lambda k, family, nodes=(): ("g", k, family, "r", [], list(nodes), [], [], [], [], [])
    hypotheses = [("g", f"h{k}", k, "Own title", "candidate", 0.5, "checked", "s", [], []) for k in ("a", "b", "c", "gone")]
    got = made(spark, hypotheses, [bare("a", "new_family"), bare("b", FLOW, ["s"]), bare("c", FLOW, ["x", "y"])], [("g", "s", "Sink", "S", "b.ts", 2), ("g", "x", "CodeEntity", "X", "x.ts", 1), ("g", "y", "Source", "Y", None, None)])
    assert set(got) == {"ha", "hb", "hc"}
    a, b, c = (got[k]["catalog"] for k in ("ha", "hb", "hc"))
    assert a["attack"] == "Own title" and a["impact"] == "Static graph evidence produced candidate support for this hypothesis." and a["remediation"] == "Add or verify a control that breaks this path." and a["validation"].startswith("No runtime")
    assert b["attack"].endswith(" The operation is at b.ts:2.") and c["attack"].endswith(" Relevant code: x.ts:1.")
    assert got["ha"]["graph_refs"] == [] and got["ha"]["snippets"] == [] and got["ha"]["gaps"] == [] and got["ha"]["recipe"] is None


def test_lists_are_bounded_and_do_not_multiply(spark):
    rng = random.Random(2)
    ids = [f"n{k:03}" for k in range(60)]
    nodes = [("g", i, "CodeEntity", i, f"{i}.ts", 1) for i in ids] * 2
    evidence = [("g", f"v{k:02}", "t", f"v{k}.ts", k, k, "s") for k in range(40)]
    findings = [("g", f"f{k}", [f"v{(3 * k + j) % 40:02}" for j in range(3)]) for k in range(20)]
    hypotheses, candidates, want = [], [], {}
    for k in range(12):
        on, against, found = rng.sample(ids, 25), rng.sample(ids, 9), [f"f{rng.randrange(20)}" for _ in range(8)]
        own = [f"v{rng.randrange(44):02}" for _ in range(6)]
        candidates.append(("g", f"k{k}", "fam", "r", found, on, [], against, [], [], []))
        hypotheses.append(("g", f"h{k}", f"k{k}", "T", "candidate", 0.1, "checked", "s", own[:3], own[3:]))
        order = dict.fromkeys([*own, *(v for f in sorted(set(found)) for v in dict((x[1], x[2]) for x in findings)[f])])
        want[f"h{k}"] = (sorted({*on, *against})[:20], [v for v in order if v in {e[1] for e in evidence}][:12])
    got = made(spark, hypotheses, candidates, nodes, (), findings, evidence)
    assert {h: ([r["id"] for r in d["graph_refs"]], [s["evidence_id"] for s in d["snippets"]]) for h, d in got.items()} == want


GOOD = {"attackDescription": "a", "assumptions": ["b"], "impact": "c", "remediation": "d", "agentPrompt": "e", "acceptanceCriteria": ["f"], "validationRecipeText": "g"}


def test_returned_batches(spark):
    say = lambda h, **more: json.dumps({"hypothesisId": h, **GOOD, **more})
    raw = [
        (say("h1"), "accepted"), (say("h1"), "repeated_id"), (say("h2", impact=" "), "empty_text"), (say("h2"), "accepted"), (say("h3", extra={"deep": [{"status": "x"}]}), "prohibited_field"), (say("h4", verdict="ok"), "prohibited_field"), (say("h5", assumptions=[]), "empty_text"),
        (say("h5", assumptions=["x", 3]), "empty_text"), (say("h5", impact="It was proven."), "unsafe_text"), (say("h5", agentPrompt='see "/etc/passwd"'), "unsafe_text"), (say("nobody"), "unknown_id"), (json.dumps([1]), "not_an_object"), ("{broken", "not_an_object"), (None, "not_an_object"),
        (say("h6", note='"status": fine'), "accepted"), (json.dumps({**GOOD, "hypothesisId": 7}), "unknown_id"), (say("h1", impact=""), "repeated_id"), (say("h7", impact=5), "empty_text"),
    ]
    records = spark.createDataFrame([("g", n, r) for n, (r, _) in enumerate(raw)] + [("other", 99, say("h1"))], "graph_id string, ord long, raw string")
    expected = spark.createDataFrame([("g", f"h{k}") for k in range(1, 9)] * 2, "graph_id string, hypothesis_id string")
    rows = enrichment.returned(records, expected).collect()
    assert {r["ord"]: r["verdict"] for r in rows if r["ord"] is not None} == {**{n: v for n, (_, v) in enumerate(raw)}, 99: "unknown_id"}
    assert sorted(r["hypothesis_id"] for r in rows if r["ord"] is None) == ["h3", "h4", "h5", "h7", "h8"] and all(r["verdict"] == "missing" for r in rows if r["ord"] is None)
    shallow = {r["ord"]: r["verdict"] for r in enrichment.returned(records, expected, deep=False).collect()}
    assert shallow[4] == "accepted" and shallow[5] == "prohibited_field"
    assert enrichment.returned(records.limit(0), expected.limit(0)).count() == 0


def test_stored_records(spark):
    schema = "graph_id string, enrichment_id string, hypothesis_id string, source string, attack string, assumptions array<string>, impact string, remediation string, prompt string, criteria array<string>, validation string"
    good = ("g", "e1", "h1", "catalog", "a", ["b"], "c", "d", "e", ["f"], "g")
    rows = [good, ("g", "e1", "h2", "model", "a", ["b"], "c", "d", "e", ["f"], "g"), ("g", "e3", "h2", "guess", " ", [], None, "d", "e", ["f", ""], "g"), ("g", "e4", "gone", "model", "a", ["b"], "c", "d", "e", None, "g")]
    known = spark.createDataFrame([("g", "h1"), ("g", "h2")], "graph_id string, hypothesis_id string")
    got = {(r["check_id"], r["record_id"]) for r in enrichment.invalid(spark.createDataFrame(rows, schema), known).collect()}
    assert got == {("duplicate_enrichment_id", "e1"), ("duplicate_hypothesis_id", "h2"), ("invalid_source", "e3"), ("empty_attack", "e3"), ("empty_assumptions", "e3"), ("empty_impact", "e3"), ("empty_criteria", "e3"), ("unknown_hypothesis", "e4"), ("empty_criteria", "e4")}
    assert enrichment.invalid(spark.createDataFrame([good], schema), known).count() == 0
