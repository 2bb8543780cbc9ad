"""What a reviewer is shown, on rows written by hand."""

from triagelake.operators import review

SAID = "repo_id string, hypothesis_id string, title string, status string, runtime boolean, confidence double"
ENRICHED = "repo_id string, hypothesis_id string, attack_description string, impact string, agent_prompt string"
RECIPES = "repo_id string, hypothesis_id string, required_fixtures array<string>, expected_result string"
POLICIES = "repo_id string, category string, ground_truth_ids array<string>, limitation string, challenge_gaps array<string>"


def test_actions_tell_what_they_leave_out(spark):
    actions = spark.createDataFrame([("r", "a1", "k1"), ("r", "a2", "k2"), ("r", "a3", "k3")], "repo_id string, action_id string, remediation_key string")
    many = [("r", "k1", f"f{n % 25}", f"R{n % 14:02}", "t", "high") for n in range(60)] + [("r", "k1", None, "R00", "t", None), ("r", "k2", "x", "R", "t", "low"), ("q", "k1", "x", "R", "t", "low")]
    findings = spark.createDataFrame(many, "repo_id string, remediation_key string, path string, rule_id string, tool string, severity string")
    got = {r["action_id"]: tuple(r)[2:] for r in review.hidden_counts(actions, findings).collect()}
    assert got == {"a1": (61, 10, 51, 25, 20, 5), "a2": (1, 1, 0, 1, 1, 0), "a3": (0, 0, 0, 0, 0, 0)}
    buckets = sorted((r["what"], r["nth"], r["value"], r["n"]) for r in review.top_buckets(actions, findings).where("action_id = 'a1'").collect())
    # 60 findings over 14 rules: R00 to R03 have five, one more R00 without a path; the last two rules are left out
    rules = [("rules", 1, "R00", 6)] + [("rules", 1 + n, f"R{n:02}", 5 if n < 4 else 4) for n in range(1, 12)]
    assert buckets == [*rules, ("severities", 1, "high", 60), ("tools", 1, "t", 61)]


def test_hypotheses_that_say_the_same_are_reported_once(spark):
    ok = "statically_supported"
    said = [("r", "h1", "SQL  in a", ok, True, 0.5), ("r", "h2", " sql in A ", ok, True, 0.9), ("r", "h3", "sql in a", ok, False, 0.9), ("r", "h4", "sql in a", ok, True, 0.9), ("r", "h5", "sql in a", ok, True, 0.9), ("r", "h6", "sql in a", "statically_contradicted", True, 1.0), ("q", "h1", "sql in a", ok, True, 0.1), ("r", "h7", "sql in a", ok, True, 0.9), ("r", "h8", None, None, None, None)]
    text = lambda repo, h, prompt="Fix": (repo, h, "Reads data", "All\nrows", prompt)
    enriched = [text("r", h) for h in ("h1", "h2", "h3", "h7")] + [text("q", "h1"), ("r", "h8", None, None, None)]
    recipes = [("r", "h7", ["A  user"], "Done")]
    got = review.reportable(spark.createDataFrame(said, SAID), spark.createDataFrame(enriched, ENRICHED), spark.createDataFrame(recipes, RECIPES)).collect()
    # h1 says what h2 says; h4 and h5 have no enrichment; h7 has a recipe
    assert sorted((r["repo_id"], r["hypothesis_id"]) for r in got) == [("q", "h1"), ("r", "h2"), ("r", "h3"), ("r", "h4"), ("r", "h5"), ("r", "h7"), ("r", "h8")]


def test_marks_and_samples_of_what_nobody_reviewed(spark):
    hypothesis = "repo_id string, ord long, hypothesis_id string, candidate_id string, family string, rule_id string, title string, reason string, status string"
    ok = "statically_supported"
    rows = [("r", n, f"h{n}", f"k{n}", "xss", "hr", "Path", f"why {n}", ok) for n in range(10)] + [("r", 20, "h20", None, "xss", "hr", None, "w", ok), ("r", 21, "h21", "k21", "xss", "hr", "Path", "w", "candidate")]
    matcher = "repo_id string, item_ord long, item_id string, in_scope boolean, family string, candidate_family string, rule_id string, title_parts array<string>, reason_part string, statuses array<string>"
    item = lambda ord_, name, reason, scope: ("r", ord_, name, scope, None, "xss", None, None, reason, None)
    frame = lambda *items: spark.createDataFrame(list(items), matcher)
    truth = frame(item(1, "t1", "why 0", True), item(2, "t2", "why", None), item(3, "t3", "why 5", False))
    marked = review.reviewed(spark.createDataFrame(rows, hypothesis), truth, frame(item(1, "u", "why 2", None), item(2, "v", "why 0", None)), frame(item(1, "w", "why 3", None), item(2, "x", "why 2", None)))
    assert [tuple(r) for r in review.review_summary(marked).collect()] == [("r", 11, 2, 1, 1, 7)]
    candidates = spark.createDataFrame([("r", f"k{n}", "kept", f"because {n}") for n in (4, 5, 6, 7, 8, 9)] + [("q", "k4", "other", "no")], "repo_id string, candidate_id string, family string, reason string")
    got = {(r["family"], r["title"]): (r["n"], r["ids"], r["reasons"]) for r in review.review_groups(marked, candidates).collect()}
    assert got == {("kept", "Path"): (6, ["h4", "h5", "h6", "h7", "h8"], ["because 4", "because 5", "because 6"]), ("unknown", None): (1, ["h20"], [])}


def test_audit_of_an_inventory(spark):
    challenges = spark.createDataFrame([("r", c) for c in ("a", "a", "b", "c", "d", "e")], "repo_id string, category string")
    policies = spark.createDataFrame([("r", "a", ["t1", "t9"], "slow", ["open", "  "]), ("r", "b", [], None, ["x"]), ("r", "d", None, "known", None), ("r", "e", ["t1"], None, []), ("r", "z", ["t8"], "l", ["g"])], POLICIES)
    known = spark.createDataFrame([("t1",), ("t1",), (None,)], "item_id string")
    assert [tuple(r) for r in review.inventory_summary(challenges, policies).collect()] == [("r", 6, 5, 2, 2, 1, 2)]
    shown = lambda **how: [r["error"] for r in review.inventory_errors(challenges, policies, known, **how).orderBy("step", "category", "nth").collect()]
    missing, empty = "category a references missing groundTruth id: t9", "category a has an empty challenge gap"
    rest = ["category b coverage must name groundTruthIds or a limitation", "category c has 1 challenges but no inventory coverage policy"]
    unused = "category coverage policy has no matching challenge category: z"
    assert shown() == [missing, empty, *rest, unused]
    assert shown(fail_on_limitations=True, fail_on_gaps=True) == [missing, "category a has documented limitation: slow", "category a has open challenge gap: open", empty, *rest, "category d has documented limitation: known", unused]
    assert review.inventory_summary(challenges.limit(0), policies.limit(0)).count() == 0


def test_coverage_counts_every_graph(spark):
    graphs = spark.createDataFrame([("g",), ("h",), ("g",)], "graph_id string")
    nodes = spark.createDataFrame([("g", "CodeEntity"), ("g", "CodeEntity"), ("g", "Boundary"), ("g", "Sink")], "graph_id string, kind string")
    edges = spark.createDataFrame([("g", "calls")] * 3 + [("g", "registers")], "graph_id string, kind string")
    flows, seeds = spark.createDataFrame([("x",)], "graph_id string"), spark.createDataFrame([("g",)], "graph_id string")
    got = {(r["graph_id"], r["area"]): (r["state"], r["covered"], r["total"], r["reason"] is None) for r in review.code_coverage(graphs, nodes, edges, flows, seeds).collect()}
    assert got == {
        ("g", "entities"): ("checked", 2, 2, True), ("g", "boundaries"): ("checked", 1, 2, True), ("g", "call_graph"): ("checked", 3, 3, True), ("g", "data_flow"): ("partial", 0, 1, False),
        ("h", "entities"): ("partial", 0, 0, False), ("h", "boundaries"): ("partial", 0, 0, False), ("h", "call_graph"): ("partial", 0, 0, False), ("h", "data_flow"): ("skipped", 0, 1, False),
    }
    seen = spark.createDataFrame([("g", 2), ("g", 3), ("x", 1)], "graph_id string, n int")
    assert sorted((r["graph_id"], r["state"], r["covered"], r["total"]) for r in review.observed_coverage(graphs, seen, "ci_iac", "p").collect()) == [("g", "checked", 5, 5), ("h", "checked", 0, 0)]


def test_a_map_lists_its_entries_in_order(spark):
    from triagelake.operators import repository_map

    nodes = spark.createDataFrame([("g", "n2", "CodeEntity", "b", "src/x", "checked", ["v2", "v1"]), ("g", "n1", "CodeEntity", "a", "src/x", "partial", []), ("g", "n3", "CodeEntity", "z", None, "checked", None), ("g", "n4", "Other", "o", None, "checked", []), ("h", "n1", "Component", "c", None, "checked", [])], "graph_id string, node_id string, kind string, label string, path string, state string, evidence_ids array<string>")
    edges = spark.createDataFrame([("g", "e1", "calls", "n2", "gone", "checked", []), ("g", "e2", "calls", "n1", "n2", "failed", ["v"])], "graph_id string, edge_id string, kind string, from_id string, to_id string, state string, evidence_ids array<string>")
    flows = spark.createDataFrame([("g", "w", "n1", "gone", ["e2", "e1"], "checked")], "graph_id string, flow_id string, source_id string, sink_id string, edge_ids array<string>, state string")
    areas = ("boundaries", "call_graph", "dependency_usage", "ci_iac", "content_assets", "smart_contracts", "language_support")
    rows = [(g, a, "p", "checked", 1, 2, None) for g in ("g", "h") for a in areas] + [("g", "data_flow", "p", "partial", None, None, "why"), ("h", "data_flow", "p", "checked", 1, 1, None)]
    coverage = spark.createDataFrame(rows, "graph_id string, area string, producer string, state string, covered long, total long, reason string")
    got = {}
    for r in repository_map.entries(nodes, edges, flows, coverage).orderBy("nth").collect():
        got.setdefault((r["graph_id"], r["section"]), []).append((r["nth"], r["entry_id"], r["from_label"], r["to_label"], r["evidence_ids"], r["note"]))
    assert [x[:2] for x in got.pop(("g", "coverage"))] == [(n + 1, f"{a}:p") for n, a in enumerate(sorted([*areas, "data_flow"]))] and len(got.pop(("h", "coverage"))) == 8
    assert got == {
        ("g", "codeEntities"): [(1, "n3", None, None, None, None), (2, "n1", None, None, [], None), (3, "n2", None, None, ["v1", "v2"], None)],
        ("g", "relationships"): [(1, "e2", "a", "b", ["v"], None), (2, "e1", "b", "gone", [], None)],
        ("g", "flows"): [(1, "w", "a", "gone", None, "e2>e1")],
        ("g", "factGaps"): [(1, "coverage:data_flow:p", None, None, None, "why"), (2, "edge:e2", None, None, None, "calls relationship coverage is failed."), (3, "node:n1", None, None, None, "CodeEntity coverage is partial.")],
        ("h", "integrations"): [(1, "n1", None, None, [], None)],
    }
