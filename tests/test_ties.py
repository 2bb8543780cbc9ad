"""Ties have one result, whatever the order of rows; rows that share a name are not paired."""

import pytest

from triagelake.operators import dependencies, property_graph, repository_map


@pytest.mark.parametrize("turned", [False, True])
def test_evidence_of_equal_order_is_of_the_shortest_name(spark, turned):
    rows = [("r", 38, "y/z/p", ["a"]), ("r", 38, "p", ["b"])]
    evidence = spark.createDataFrame(rows[::-1] if turned else rows, "repo_id string, ord long, package_name string, evidence_ids array<string>").coalesce(1)
    packages = spark.createDataFrame([("r", "z/p")], "repo_id string, name string")
    assert [r["evidence_ids"] for r in dependencies.evidence_for(packages, evidence).collect()] == [["b"]]


@pytest.mark.parametrize("turned", [False, True])
def test_flows_of_one_id_are_ordered_by_their_ends(spark, turned):
    rows = [("g", "w", "n1", f"n{k}", ["e1"], state) for k, state in ((2, "partial"), (3, "checked"), (4, "partial"))]
    nodes = spark.createDataFrame([("g", f"n{k}", "Other", "l", None, "checked", []) for k in range(5)], "graph_id string, node_id string, kind string, label string, path string, state string, evidence_ids array<string>")
    edges = spark.createDataFrame([], "graph_id string, edge_id string, kind string, from_id string, to_id string, state string, evidence_ids array<string>")
    flows = spark.createDataFrame(rows[::-1] if turned else rows, "graph_id string, flow_id string, source_id string, sink_id string, edge_ids array<string>, state string").coalesce(1)
    coverage = spark.createDataFrame([], "graph_id string, area string, producer string, state string, covered long, total long, reason string")
    got = repository_map.entries(nodes, edges, flows, coverage).where("section = 'flows'").collect()
    assert sorted((r["nth"], r["to_id"]) for r in got) == [(1, "n2"), (2, "n3"), (3, "n4")]


def test_entities_of_one_name_meet_each_sink_once(spark):
    who = spark.createDataFrame([("g", "f", "p", f"k{n % 2}") for n in range(30)], "graph_id string, full_name string, path string, entity_key string")
    sinks = spark.createDataFrame([("g", "f", "p", 1, "eval", "eval", "code_execution", n) for n in range(30)], "graph_id string, full_name string, path string, line long, call_name string, label string, sink_type string, nth long")
    assert sorted(r["entity_key"] for r in property_graph.owned_sinks(sinks, who).collect()) == ["k0", "k1"]


def test_actions_of_the_same_findings_share_their_links(spark):
    from triagelake.operators import assessment

    actions = spark.createDataFrame([("g", f"a{n}", ["f1", "f2"] if n % 2 else ["f2", "f1", "f1"]) for n in range(20)] + [("g", "none", []), ("g", "twice", ["f1"]), ("g", "twice", ["f3"])], "graph_id string, action_id string, finding_ids array<string>")
    hypotheses = spark.createDataFrame([("g", f"h{n}", "candidate", [f"f{n % 3}"]) for n in range(9)] + [("g", "no", "statically_contradicted", ["f1"]), ("g", "named", "candidate", [])], "graph_id string, hypothesis_id string, status string, finding_ids array<string>")
    contexts = spark.createDataFrame([("g", "f3", "linked_to_hypothesis", ["named", "no", "gone"]), ("g", "f1", "standalone", [])], "graph_id string, finding_id string, status string, hypothesis_ids array<string>")
    got = sorted(tuple(r) for r in assessment.action_links(actions, hypotheses, contexts).collect())
    both, one = ("h1", "h2", "h4", "h5", "h7", "h8"), ("h1", "h4", "h7", "named")
    assert got == sorted([("g", f"a{n}", h) for n in range(20) for h in both] + [("g", "twice", h) for h in one])
    sets = assessment._set_links(assessment._asked(actions), hypotheses, contexts)
    assert sets.count() == len(both) + len(one)
