"""Both outcomes of the two-pass composition, whole-graph checks with planted faults, and the order of files."""

import pytest
from pyspark.sql import functions as F

from triagelake.operators import composition, integrity
from triagelake.plans import composed as plans
from triagelake.sources import tables
from triagelake.sources.shared import written

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark):
    """One repository of the merged graph, with all that the composition reads of it."""
    return [written(p.where("graph_id = 'repo1'"), "part") for p in plans._parts(spark, DATA)]


def test_the_second_pass_reads_the_first(spark, parts):
    out, reason = composition.composed(*parts)
    assert reason is None
    first = {(r["graph_id"], r["finding_id"]): r["status"] for r in composition._contexts(*parts[:5], spark.createDataFrame([], composition.LINKS)).collect()}
    second = {(r["graph_id"], r["finding_id"]): r for r in out["contexts"].collect()}
    assert set(first) == set(second) and "linked_to_hypothesis" not in first.values()
    hypotheses = {r["hypothesis_id"]: r for r in out["hypotheses"].collect()}
    linked = {k for k, r in second.items() if r["status"] == "linked_to_hypothesis"}
    named = {(h["graph_id"], f) for h in hypotheses.values() if h["status"] != "statically_contradicted" for f in h["finding_ids"]}
    contradicted = {k for k, r in second.items() if r["status"] == "contradicted"}
    assert linked and linked == named - contradicted
    assert all(set(second[k]["hypothesis_ids"]) <= set(hypotheses) for k in linked)
    candidates = {r["candidate_id"] for r in out["candidates"].collect()}
    assert {h["candidate_id"] for h in hypotheses.values()} == candidates
    assert {r["hypothesis_id"] for r in out["recipes"].collect()} == {i for i, h in hypotheses.items() if h["status"] != "statically_contradicted"}
    in_groups = {h for r in out["groups"].collect() for h in r["hypothesis_ids"]}
    assert in_groups == {i for i, h in hypotheses.items() if h["status"] != "statically_contradicted"}


def all_gone(parts, out, reason, part):
    assert part in reason and out["candidates"].count() == out["hypotheses"].count() == out["recipes"].count() == 0
    contexts = out["contexts"].collect()
    assert {r["status"] for r in contexts} == {"standalone"} and {r["state"] for r in contexts} == {"failed"} and len(contexts) == parts[0].select("graph_id", "finding_id").distinct().count()
    groups = out["groups"].collect()
    assert {r["lead"] for r in groups} == {"direct_finding"} and len(groups) == parts[6].count() and not any(r["hypothesis_ids"] for r in groups)


def test_a_task_that_fails_takes_all_of_it(parts):
    findings, nodes, edges, *rest = parts
    broken = nodes.withColumn("label", F.expr("CASE WHEN kind = 'Sink' THEN raise_error('lost node') ELSE label END"))
    all_gone(parts, *composition.composed(findings, broken, edges, *rest), "failed")


def test_groups_that_do_not_hold_together_take_all_of_it(parts):
    *rest, actions, hints = parts
    out, reason = composition.composed(*rest, actions.withColumn("score", F.lit(-1).cast("long")), hints)
    all_gone(parts, out, reason, "negative score")


def test_nothing(parts):
    out, reason = composition.composed(*(p.limit(0) for p in parts))
    assert reason is None and all(f.count() == 0 for f in out.values())


def test_planted_flows(spark):
    edges = spark.createDataFrame([("g", "e1", "a", "b"), ("g", "e2", "b", "c"), ("g", "e3", "c", "d"), ("h", "e9", "a", "b"), ("g", "e2", "b", "c")], "graph_id string, edge_id string, from_id string, to_id string")
    flows = [("ok", "a", "d", ["e1", "e2", "e3"]), ("empty", "a", "z", []), ("gone", "a", "d", ["e1", "e9", "e3"]), ("gap", "a", "d", ["e1", "e3"]), ("start", "b", "d", ["e1", "e2", "e3"]), ("end", "a", "c", ["e1", "e2", "e3"]), ("both", "x", "y", ["e1", "nope"]), ("ok", "a", "d", ["e1", "e2", "e3"]), ("null", None, "b", ["e1"])]
    rows = integrity.broken_flows(spark.createDataFrame([("g", *f) for f in flows], "graph_id string, flow_id string, source_id string, sink_id string, edge_ids array<string>"), edges)
    assert {r["flow_id"]: (r["check_id"], r["place"]) for r in rows.collect()} == {"gone": ("dangling", 1), "gap": ("not_connected", 1), "start": ("not_connected", 0), "end": ("wrong_end", 3), "both": ("not_connected", 0), "null": ("not_connected", 0)}


def test_graph_records_and_rules(spark):
    node = "graph_id string, node_id string, kind string, stable_key string, producer string, confidence double, state string, path string, line long, end_line long, evidence_ids array<string>"
    nodes = [("g", "n1", "Sink", "k1", "p", 0.5, "checked", "a.ts", 1, 2, ["v1"]), ("g", "n2", "Odd", "k1", "", 1.5, "new", "../b", 0, -1, ["v9"]), ("g", "n3", "Source", "k3", "p", None, "checked", "gone.ts", 3, None, []), ("g", "n3", "Source", "k4", "p", 1.0, "checked", None, None, None, [])]
    edges = [("g", "e1", "calls", "s1", "p", 1.0, "checked", "n1", "nope", []), ("g", "e2", "likes", " ", "p", float("nan"), "checked", "n1", "n2", [])]
    flows = [("g", "w1", "n1", "n3", ["c9"], 0.0, "checked", ["v1"])]
    coverage = [("g", "entities", "p", "checked", 3, 2), ("g", "moods", "p", "checked", None, None), ("g", "entities", "p", "odd", -1, 1)]
    made = [spark.createDataFrame(r, t) for r, t in ((nodes, node), (edges, "graph_id string, edge_id string, kind string, stable_key string, producer string, confidence double, state string, from_id string, to_id string, evidence_ids array<string>"), (flows, "graph_id string, flow_id string, source_id string, sink_id string, control_ids array<string>, confidence double, state string, evidence_ids array<string>"), (coverage, "graph_id string, area string, producer string, state string, covered long, total long"), ([("g", "a.ts")], "graph_id string, path string"), ([("g", "v1")], "graph_id string, evidence_id string"))]
    got = {(r["check_id"], r["record_id"]) for r in integrity.graph_records(*made).collect()}
    assert got == {
        ("unknown_kind", "n2"), ("blank_producer", "n2"), ("confidence", "n2"), ("unknown_state", "n2"), ("unsafe_path", "n2"), ("line", "n2"), ("line_range", "n2"), ("unknown_evidence", "n2"), ("confidence", "n3"), ("outside", "n3"), ("duplicate", "n3"), ("duplicate", "k1"), ("unknown_node", "e1"), ("unknown_kind", "e2"), ("blank_key", "e2"),
        ("confidence", "e2"), ("unknown_node", "w1"), ("excess", "entities:p"), ("unknown_area", "moods:p"), ("unknown_state", "entities:p"), ("negative", "entities:p"), ("duplicate", "entities:p"),
    }
    schema = "rule_id string, family string, title string, source_kinds array<string>, target_kinds array<string>, allowed array<string>, required array<string>, max_length int, validation array<string>, source_other boolean, target_other boolean"
    rules = [("ok", "f", "t", ["A"], None, ["calls"], ["calls"], 6, ["v"], None, True), ("bad", "", "t", [], None, ["calls"], ["reads"], 0, [], None, False), ("worse", "f", " ", [""], ["B"], None, None, None, None, True, None)]
    assert {(r["check_id"], r["record_id"]) for r in integrity.rules(spark.createDataFrame(rules, schema)).collect()} == {("blank_family", "bad"), ("source_selector", "bad"), ("target_selector", "bad"), ("required", "bad"), ("length", "bad"), ("no_validation", "bad"), ("blank_title", "worse"), ("source_selector", "worse"), ("no_edges", "worse"), ("length", "worse"), ("no_validation", "worse")}


def test_files_hold_one_order(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a table this small would be one file
    rows = spark.range(5000).selectExpr("'g' || (id % 3) AS graph_id", "CAST(id * 7919 % 97 AS BIGINT) AS score", "CASE WHEN id % 2 = 0 THEN 'direct_finding' ELSE 'hypothesis' END AS lead", "'k' || (id % 5) AS remediation_key", "'x' || id AS group_id").repartition(7)
    tables.write_ordered(rows, f"file://{tmp_path}/o", *tables.group_order())
    files = sorted((tmp_path / "o").glob("part-*.parquet"))
    read = [tuple(r) for f in files for r in spark.read.parquet(f"file://{f}").collect()]
    assert len(files) > 1 and read == sorted(map(tuple, rows.collect()), key=lambda r: (r[0], -r[1], r[2] != "direct_finding", r[3], r[4]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    area = spark.createDataFrame([("g", "b", "x"), ("g", "a", "z"), ("g", "a", "b")], "graph_id string, area string, producer string")
    tables.write_ordered(area, f"file://{tmp_path}/c", *tables.graph_order("coverage"))
    assert [tuple(r)[1:] for f in sorted((tmp_path / "c").glob("part-*.parquet")) for r in spark.read.parquet(f"file://{f}").collect()] == [("a", "b"), ("a", "z"), ("b", "x")]
