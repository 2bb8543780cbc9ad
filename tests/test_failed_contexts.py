"""Contexts that could not be made are not taken for findings without candidates."""

import pytest
from pyspark.sql import functions as F

from triagelake.operators import assessment, composition
from triagelake.plans import composed as plans

_RULE = composition.correlation.Rule("r.use", "dependency_usage_path", "A component is used", ("CodeEntity",), ("Component",), ("uses",), ("review",), ("area",))


@pytest.fixture()
def parts(spark):
    """An entity that uses a component, which a finding affects; flows and hints are none."""
    node = "graph_id string, node_id string, kind string, stable_key string, label string, path string, line long, end_line long, symbol string, properties map<string,string>, evidence_ids array<string>, state string"
    rows = [("g", n, k, f"k-{n}", n, "a.ts", 1, 1, None, {}, ["v"], "checked") for n, k in (("f", "Finding"), ("e", "CodeEntity"), ("c", "Component"), ("x", "Resource"))]
    edges = [("g", f"e-{k}", k, a, b, "checked", ["v"]) for k, a, b in (("uses", "e", "c"), ("affects", "f", "c"), ("supported_by", "f", "x"), ("supported_by", "f", "c"))]
    edges = spark.createDataFrame([(*r[:1], f"{r[1]}-{r[4]}", *r[2:]) for r in edges], "graph_id string, edge_id string, kind string, from_id string, to_id string, state string, evidence_ids array<string>")
    flows = spark.createDataFrame([], "graph_id string, flow_id string, source_id string, sink_id string, edge_ids array<string>, control_ids array<string>, state string")
    components = spark.createDataFrame([], "graph_id string, component_id string, level string, path_edge_ids array<string>, finding_ids array<string>, state string")
    coverage = spark.createDataFrame([("g", "area", "checked")], "graph_id string, area string, state string")
    actions = spark.createDataFrame([], "graph_id string, action_id string, remediation_key string, score long, impact string, finding_ids array<string>")
    hints = spark.createDataFrame([], "graph_id string, hint_id string, hypothesis_id string, candidate_id string, fixtures array<string>, notes array<string>, gaps array<string>")
    return [spark.createDataFrame([("g", "F1", "f")], "graph_id string, finding_id string, node_id string"), spark.createDataFrame(rows, node), edges, flows, components, coverage, actions, hints]


@pytest.mark.parametrize("passes", [1, 2])
def test_a_failed_pass_is_named(spark, parts, monkeypatch, passes):
    out, reason = composition.composed(*parts, rules=(_RULE,))
    assert reason is None and out["hypotheses"].count() == 1
    made, calls = assessment.contexts, []

    def broken(*args, **more):
        calls.append(1)
        rows = made(*args, **more)
        return rows.withColumn("reason", F.expr("raise_error('lost executor')").cast("string")) if len(calls) == passes else rows

    monkeypatch.setattr(assessment, "contexts", broken)
    out, reason = composition.composed(*parts, rules=(_RULE,))
    assert reason and "context assessment failed" in reason
    assert out["hypotheses"].count() == passes - 1  # without contexts nothing is linked


def test_the_query_ends_with_it(spark, monkeypatch, tmp_path):
    spark.range(1).write.parquet(f"file://{tmp_path}/part.parquet")
    monkeypatch.setattr(plans, "_parts", lambda s, d: ())
    monkeypatch.setattr(composition, "composed", lambda *parts: ({"hypotheses": spark.range(0)}, "context assessment failed: lost executor"))
    with pytest.raises(RuntimeError, match="lost executor"):
        plans._composed(spark, f"file://{tmp_path}", "hypotheses")
