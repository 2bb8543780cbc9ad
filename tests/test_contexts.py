"""Contexts of findings: what decides, and rows of line items as numbers."""

from pyspark.sql import functions as F

from triagelake.operators import assessment as az
from triagelake.plans import assessments


def test_each_kind_decides_in_order(spark):
    findings = spark.createDataFrame([("g", f"f{k}", f"f{k}") for k in range(1, 8)] + [(None, "f1", "f1")], "graph_id string, finding_id string, node_id string")
    edges = [("a1", "affects", "f1", "p1"), ("a2", "affects", "f2", "p2"), ("a3", "affects", "f3", "p3"), ("a6", "affects", "f6", "p6"), ("c1", "contradicted_by", "p1", "q"), ("s2", "supported_by", "f2", "q"), ("s5", "supported_by", "f5", "f1"), ("w3", "calls", "p3", "t"), ("w4", "calls", "t", "p2"), ("h6", "protected_by", "z", "p6"), ("h3", "protected_by", "p3", "z")]
    edges = spark.createDataFrame([("g", *e, "partial" if e[0] == "w4" else "checked") for e in edges], "graph_id string, edge_id string, kind string, from_id string, to_id string, state string")
    nodes = spark.createDataFrame([("g", "q", "Sink"), ("g", "f1", "Finding")], "graph_id string, node_id string, kind string")
    # two rows of one flow: both count
    flows = spark.createDataFrame([("g", "w", "p3", "x", ["w3"], ["c"], "checked"), ("g", "w", "p3", "y", ["w4", "gone"], [], "partial"), ("g", "v", "p6", "y", [], [], "partial")], "graph_id string, flow_id string, source_id string, sink_id string, edge_ids array<string>, control_ids array<string>, state string")
    components = spark.createDataFrame([("g", "k", "present", [], ["f7", "f9"], "checked"), ("g", "l", "present", [], ["f4"], "partial")], "graph_id string, component_id string, level string, path_edge_ids array<string>, finding_ids array<string>, state string")
    links = spark.createDataFrame([("g", "f1", "h", ["n"], []), ("g", "f2", "h2", ["n"], []), ("g", "f9", "h", ["n"], []), ("g", "f2", "h1", ["m"], ["e"])], "graph_id string, finding_id string, hypothesis_id string, node_ids array<string>, edge_ids array<string>")
    got = az.contexts(findings, nodes, edges, flows, components, links).select("graph_id", "finding_id", "status", *(F.array_join(c, ",") for c in ("node_ids", "edge_ids", "hypothesis_ids")), "state")
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([
        ("g", "f1", "contradicted", "p1,q", "c1", "", "checked"), ("g", "f2", "linked_to_hypothesis", "m,n", "e", "h1,h2", "checked"), ("g", "f3", "corroborated", "c,p3,x,y", "w3,w4", "", "partial"),
        ("g", "f4", "standalone", "", "", "", "checked"), ("g", "f5", "standalone", "", "", "", "checked"), ("g", "f6", "weakened", "p6,z", "h6", "", "checked"), ("g", "f7", "weakened", "k", "", "", "checked"), (None, "f1", "standalone", "", "", "", "checked"),
    ], key=str)


def test_rows_are_distinct_before_they_are_texts(spark, tmp_path):
    rows = [(o, n, p, s, "N") for o in (1, 2, None) for n in (1, 2, 3, 4, None) for p in (3, 9, 11, None) for s in (1, 4, 8, 9, None)] * 2
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("edges", "flows", "components", "links", "findings"):
        source, where, columns = assessments._tables("spark")[name]
        plain = spark.read.parquet(f"{tmp_path}/{source}.parquet").where(where).selectExpr(*(f"{e} AS {c}" for c, e in columns.items())).distinct()
        made = assessments.table(spark, str(tmp_path), name)
        assert made.columns == plain.columns and made.count() == plain.count() and made.exceptAll(plain).isEmpty(), name
        plan = spark._jvm.PythonSQLUtils.explainString(made._jdf.queryExecution(), "simple")
        assert any("hashpartitioning(l_orderkey" in line for line in plan.splitlines()), name


def test_nodes_are_the_ends_of_lines_shuffled_once(spark, tmp_path):
    rows = [(o, n, p, s, "N") for o in (1, 2) for n in (1, 2, 3) for p in (3, 9, 11) for s in (1, 8)] * 2
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    ends = {(r["graph_id"], x) for r in assessments.table(spark, str(tmp_path), "edges").collect() for x in (r["from_id"], r["to_id"])}
    made = assessments.nodes(spark, str(tmp_path))
    assert sorted((r["graph_id"], r["node_id"]) for r in made.collect()) == sorted(ends)
    assert sorted((r["graph_id"], r["node_id"]) for r in assessments.nodes(spark, str(tmp_path), only="node_id LIKE 'p%'").collect()) == sorted(x for x in ends if x[1].startswith("p"))
    plan = spark._jvm.PythonSQLUtils.explainString(assessments.nodes(spark, str(tmp_path))._jdf.queryExecution(), "simple")
    assert plan.count("Exchange hashpartitioning") == 1, "edges are made distinct before their ends are"
