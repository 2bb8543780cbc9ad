"""Plans of steps whose cost once grew faster than their input."""

from triagelake.operators import dependencies, extractors
from triagelake.plans import graphs, reports


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_packages_of_reports_are_parsed_once_and_keys_merged_before_they_move(spark):
    raw = '{"Results": [{"Target": "../x", "Packages": [{"ID": "a@1", "Name": "a", "Version": "1", "DependsOn": ["b@2"]}, {"ID": "b@2", "Name": "b", "Version": "2"}]}]}'
    later = raw.replace('"2"}', '"3"}')
    rows = spark.createDataFrame([("r", 2, later), ("r", 1, raw), ("r", 3, None)], "repo_id string, report_id int, raw string")
    manifests = spark.createDataFrame([("r", "go.mod")], "repo_id string, path string")
    graph = dependencies.package_graph(rows, manifests)
    assert [tuple(r) for r in graph.collect()] == [("r", "go.mod", "a", "b", "2", None)]
    assert "parse_json" not in plan(graph) and "Window" not in plan(graph)


def test_reports_are_grouped_as_numbers(spark):
    made = reports._reports(spark, "/root/testdata/sf0.001")
    aggregates = [x for x in plan(made).splitlines() if "collect_list" in x]
    assert aggregates and all(x.count("collect_list(") <= 2 and "RULE-" not in x for x in aggregates)


def test_lines_of_contracts_are_sorted_once_and_without_their_texts(spark):
    texts = ["contract A {", "function f() {", 'b.call{value: 1}("");', "// says nothing", "balances[a] -= 1;", "}", "balances[b] -= 1;", "}"]
    lines = spark.createDataFrame([("a.sol", k, t) for k, t in enumerate(texts)] + [("b.sol", 0, None)], "path string, line_no int, line string")
    found = extractors.reentrant(lines)
    assert [tuple(r) for r in found.collect()] == [("a.sol", "A", "f", 2, 4)]
    assert [r["line_no"] for r in extractors.functions(lines).orderBy("line_no").collect()] == [1, 2, 3, 4, 5]
    sorts = [x for x in plan(found).split("Initial Plan")[-1].splitlines() if " Sort [" in x or "+- Sort [" in x]
    assert len(sorts) == 1


def test_lines_are_searched_once_for_nodes_and_edges_of_the_merged_graph(spark, monkeypatch):
    kept = graphs.once
    monkeypatch.setattr(graphs, "once", lambda s, name, d, build: build() if name.startswith("merged-") else kept(s, name, d, build))
    for part in graphs._merged_graph(spark, "/root/testdata/sf0.001"):
        assert "matcher" not in plan(part)
