"""Tables of versions: replacing by nothing, dying before the commit, writers at once; shared tables follow their sources."""

import pytest

from triagelake.sources import shared, tables


@pytest.fixture
def at(tmp_path):
    return f"file://{tmp_path}/t"


def graph(spark, *rows):
    return spark.createDataFrame(list(rows), "graph_id string, node_id string")


def seen(spark, at, name, *graphs):
    return sorted(tuple(r) for r in tables.graph_table(spark, at, name, *graphs).collect())


def test_a_graph_replaced_by_nothing_is_gone(spark, at):
    tables.replace_graphs({"nodes": graph(spark, ("a", "1"), ("b", "2")), "edges": graph(spark, ("a", "e1"), ("b", "e2"))}, at)
    tables.replace_graphs({"nodes": graph(spark, ("a", "3")), "edges": graph(spark)}, at)
    assert seen(spark, at, "nodes") == [("a", "3"), ("b", "2")] and seen(spark, at, "edges") == [("b", "e2")] and seen(spark, at, "edges", "a") == []
    tables.replace_graphs({"nodes": graph(spark), "edges": graph(spark)}, at, spark.createDataFrame([("b",)], "g string"))
    assert seen(spark, at, "nodes") == [("a", "3")] and seen(spark, at, "edges") == []


def test_a_writer_that_dies_between_tables_changes_nothing(spark, at):
    tables.replace_graphs({"nodes": graph(spark, ("a", "1")), "edges": graph(spark, ("a", "e1"))}, at)
    broken = graph(spark, ("a", "x")).selectExpr("graph_id", "raise_error('lost') AS node_id")
    with pytest.raises(Exception, match="lost"):
        tables.replace_graphs({"nodes": graph(spark, ("a", "2")), "edges": broken}, at)
    assert seen(spark, at, "nodes") == [("a", "1")] and seen(spark, at, "edges") == [("a", "e1")]


def test_history_keeps_the_first_of_writers_at_once(spark, at, monkeypatch):
    rows = spark.createDataFrame([("r", "s", 1, "done")], "run_id string, stage string, attempt int, status string")
    tables.append_history(rows, at)
    seen_ = tables.history
    monkeypatch.setattr(tables, "history", lambda s, p, schema, key=("run_id", "stage", "attempt"): seen_(s, p, schema, key).where("false"))  # a writer that has not seen the first
    tables.append_history(rows.selectExpr("run_id", "stage", "attempt", "'late' AS status").unionByName(rows.selectExpr("run_id", "stage", "attempt + 1 AS attempt", "status")), at)
    monkeypatch.undo()
    assert sorted(tuple(r) for r in tables.history(spark, at, rows.schema).collect()) == [("r", "s", 1, "done"), ("r", "s", 2, "done")]


def test_artifacts_once(spark, at):
    rows = spark.createDataFrame([(b"x",), (b"x",), (b"",), (None,)], "content binary")
    tables.store_artifacts(rows, at)
    assert tables.store_artifacts(rows, at).count() == 2 and spark.read.parquet(at).count() == 2
    spark.read.parquet(at).write.mode("append").partitionBy("prefix").parquet(f"{at}2")
    spark.read.parquet(at).write.mode("append").partitionBy("prefix").parquet(f"{at}2")
    assert tables.artifacts(spark, f"{at}2").count() == 2


def test_assessments_of_other_runs_stay(spark, at):
    rows = spark.createDataFrame([(f"r{k}", "ready") for k in range(40)], "repo_id string, verdict string")
    tables.write_assessments(rows, at, "one")
    tables.write_assessments(rows.limit(5), at, "two")
    tables.write_assessments(rows.limit(7), at, "two")
    counts = {run: tables.read_assessments(spark, at, "repo_id string, verdict string", run).count() for run in ("one", "two", "three")}
    assert counts["one"] == 40 and counts["two"] >= 7 and counts["three"] == 0


def test_shared_tables_follow_their_sources(spark, tmp_path):
    folder = f"{tmp_path}/sf"
    build = lambda: spark.read.parquet(f"{folder}/documents.parquet").selectExpr("id * 2 AS twice")
    spark.range(18).write.parquet(f"{folder}/documents.parquet")
    assert shared.once(spark, "t", folder, build).count() == shared.once(spark, "t", folder, build).count() == 18
    spark.range(20).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert shared.once(spark, "t", folder, build).count() == 20
    spark.range(3).write.mode("append").parquet(f"{folder}/documents.parquet")
    assert shared.once(spark, "t", folder, build).count() == 23
