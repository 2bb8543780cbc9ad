"""Every registered query with SQL gives the rows of that SQL."""

import duckdb
import pandas as pd
import pytest

from triagelake.functions import findings as fn
from triagelake.operators import graph
from triagelake.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    return repr(None if v is pd.NA else v.tolist() if hasattr(v, "tolist") else v)


def rows(frame):
    columns = sorted(frame.columns)
    return sorted(tuple(shown(v) for v in r) for r in frame[columns].itertuples(index=False, name=None))


def sql(text, data=DATA):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return db.execute(text).df()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert rows(registry.QUERIES[name](spark, DATA).toPandas()) == rows(sql(registry.ORACLE_SQL[name]))


def test_exclusions_fill_greedily(spark, monkeypatch):
    from triagelake.sources import corpus

    monkeypatch.setattr(corpus, "MAX_REPO", 10)
    files = spark.createDataFrame([("r", "a", 6), ("r", "b", 6), ("r", "c", 4), ("r", "vendor/x", 1), ("s", "big", 99_999)], "repo_id string, path string, size long")
    assert {tuple(r) for r in corpus.exclusions(files).collect()} == {("r", "b", "truncated"), ("r", "vendor/x", "ignored_directory"), ("s", "big", "too_large")}


def test_flows_are_simple_and_stop_at_sinks(spark):
    edges = spark.createDataFrame([("s1", "x"), ("x", "y"), ("y", "x"), ("y", "t1"), ("t1", "t2"), ("x", "x")], "a string, b string")
    assert {r["path"] for r in graph.flows(edges, "s", "t").collect()} == {"s1>x>y>t1"}
    assert {(r["node"], r["distance"]) for r in graph.distances(edges, "s", "t").collect()} == {("s1", 0), ("x", 1), ("y", 2), ("t1", 3), ("t2", 4)}


def test_safe_paths(spark):
    paths = spark.createDataFrame([("a/b",), ("",), ("/a",), ("a//b",), ("a/../b",), (None,)], "p string")
    assert [r[0] for r in paths.select(fn.safe_relative(paths["p"])).collect()] == [True, False, False, False, False, False]


def test_reports_of_all_shapes(spark):
    from triagelake.sources import scanners

    sarif = '{"runs": [{"results": [{"ruleId": "x", "level": "error", "message": {"text": "m"}, "locations": []}]}]}'
    secrets = '[{"RuleID": "k", "File": "f", "StartLine": 3, "Secret": "s1", "Match": "a=s1"}, {"RuleID": "k", "File": "f", "Secret": "", "Match": "b"}]'
    raw = [sarif, "Here:\n```json\n" + secrets + "\n```", "{broken", '{"other": 1}', None, "[]"]
    reports = spark.createDataFrame([(str(k), r) for k, r in enumerate(raw)], "repo_id string, raw string")
    got = {tuple(r) for r in scanners.records(reports).collect()}
    assert got == {("0", "sarif", "x", "error", None, None, "m"), ("1", "secrets", "k", "high", "f", 3, "a=[REDACTED]"), ("1", "secrets", "k", "high", "f", None, "[REDACTED]"), ("2", "failed", None, None, None, None, None)}


def test_coverage_keeps_worst_state_last_counts_and_reasons_in_order(spark):
    from triagelake.operators import coverage

    rows_ = [("a", "p", 1, "partial", 1, 2, "z"), ("a", "p", 2, "checked", None, None, "b"), ("a", "p", 3, "checked", 5, 9, "z"), ("b", "p", 1, "checked", None, None, None)]
    merged = coverage.merged(spark.createDataFrame(rows_, "area string, producer string, ord long, state string, covered long, total long, reason string"))
    assert {tuple(r) for r in merged.collect()} == {("a", "p", "partial", 5, 9, "z; b"), ("b", "p", "checked", None, None, "")}


def test_scores_without_a_denominator_are_null(spark):
    from triagelake.operators import scoring

    counts = scoring.measured(scoring.rolled_up(spark.createDataFrame([("py", "sql", True, True), ("py", None, False, True), ("go", "xss", False, False)], "language string, family string, truth boolean, found boolean")))
    got = {r["key"]: (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"]) for r in counts.collect()}
    assert got == {"all": (1, 1, 0, 0.5, 1.0), "language:py": (1, 1, 0, 0.5, 1.0), "language:go": (0, 0, 0, None, None), "family:sql": (1, 0, 0, 1.0, 1.0), "family:none": (0, 1, 0, 0.0, None), "family:xss": (0, 0, 0, None, None)}
    assert {r["key"] for r in scoring.gates(counts).where("NOT passed").collect()} == {"all", "language:py", "family:none"}
