"""Repositories of expectations by URL and by the end of a local path."""

from pyspark.sql import functions as F

from triagelake.operators import truth


def test_matches(spark):
    assessments = [("a", "https://h/x.git", "/w/one/app"), ("b", "https://h/x/", None), ("c", None, "/w/two/app"), ("d", "https://h/x.git.git", "p"), ("e", None, None), ("a", "https://h/x.git", "/w/one/app")]
    expectations = [("u", "https://h/x", None), ("v", None, "/app"), ("w", None, "one/app"), ("z", None, ""), ("n", None, None), ("l", None, "/a/longer/suffix/than/any/path")]
    got = truth.matched_repositories(spark.createDataFrame(assessments, "repo_id string, origin string, local_path string"), spark.createDataFrame(expectations, "expectation_id string, origin_url string, local_suffix string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted([("a", "u"), ("b", "u"), ("a", "v"), ("c", "v"), ("a", "w"), ("a", "z"), ("c", "z"), ("d", "z")])
    assert truth.matched_repositories(got.selectExpr("repo_id", "repo_id AS origin", "repo_id AS local_path").limit(0), spark.createDataFrame(expectations, "expectation_id string, origin_url string, local_suffix string")).count() == 0


def test_pairs_are_made_once_and_in_several_tasks(spark):
    assessments = [(f"r{k}" if k else None, f"https://h/{k}", "/w/app") for k in range(60)] + [("r1", None, "/v/app")]
    expectations = [("both", "https://h/1.git", "/app"), ("both", None, "app"), (None, None, "/app"), (None, "https://h/2", None)] + [(f"e{k}", None, "/app") for k in range(40)]
    rows = truth.matched_repositories(spark.createDataFrame(assessments, "repo_id string, origin string, local_path string"), spark.createDataFrame(expectations, "expectation_id string, origin_url string, local_suffix string"))
    got = rows.select("repo_id", "expectation_id", F.spark_partition_id().alias("task")).collect()
    assert len(got) == len({(r["repo_id"], r["expectation_id"]) for r in got}) == 60 * 42
    assert len({r["task"] for r in got if str(r["expectation_id"]).startswith("e")}) > 1, "one task makes all pairs of a suffix"
