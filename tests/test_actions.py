"""Actions, and places of their findings, by hand; lists are gathered no more often than they are needed."""

from pyspark.sql import functions as F

from triagelake.operators import quick
from triagelake.plans import reports

FOUND = "repo_id string, remediation_key string, finding_id string, fingerprint string, evidence_id string, rule_id string, category string, severity string, path string, line long, at struct<stage_ord:int,ord:string>"
ROWS = [
    ("r", "iac-hardening", "f3", "p1", "e3", "R2", "iac", "high", "b", 1, (2, "z")),
    ("r", "iac-hardening", "f1", "p3", "e1", "R1", "iac", "low", "a", 9, (1, "y")),
    ("r", "iac-hardening", "f2", "p2", "e2", "R2", "iac", "low", "b", 1, (1, "x")),
    ("q", "iac-hardening", "f1", "p3", "e1", "R1", "iac", "low", "a", 9, (1, "y")),
]


def _lists(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("collect_list(")


def test_actions_and_locations(spark):
    found = spark.createDataFrame(ROWS, FOUND)
    actions = quick.actions(found)
    got = {r["repo_id"]: (r["finding_ids"], r["evidence_ids"], r["files"], r["rules"], r["place"], r["severity"], r["rank"]) for r in actions.collect()}
    assert got == {"r": (["f2", "f1", "f3"], ["e2", "e1", "e3"], ["b", "a"], ["R2", "R1"], "b:1", "high", 1), "q": (["f1"], ["e1"], ["a"], ["R1"], "a:9", "low", 1)}
    places = quick.locations(actions, found)
    assert sorted((r["repo_id"], r["nth"], r["place"]) for r in places.collect()) == [("q", 1, "a:9"), ("r", 1, "b:1"), ("r", 2, "a:9")]
    assert _lists(places) == 1 and _lists(actions.drop("action_id", "rank")) == 1


def test_records_of_a_tool_are_picked_before_they_are_gathered(spark):
    rows = reports._records(spark, "/root/testdata/sf0.001", "github-actions.zizmor")
    whole = reports.rp.records(reports._reports(spark, "/root/testdata/sf0.001").where(F.col("check") == "github-actions.zizmor"))
    assert rows.count() == whole.count() > 0
    assert _lists(rows) == 1
