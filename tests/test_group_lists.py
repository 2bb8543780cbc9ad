"""Lists of hypotheses meet actions last: none is shuffled for each action."""

import pytest
from pyspark.sql import functions as F

from triagelake.operators import assessment


@pytest.fixture()
def tables(spark):
    actions = spark.range(60).selectExpr("'g' AS graph_id", "'a' || id AS action_id", "'k' AS remediation_key", "id AS score", "'degrades' AS impact", "array('f' || (id % 3)) AS finding_ids")
    hypotheses = spark.range(30).selectExpr("'g' AS graph_id", "'h' || id AS hypothesis_id", "'fam' AS family", "'candidate' AS status", "0.5D AS confidence", "array('f' || (id % 2)) AS finding_ids")
    contexts = spark.createDataFrame([], "graph_id string, finding_id string, status string, hypothesis_ids array<string>")
    return actions, hypotheses, contexts


def _top_join(frame):
    """Lines of the plan down to its first join."""
    lines = frame._jdf.queryExecution().executedPlan().toString().splitlines()
    return lines[: next(k for k, line in enumerate(lines) if "Join" in line) + 1]


@pytest.fixture(autouse=True)
def shuffled(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_groups_join_their_lists_last(tables):
    groups = assessment.action_groups(*tables)
    top = _top_join(groups)
    assert "asked" in top[-1] and not any("Exchange" in line for line in top)
    rows = {r["action_ids"][0]: r for r in groups.where("lead = 'direct_finding'").collect()}
    of = lambda n: sorted(f"h{k}" for k in range(n, 30, 2))
    assert len(rows) == 60 and all(r["hypothesis_ids"] == (of(int(a[1:]) % 3) if int(a[1:]) % 3 < 2 else []) for a, r in rows.items())
    assert rows["a0"]["reason"].endswith(f": {', '.join(of(0))}.") and rows["a2"]["reason"].endswith("has no linked static hypotheses.")


def test_links_are_taken_apart_last(tables):
    links = assessment.action_links(*tables)
    top = _top_join(links)
    assert any("Generate explode" in line for line in top) and not any("Exchange" in line for line in top)
    assert links.count() == 40 * 15 and links.agg(F.count_distinct("action_id", "hypothesis_id")).first()[0] == 600
