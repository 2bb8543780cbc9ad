"""Clusters of findings as rows make the graph that their lists make."""

from pyspark.sql import functions as F

from triagelake.operators import property_graph as pg
from triagelake.plans import graphs

DATA = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_clusters_as_rows(spark):
    found, rows = graphs._findings(spark, DATA), graphs._clusters(spark, DATA)
    lists = rows.groupBy("graph_id", "cluster_id", "category").agg(F.collect_set("finding_id").alias("finding_ids"))
    one, other = pg.finding_graph(found, rows), pg.finding_graph(found, lists)
    for a, b in zip(one, other, strict=True):
        shown = [set(x.select("graph_id", "stable_key", "kind").collect()) for x in (a, b)]
        assert shown[0] == shown[1] and len(shown[0]) > 0
    assert "collect_" not in _plan(one[0]) + _plan(one[1])
