"""Places in groups that span files, with one shuffle of the rows."""

import random

from pyspark.sql import functions as F

from triagelake.operators import repository_map
from triagelake.sources import corpus


def test_groups_that_span_files_are_numbered(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a table this small would be one file
    rows = [(g, f"k{n:05d}", f"t{g}{n}") for g, size in (("a", 3000), ("b", 1), ("c", 40), (None, 700)) for n in range(size)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "graph_id string, k string, text string").repartition(5)
    got = corpus.numbered(frame.select("graph_id", "text", F.struct("graph_id").alias("of"), F.struct("k").alias("at")), "of", "at")
    assert got.columns == ["graph_id", "text", "nth"]
    assert {tuple(r) for r in got.collect()} == {(g, t, int(k[1:]) + 1) for g, k, t in rows} and got.count() == len(rows)
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_nothing_is_numbered(spark):
    assert corpus.numbered(spark.createDataFrame([], "of string, at string, x int"), "of", "at").collect() == []


def test_entries_are_not_shuffled_once_more_to_be_numbered(spark):
    nodes = spark.createDataFrame([("g", f"n{k}", "Sink", "l", None, "checked", []) for k in range(5)], "graph_id string, node_id string, kind string, label string, path string, state string, evidence_ids array<string>")
    edges = spark.createDataFrame([], "graph_id string, edge_id string, kind string, from_id string, to_id string, state string, evidence_ids array<string>")
    flows = spark.createDataFrame([], "graph_id string, flow_id string, source_id string, sink_id string, edge_ids array<string>, state string")
    coverage = spark.createDataFrame([], "graph_id string, area string, producer string, state string, covered long, total long, reason string")
    got = repository_map.entries(nodes, edges, flows, coverage)
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["entry_id"], r["nth"]) for r in got.where("section = 'securityFacts'").collect()) == [(f"n{k}", k + 1) for k in range(5)]
