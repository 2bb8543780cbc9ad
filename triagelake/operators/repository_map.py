"""A repository's map as ordered entries: nodes in seven sections, relationships, flows, coverage and fact gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.sources import corpus

from .assessment import fact_gaps, map_groups

COLUMNS = ("graph_id", "section", "entry_id", "kind", "path", "label", "from_id", "from_label", "to_id", "to_label", "evidence_ids", "state", "covered_count", "total_count", "note", "at")


def _entries(rows: DataFrame, order: tuple[str | Column, ...], **values: Column) -> DataFrame:
    """rows as entries, ordered by five texts; what an entry of this kind does not have is null."""
    text, number = F.lit(None).cast("string"), F.lit(None).cast("long")
    blank = {c: number if c in ("covered_count", "total_count") else F.lit(None).cast("array<string>") if c == "evidence_ids" else text for c in COLUMNS}
    keys = [F.coalesce(F.col(k) if isinstance(k, str) else k, F.lit("")) for k in (*order, *[F.lit("")] * (5 - len(order)))]
    at = F.struct(*(k.alias(f"k{n}") for n, k in enumerate(keys)))
    return rows.select(*((blank | values | {"graph_id": F.col("graph_id"), "at": at})[c].alias(c) for c in COLUMNS))


def _named(rows: DataFrame, nodes: DataFrame, start: str, end: str) -> DataFrame:
    """rows with the labels of both ends; the id where the graph has no such node."""
    label = nodes.select("graph_id", "node_id", "label")
    for column, name in ((start, "from_label"), (end, "to_label")):
        rows = rows.join(label.select("graph_id", F.col("node_id").alias(column), F.col("label").alias(name)), ["graph_id", column], "left").withColumn(name, F.coalesce(name, column))
    return rows


def entries(nodes: DataFrame, edges: DataFrame, flows: DataFrame, coverage: DataFrame) -> DataFrame:
    """Entries of every graph's map with their place (nth) in the section.

    Nodes come by path, label, kind and id, relationships by kind, ends and id, flows by id and, where an id is repeated, by ends, state and edges, coverage by area and
    producer, fact gaps by source, area, label and id; a null path comes first, evidence is sorted. Sections are
    numbered over range partitions, so a section of any size spans tasks. Nodes of other kinds have no section.
    """
    col, evidence = F.col, F.array_sort("evidence_ids")
    section = lambda name: F.lit(name)
    of_nodes = _entries(map_groups(nodes), ("path", "label", "kind", "node_id"), section=col("section"), entry_id=col("node_id"), kind=col("kind"), path=col("path"), label=col("label"), evidence_ids=evidence, state=col("state"))
    of_edges = _entries(_named(edges, nodes, "from_id", "to_id"), ("kind", "from_id", "to_id", "edge_id"), section=section("relationships"), entry_id=col("edge_id"), kind=col("kind"), from_id=col("from_id"), from_label=col("from_label"), to_id=col("to_id"), to_label=col("to_label"), evidence_ids=evidence, state=col("state"))
    of_flows = _entries(_named(flows, nodes, "source_id", "sink_id"), ("flow_id", "source_id", "sink_id", "state", F.array_join("edge_ids", ">")), section=section("flows"), entry_id=col("flow_id"), from_id=col("source_id"), from_label=col("from_label"), to_id=col("sink_id"), to_label=col("to_label"), note=F.array_join("edge_ids", ">"), state=col("state"))
    of_areas = _entries(coverage, ("area", "producer", "state", "reason"), section=section("coverage"), entry_id=F.concat_ws(":", "area", "producer"), kind=col("producer"), label=col("area"), state=col("state"), covered_count=col("covered").cast("long"), total_count=col("total").cast("long"), note=col("reason"))
    area = F.when(col("source") == "coverage", col("label"))
    of_gaps = _entries(fact_gaps(nodes, edges, flows, coverage), ("source", area, "label", "gap_id", "description"), section=section("factGaps"), entry_id=col("gap_id"), kind=col("source"), label=col("label"), state=col("state"), note=col("description"))
    rows = of_nodes.unionByName(of_edges).unionByName(of_flows).unionByName(of_areas).unionByName(of_gaps)
    return corpus.numbered(rows.withColumn("of", F.struct("graph_id", "section")), "of", "at")
