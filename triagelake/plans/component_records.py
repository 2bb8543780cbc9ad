"""Registered queries of whole component records: parts are components and code, line items use them, need them and find faults in them.

Every line item is an observation: of odd line numbers a usage, of even ones a dependency. Two parts share a package, so
matches grow with the tables.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from triagelake.operators import property_graph as pg
from triagelake.operators import reachability as rc
from triagelake.sources.shared import once, written

from .graphs import _nid

_L, _P = "(l_partkey - l_partkey % 2)", "(p_partkey - p_partkey % 2)"
_ID = "l_orderkey || '-' || l_linenumber"
_SEEN = {"graph_id": f"'repo' || ({_L} % 97)", "ord": "(l_orderkey * 10 + l_linenumber) * 1000000000 + l_suppkey", "version": "CASE l_orderkey % 5 WHEN 0 THEN '2.' || (l_suppkey % 10) WHEN 1 THEN '' END"}
CODE = {"graph_id": f"'repo' || ({_P} % 97)", "path": "'src/' || (p_partkey % 7)", "line": "1 + p_partkey % 50", "sym": "CASE p_partkey % 5 WHEN 0 THEN 'program' ELSE 'fn' || p_partkey END", "k": "'Code:' || p_partkey", "caller": "CASE WHEN p_partkey % 2 = 1 AND p_partkey > 1 THEN 'Code:' || (p_partkey - 1) END", "entry": "p_partkey % 6 = 0"}
PART = {"graph_id": CODE["graph_id"], "k": "'Component:' || p_partkey", "package": f"CASE {_P} % 3 WHEN 0 THEN 'org/p' || {_P} ELSE 'p' || {_P} END", "own": "CASE p_partkey % 4 WHEN 0 THEN '1.' || (p_partkey % 10) WHEN 1 THEN '' END", "evidence": "'part-' || p_partkey"}
FILE = {"graph_id": CODE["graph_id"], "path": CODE["path"], "manifest": "'m' || (p_partkey % 3) || '/pom.xml'"}
USE = {**_SEEN, "package": f"CASE l_suppkey % 4 WHEN 0 THEN 'sub/p' || {_L} ELSE 'p' || {_L} END", "path": "CASE l_suppkey % 4 WHEN 1 THEN 'src/' || (l_partkey % 7) ELSE 'src/' || (l_suppkey % 9) END", "kind": "CASE l_orderkey % 2 WHEN 0 THEN 'used' ELSE 'imported' END", "line": "l_linenumber + l_suppkey % 5", "symbol": "CASE l_suppkey % 3 WHEN 0 THEN 'fn' || l_partkey END", "affected": "CASE WHEN l_orderkey % 11 = 0 THEN 'bad' || (l_orderkey % 3) END", "evidence": f"CASE WHEN l_orderkey % 31 > 0 THEN 'use-' || {_ID} END"}
NEED = {**_SEEN, "manifest": "'m' || (l_suppkey % 4) || '/pom.xml'", "source_name": "'s' || (l_suppkey % 3)", "name": f"CASE l_suppkey % 4 WHEN 0 THEN 'sub/p' || {_L} ELSE 'p' || {_L} END", "relationship": "CASE l_suppkey % 2 WHEN 0 THEN 'direct' END", "evidence": f"CASE WHEN l_orderkey % 31 > 0 THEN 'need-' || {_ID} END"}
FOUND = {"graph_id": _SEEN["graph_id"], "k": f"'Finding:' || {_ID}", "finding": f"'finding-' || {_ID}", "component": "'Component:' || l_partkey"}
_OF = {"code": ("part", "true", CODE), "parts": ("part", "true", PART), "files": ("part", "true", FILE), "u0": ("lineitem", "l_linenumber % 2 = 1", USE), "n0": ("lineitem", "l_linenumber % 2 = 0", NEED), "found": ("lineitem", "l_returnflag = 'R'", FOUND)}


def _table(s, d, name):
    source, where, columns = _OF[name]
    return s.read.parquet(f"{d}/{source}.parquet").where(where).selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def _observed(s, d):
    """Usages and dependencies with their outcomes."""
    listed = lambda rows: rows.withColumn("evidence_ids", F.when(F.col("evidence").isNotNull(), F.array("evidence")).otherwise(F.array().cast("array<string>"))).drop("evidence")
    files = _table(s, d, "files")
    files = files.select("graph_id", "path").unionByName(files.select("graph_id", F.col("manifest").alias("path"))).distinct()
    return rc.weighed(listed(_table(s, d, "u0")), files, "path"), rc.weighed(listed(_table(s, d, "n0")), files, "manifest")


def _base(s, d):
    """Nodes and edges of code, components and findings."""
    one = lambda c: F.array(F.concat(F.lit("seen-"), c))
    code, parts, found = _table(s, d, "code"), _table(s, d, "parts"), _table(s, d, "found")
    entry, bk = code.where("entry"), pg.key("Boundary", F.col("k"))
    nodes = pg.union(
        pg.nodes(code, "t", "CodeEntity", F.col("k"), F.col("sym"), F.col("path"), F.col("line"), F.col("sym")),
        pg.nodes(entry, "t", "Boundary", bk, F.col("k")),
        pg.nodes(parts, "t", "Component", F.col("k"), F.col("k"), evidence=F.array("evidence"), packageName=F.col("package"), version=F.col("own")),
        pg.nodes(found, "t", "Finding", F.col("k"), F.col("k"), findingId=F.col("finding")),
    )
    edges = pg.union(
        pg.edges(entry, "t", "registers", bk, F.col("k"), evidence=one(F.col("k"))),
        pg.edges(code.where("caller IS NOT NULL"), "t", "calls", F.col("caller"), F.col("k"), evidence=one(F.col("k"))),
        pg.edges(found, "t", "affects", F.col("k"), F.col("component")),
    )
    return nodes, edges


def _graph(s, d):
    """The base graph, and nodes and edges of the observations that are kept, which have keys and kinds of their own."""
    nodes, edges = _base(s, d)
    nodes = written(pg.upserted(nodes), "record-nodes")
    used, needed = (rows.where("outcome = 'kept'").drop("outcome") for rows in _observed(s, d))
    more, links = rc.usage_graph(used.withColumn("line", F.col("line").cast("long")), needed, nodes)
    return pg.union(nodes, more), pg.union(pg.upserted(edges), links)


def _shared(s, d):
    graph = cache(lambda: _graph(s, d))
    return once(s, "record-all-nodes", d, lambda: graph()[0]), once(s, "record-all-edges", d, lambda: graph()[1])


def _records(s, d):
    return once(s, "component-records", d, lambda: rc.records(*_shared(s, d)))


def _weighed(s, d):
    used, needed = _observed(s, d)
    rows = lambda what, frame: frame.select(F.lit(what).alias("what"), "graph_id", "ord", "outcome")
    return rows("usage", used).unionByName(rows("dependency", needed))


QUERIES = {
    "g13_observations": _weighed,
    "g13_records": lambda s, d: _records(s, d).withColumn("path_edge_ids", F.array_join("path_edge_ids", ">")),
    "g13_component_findings": lambda s, d: rc.component_findings(*_base(s, d)),
    "g13_component_evidence": lambda s, d: rc.component_evidence(*_shared(s, d), _records(s, d)),
}
_BASE = ", ".join(f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM {t} WHERE {w})" for n, (t, w, cols) in _OF.items())
_EDGE = "'edge_' || substr(sha256(graph_id || chr(0) || kind || ':' || from_id || ':' || to_id || tail), 1, 16)"
_ALL = f"""{_BASE}, listed AS (SELECT graph_id, path FROM files UNION SELECT graph_id, manifest FROM files),
uo AS (SELECT u.*, CASE WHEN evidence IS NULL THEN 'no_evidence' WHEN l.path IS NULL THEN 'outside_manifest' ELSE 'kept' END AS outcome FROM u0 u LEFT JOIN listed l ON l.graph_id = u.graph_id AND l.path = u.path),
no AS (SELECT n.*, CASE WHEN evidence IS NULL THEN 'no_evidence' WHEN l.path IS NULL THEN 'outside_manifest' ELSE 'kept' END AS outcome FROM n0 n LEFT JOIN listed l ON l.graph_id = n.graph_id AND l.path = n.manifest),
asked AS (SELECT graph_id, package FROM uo WHERE outcome = 'kept' UNION SELECT graph_id, name FROM no WHERE outcome = 'kept'),
mt AS (SELECT DISTINCT a.graph_id, p.k AS ck, a.package FROM parts p JOIN asked a ON a.graph_id = p.graph_id AND (a.package = p.package OR ends_with(a.package, '/' || p.package) OR ends_with(p.package, '/' || a.package))),
nm AS (SELECT graph_id, path, sym, any_value(k) AS k FROM code GROUP BY graph_id, path, sym HAVING count(*) = 1),
fl AS (SELECT graph_id, path, CASE WHEN count(*) FILTER (WHERE sym = 'program') = 1 THEN min(k) FILTER (WHERE sym = 'program') WHEN count(*) = 1 THEN min(k) END AS k FROM code GROUP BY graph_id, path),
ow AS (SELECT u.*, coalesce(CASE WHEN u.symbol IS NOT NULL THEN nm.k ELSE fl.k END, 'ComponentUsage:' || u.path || ':' || u.line || ':' || u.package || ':' || u.kind) AS owner FROM uo u LEFT JOIN nm ON nm.graph_id = u.graph_id AND nm.path = u.path AND nm.sym = u.symbol LEFT JOIN fl ON fl.graph_id = u.graph_id AND fl.path = u.path WHERE outcome = 'kept'),
us AS (SELECT o.graph_id, CASE kind WHEN 'used' THEN 'uses' ELSE 'imports' END AS kind, {_nid('owner', 'o.graph_id')} AS from_id, {_nid('ck', 'o.graph_id')} AS to_id, ':' || path || ':' || line || ':' || o.package || ':' || coalesce(affected, '') AS tail, affected, arg_min(struct_pack(v := version, e := evidence), ord) AS x FROM ow o JOIN mt ON mt.graph_id = o.graph_id AND mt.package = o.package GROUP BY ALL),
nd AS (SELECT n.graph_id, 'depends_on' AS kind, {_nid("'DependencyManifest:' || manifest || ':' || source_name", 'n.graph_id')} AS from_id, {_nid('ck', 'n.graph_id')} AS to_id, ':' || name AS tail, NULL AS affected, arg_min(struct_pack(v := version, e := evidence), ord) AS x FROM no n JOIN mt ON mt.graph_id = n.graph_id AND mt.package = n.name WHERE outcome = 'kept' GROUP BY ALL),
ee AS (SELECT *, {_EDGE} AS edge_id, x.v AS version, x.e AS evidence FROM (SELECT * FROM us UNION ALL SELECT * FROM nd)),
s0 AS (SELECT graph_id, 'registers' AS kind, {_nid("'Boundary:' || k", 'graph_id')} AS from_id, {_nid('k', 'graph_id')} AS to_id, '' AS tail, k FROM code WHERE entry UNION ALL SELECT graph_id, 'calls', {_nid('caller', 'graph_id')}, {_nid('k', 'graph_id')}, '', k FROM code WHERE caller IS NOT NULL),
st AS (SELECT *, {_EDGE} AS edge_id, 'seen-' || k AS evidence FROM s0)"""
_REACHED = f"""rt(graph_id, node, start, ids) AS (SELECT graph_id, from_id, from_id, []::VARCHAR[] FROM st WHERE kind = 'registers' UNION SELECT r.graph_id, to_id, start, list_append(ids, edge_id) FROM rt r JOIN st ON st.graph_id = r.graph_id AND st.from_id = r.node WHERE len(ids) < 12),
rb AS (SELECT graph_id, node, arg_min(ids, struct_pack(n := len(ids), s := start, i := ids)) AS ids FROM rt GROUP BY graph_id, node),
iv AS (SELECT e.*, (kind = 'depends_on')::INT || edge_id AS o, r.ids FROM ee e LEFT JOIN rb r ON r.graph_id = e.graph_id AND r.node = e.from_id),
bt AS (SELECT graph_id, to_id, min(o) FILTER (WHERE ids IS NOT NULL) AS f, min(o) FILTER (WHERE ids IS NOT NULL AND affected IS NOT NULL) AS fb, arg_min(list_append(ids, edge_id), o) FILTER (WHERE ids IS NOT NULL) AS path, arg_min(version, o) FILTER (WHERE version <> '') AS version, arg_min(affected, edge_id) FILTER (WHERE affected IS NOT NULL) AS affected,
  min(edge_id) FILTER (WHERE kind = 'uses') AS u, min(edge_id) FILTER (WHERE kind = 'imports') AS i, min(edge_id) FILTER (WHERE kind = 'depends_on') AS d FROM iv GROUP BY graph_id, to_id),
rs AS (SELECT p.graph_id, {_nid('k', 'p.graph_id')} AS component_id, package AS package_name, coalesce(CASE WHEN own <> '' THEN own END, version) AS version, coalesce(f = fb, false) AS bad, f IS NOT NULL AS hit, u, i, d, CASE WHEN f IS NOT NULL THEN path WHEN coalesce(u, i, d) IS NOT NULL THEN [coalesce(u, i, d)] ELSE [] END AS path, affected FROM parts p LEFT JOIN bt b ON b.graph_id = p.graph_id AND b.to_id = {_nid('k', 'p.graph_id')})"""
ORACLE_SQL = {
    "g13_observations": f"WITH {_ALL} SELECT 'usage' AS what, graph_id, ord, outcome FROM uo UNION ALL SELECT 'dependency', graph_id, ord, outcome FROM no",
    "g13_records": f"WITH RECURSIVE {_ALL}, {_REACHED} SELECT graph_id, component_id, package_name, version, CASE WHEN bad THEN 'affected_symbol_reachable' WHEN hit THEN 'reachable_from_boundary' WHEN u IS NOT NULL THEN 'used' WHEN i IS NOT NULL THEN 'imported' WHEN d IS NOT NULL THEN 'dependency_graph_reachable' ELSE 'present' END AS level, array_to_string(path, '>') AS path_edge_ids, affected AS affected_symbol, CASE WHEN bad THEN 'reachable' ELSE 'unknown' END AS affected_reachability FROM rs",
    "g13_component_findings": f"WITH {_BASE} SELECT DISTINCT f.graph_id, {_nid('component', 'f.graph_id')} AS component_id, finding AS finding_id FROM found f JOIN parts p ON p.graph_id = f.graph_id AND p.k = f.component",
    "g13_component_evidence": f"WITH RECURSIVE {_ALL}, {_REACHED}, ev AS (SELECT graph_id, edge_id, evidence FROM ee UNION ALL SELECT graph_id, edge_id, evidence FROM st) SELECT graph_id, {_nid('k', 'graph_id')} AS component_id, evidence AS evidence_id FROM parts UNION SELECT graph_id, to_id, evidence FROM ee UNION SELECT r.graph_id, component_id, evidence FROM (SELECT graph_id, component_id, unnest(path) AS edge_id FROM rs) r JOIN ev ON ev.graph_id = r.graph_id AND ev.edge_id = r.edge_id",
}
