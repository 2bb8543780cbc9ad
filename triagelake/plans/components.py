"""Registered queries of component reachability: customers are code, parts are components, line items use and need them."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.operators import property_graph as pg
from triagelake.operators import reachability as rc
from triagelake.sources.shared import written

from .graphs import _nid

_SYM = "CASE c_custkey % 4 WHEN 0 THEN 'program' WHEN 1 THEN 'fn' || (c_custkey % 9) ELSE 'fn' || c_custkey END"
CODE = {"graph_id": "'repo' || (c_custkey % 5)", "path": "'src/' || (c_custkey % 60)", "line": "1 + c_custkey % 50", "sym": _SYM, "k": "'Code:' || c_custkey", "entry": "c_custkey % 6 = 0"}
PART = {"graph_id": "'repo' || (p_partkey % 5)", "k": "'Component:' || p_partkey", "package": "CASE p_partkey % 3 WHEN 0 THEN 'org/p' || (p_partkey % 40) ELSE 'p' || (p_partkey % 40) END"}
USE = {"graph_id": "'repo' || (l_orderkey % 5)", "package": "CASE l_partkey % 4 WHEN 0 THEN 'sub/p' || (l_partkey % 70) ELSE 'p' || (l_partkey % 70) END", "path": "'src/' || (l_orderkey % 80)", "kind": "CASE l_partkey % 2 WHEN 0 THEN 'used' ELSE 'imported' END", "line": "l_linenumber", "symbol": "CASE l_suppkey % 3 WHEN 0 THEN 'fn' || (l_orderkey % 9) END", "affected": "CASE WHEN l_partkey % 37 = 0 THEN 'bad' END"}
NEED = {"graph_id": "'repo' || (l_orderkey % 5)", "manifest": "'m' || (l_suppkey % 4) || '/pom.xml'", "source_name": "'s' || (l_suppkey % 3)", "name": "'p' || (l_partkey % 40)"}
_OF = {"code": ("customer", "true", CODE), "parts": ("part", "true", PART), "uses": ("lineitem", "l_partkey % 7 = 0", USE), "needs": ("lineitem", "l_partkey % 11 = 0", NEED)}
_SQL = ", ".join(f"{n} AS (SELECT DISTINCT {', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM {t} WHERE {w})" for n, (t, w, cols) in _OF.items())


def _table(s, d, name):
    source, where, columns = _OF[name]
    return s.read.parquet(f"{d}/{source}.parquet").where(where).selectExpr(*(f"{e} AS {c}" for c, e in columns.items())).distinct()


def _nodes(s, d):
    """Code, one in six with a boundary that registers it, and components; and the edges between them."""
    code, parts = _table(s, d, "code"), _table(s, d, "parts")
    entry = code.where("entry")
    bk = pg.key("Boundary", F.col("k"))
    nodes = pg.union(pg.nodes(code, "t", "CodeEntity", F.col("k"), F.col("sym"), F.col("path"), F.col("line"), F.col("sym")), pg.nodes(entry, "t", "Boundary", bk, F.col("k")), pg.nodes(parts, "t", "Component", F.col("k"), F.col("k"), packageName=F.col("package")))
    return nodes, pg.edges(entry, "t", "registers", bk, F.col("k"))


def _observed(s, d):
    """The written nodes, their edges, usages and dependencies."""
    nodes, edges = _nodes(s, d)
    return written(nodes, "component-nodes"), edges, _table(s, d, "uses").withColumn("line", F.col("line").cast("long")), _table(s, d, "needs")


def _graph(s, d):
    nodes, _, uses, needs = _observed(s, d)
    return rc.usage_graph(uses, needs, nodes)


def _levels(s, d):
    return rc.usage_levels(*_observed(s, d))


QUERIES = {
    "j05_component_matches": lambda s, d: rc.matched(_nodes(s, d)[0], _table(s, d, "uses").select("graph_id", "package").distinct()),
    "j06_usage_owners": lambda s, d: rc.owned(_table(s, d, "uses"), _nodes(s, d)[0]).select("graph_id", "package", "path", "kind", "line", "owner_key", "is_new", F.coalesce("symbol", F.lit("")).alias("symbol")).distinct(),
    "j07_usage_nodes": lambda s, d: _graph(s, d)[0].select("graph_id", "node_id", "label"),
    "j07_usage_edges": lambda s, d: _graph(s, d)[1].select("graph_id", "edge_id", "kind", "from_id", "to_id"),
    "g13_levels": lambda s, d: _levels(s, d),
    "a15_usage_coverage": lambda s, d: rc.coverage(_levels(s, d)),
}
_KEY = "'ComponentUsage:' || path || ':' || line || ':' || package || ':' || kind"
_ALL = f"""{_SQL}, names AS (SELECT DISTINCT graph_id, k, unnest([package, k]) AS n FROM parts), asked AS (SELECT DISTINCT graph_id, package FROM uses UNION SELECT DISTINCT graph_id, name FROM needs),
mt AS (SELECT DISTINCT a.graph_id, k AS component_key, a.package FROM names m JOIN asked a ON a.graph_id = m.graph_id AND (a.package = m.n OR ends_with(a.package, '/' || m.n) OR ends_with(m.n, '/' || a.package))),
nm AS (SELECT graph_id, path, sym, any_value(k) AS k FROM code GROUP BY graph_id, path, sym HAVING count(*) = 1), fl AS (SELECT graph_id, path, CASE WHEN count(*) FILTER (WHERE sym = 'program') = 1 THEN min(k) FILTER (WHERE sym = 'program') WHEN count(*) = 1 THEN min(k) END AS k FROM code GROUP BY graph_id, path),
ow AS (SELECT u.*, CASE WHEN u.symbol IS NOT NULL THEN nm.k ELSE fl.k END AS kk, coalesce(CASE WHEN u.symbol IS NOT NULL THEN nm.k ELSE fl.k END, {_KEY.replace('path', 'u.path')}) AS owner_key FROM uses u LEFT JOIN nm ON nm.graph_id = u.graph_id AND nm.path = u.path AND nm.sym = u.symbol LEFT JOIN fl ON fl.graph_id = u.graph_id AND fl.path = u.path),
us AS (SELECT o.*, component_key FROM ow o JOIN mt ON mt.graph_id = o.graph_id AND mt.package = o.package), nd AS (SELECT n.*, component_key, 'DependencyManifest:' || manifest || ':' || source_name AS mk FROM needs n JOIN mt ON mt.graph_id = n.graph_id AND mt.package = n.name),
ed AS (SELECT DISTINCT graph_id, CASE kind WHEN 'used' THEN 'uses' ELSE 'imports' END AS kind, {_nid('owner_key', 'graph_id')} AS from_id, {_nid('component_key', 'graph_id')} AS to_id, path || ':' || line || ':' || package || ':' || coalesce(affected, '') AS tail, affected FROM us UNION SELECT graph_id, 'depends_on', {_nid('mk', 'graph_id')}, {_nid('component_key', 'graph_id')}, name, NULL FROM nd),
ee AS (SELECT *, 'edge_' || substr(sha256(graph_id || chr(0) || kind || ':' || from_id || ':' || to_id || ':' || tail), 1, 16) AS edge_id FROM ed), st AS (SELECT graph_id, {_nid('k', 'graph_id')} AS id FROM code WHERE entry),
lv AS (SELECT p.graph_id, {_nid('p.k', 'p.graph_id')} AS component_id, count(*) FILTER (WHERE s.id IS NOT NULL) AS hits, arg_min(affected, (kind = 'depends_on')::INT || edge_id) FILTER (WHERE s.id IS NOT NULL AND affected IS NOT NULL) AS any_bad, min((kind = 'depends_on')::INT || edge_id) FILTER (WHERE s.id IS NOT NULL) AS f, min((kind = 'depends_on')::INT || edge_id) FILTER (WHERE s.id IS NOT NULL AND affected IS NOT NULL) AS fb,
  count(*) FILTER (WHERE kind = 'uses') AS u, count(*) FILTER (WHERE kind = 'imports') AS i, count(*) FILTER (WHERE kind = 'depends_on') AS d FROM parts p LEFT JOIN ee e ON e.graph_id = p.graph_id AND e.to_id = {_nid('p.k', 'p.graph_id')} LEFT JOIN st s ON s.graph_id = e.graph_id AND s.id = e.from_id GROUP BY ALL),
levels AS (SELECT graph_id, component_id, CASE WHEN f IS NOT NULL AND f = fb THEN 'affected_symbol_reachable' WHEN f IS NOT NULL THEN 'reachable_from_boundary' WHEN u > 0 THEN 'used' WHEN i > 0 THEN 'imported' WHEN d > 0 THEN 'dependency_graph_reachable' ELSE 'present' END AS level, CASE WHEN f IS NOT NULL THEN 2 WHEN u + i + d > 0 THEN 1 ELSE 0 END::INT AS n_edges FROM lv)"""
ORACLE_SQL = {
    "j05_component_matches": f"WITH {_ALL} SELECT graph_id, component_key, package FROM mt WHERE (graph_id, package) IN (SELECT graph_id, package FROM uses)",
    "j06_usage_owners": f"WITH {_ALL} SELECT DISTINCT graph_id, package, path, kind, line, owner_key, kk IS NULL AS is_new, coalesce(symbol, '') AS symbol FROM ow",
    "j07_usage_nodes": f"WITH {_ALL} SELECT DISTINCT graph_id, {_nid('owner_key', 'graph_id')} AS node_id, kind || ' ' || package AS label FROM us WHERE kk IS NULL UNION SELECT DISTINCT graph_id, {_nid('mk', 'graph_id')}, source_name || ' dependency graph' FROM nd",
    "j07_usage_edges": f"WITH {_ALL} SELECT graph_id, edge_id, kind, from_id, to_id FROM ee",
    "g13_levels": f"WITH {_ALL} SELECT * FROM levels",
    "a15_usage_coverage": f"WITH {_ALL} SELECT graph_id, 'dependency_usage' AS area, 'component-reachability' AS producer, 'checked' AS state, count(*) FILTER (WHERE level <> 'present') AS covered, count(*) AS total FROM levels GROUP BY graph_id",
}
