"""Registered queries of property graphs, built from programs, trees, reports and contracts, and of rules over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.operators import correlation as co
from triagelake.operators import property_graph as pg
from triagelake.operators import reachability as rc
from triagelake.operators import workflows
from triagelake.sources import programs, trees
from triagelake.sources.shared import once, written

from . import files as fp
from .programs import _CONTEXT, _ENTITY, _SYMBOL, _lit

NODE_COLUMNS, EDGE_COLUMNS = ("graph_id", "node_id", "kind", "stable_key", "path", "CAST(coalesce(line, 0) AS BIGINT) AS line"), ("graph_id", "edge_id", "kind", "from_id", "to_id")


def _nid(key: str, graph: str = "repo_id") -> str:
    return f"'node_' || substr(sha256({graph} || chr(0) || {key}), 1, 16)"


def _edge(kind: str, start: str, end: str, *more: str, graph: str = "repo_id") -> str:
    """A row of an edge: graph, id, kind, ends."""
    tail = "".join(f" || ':' || {m}" for m in more)
    return f"SELECT {graph} AS graph_id, 'edge_' || substr(sha256({graph} || chr(0) || '{kind}:' || {_nid(start, graph)} || ':' || {_nid(end, graph)}{tail}), 1, 16) AS edge_id, '{kind}' AS kind, {_nid(start, graph)} AS from_id, {_nid(end, graph)} AS to_id"


def _node(kind: str, key: str, path: str = "path", line: str = "line", graph: str = "repo_id") -> str:
    return f"SELECT {graph} AS graph_id, {_nid(key, graph)} AS node_id, {kind if kind.startswith('CASE') else _lit(kind)} AS kind, {key} AS stable_key, {path} AS path, coalesce({line}, 0)::BIGINT AS line"


_EK = "'CodeEntity:' || full_name || ':' || path || ':' || line"
_BK = "'Boundary:' || b_type || ':' || coalesce(b_method, '') || ':' || b_route || ':' || full_name"
_ARG = pg.ARGUMENT
_SOME = lambda p: f"nullif(regexp_extract(x, {_lit(p)}, 1), '')"
_HANDLERS = f"""list_distinct(list_filter(list_transform(list_filter(list_transform(regexp_extract_all(regexp_extract(code, '(?s)\\((.*)\\)', 1), {_lit(_ARG)}, 0), lambda x: trim(x))[2:], lambda x: NOT regexp_matches(x, {_lit("^$|^[\"'`{]")})),
  lambda x: coalesce({_SOME(r'^([A-Za-z_$][\w$]*)$')}, CASE WHEN NOT contains(x, '.') THEN {_SOME(r'\b([A-Za-z_$][\w$]*)\s*\(\s*\)?\s*$')} END, {_SOME(r'\basyncHandler\s*\(\s*([A-Za-z_$][\w$]*)\s*\(')})), lambda x: x IS NOT NULL AND x NOT IN ({', '.join(f"'{n}'" for n in pg.NO_HANDLERS)})))"""
#: Nodes (gn) and edges (ge) of code.
CODE = f"""{_ENTITY}, who AS (SELECT *, {_EK} AS ek, {_SYMBOL.format('full_name')} AS sym FROM ctx),
exact AS (SELECT repo_id, full_name, min(ek) AS ek, arg_min(path, ek) AS path, arg_min(sym, ek) AS sym FROM who GROUP BY repo_id, full_name), uniq AS (SELECT repo_id, sym, any_value(ek) AS ek FROM exact GROUP BY repo_id, sym HAVING count(*) = 1),
cc AS (SELECT who.*, nth, name, resolved, coalesce(code, '') AS code, coalesce(cal.line, who.line)::BIGINT AS spot FROM who JOIN cal USING (entity)),
bb AS (SELECT repo_id, ek, full_name, path, line::BIGINT AS line, {_BK} AS bk, coalesce(b_source, 'request') AS src FROM who WHERE b_type IS NOT NULL AND b_route IS NOT NULL
  UNION ALL SELECT repo_id, ek, full_name, path, spot, 'Boundary:socket-event::' || regexp_extract(code, {_lit(pg.SOCKET)}, 1) || ':' || full_name || ':' || spot, coalesce(nullif(regexp_extract(code, {_lit(pg.PAYLOAD)}, 1), ''), 'socket payload') FROM cc WHERE regexp_matches(code, {_lit(pg.SOCKET)})),
seed AS (SELECT repo_id, full_name, path, line + 1 AS line, 'w' || line AS src, sym FROM who WHERE entity % 4 = 0), local AS (SELECT repo_id, sym, path, any_value(ek) AS ek, any_value(full_name) AS own FROM exact GROUP BY repo_id, sym, path HAVING count(*) = 1),
sd AS (SELECT s.repo_id, coalesce(x.ek, l.ek) AS ek, CASE WHEN x.ek IS NOT NULL THEN s.full_name ELSE l.own END AS own, s.path, s.line, s.src FROM seed s LEFT JOIN exact x ON x.repo_id = s.repo_id AND x.full_name = s.full_name LEFT JOIN local l ON l.repo_id = s.repo_id AND l.sym = s.sym AND l.path = s.path),
s1 AS (SELECT * FROM sd WHERE ek IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bb WHERE bb.repo_id = sd.repo_id AND bb.ek = sd.ek) QUALIFY row_number() OVER (PARTITION BY repo_id, ek ORDER BY path, line, src) = 1),
ab AS (SELECT * FROM bb UNION ALL SELECT repo_id, ek, own, path, line, 'Boundary:framework-input::' || own, src FROM s1),
aim AS (SELECT c.*, coalesce(x.ek, u.ek) AS tk, coalesce(resolved, name) AS called FROM (SELECT *, {_SYMBOL.format('coalesce(resolved, name)')} AS csym FROM cc WHERE coalesce(resolved, name) IS NOT NULL) c LEFT JOIN exact x ON x.repo_id = c.repo_id AND x.full_name = coalesce(resolved, name) LEFT JOIN uniq u ON u.repo_id = c.repo_id AND u.sym = csym),
sk AS (SELECT DISTINCT k.*, {_EK.replace('line', 'w.line').replace('full_name', 'w.full_name').replace('path', 'w.path')} AS ek, 'Sink:' || sink_type || ':' || label || ':' || k.full_name || ':' || k.path || ':' || k.line AS kk FROM sinks k JOIN who w ON w.repo_id = k.repo_id AND w.full_name = k.full_name AND w.path = k.path
  WHERE call_name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM aim WHERE aim.tk IS NOT NULL AND aim.repo_id = k.repo_id AND aim.full_name = k.full_name AND aim.path = k.path AND aim.nth = k.nth)),
wh AS (SELECT *, 'Sink:' || sink_type || ':' || semantic || ':' || full_name || ':' || path || ':' || line AS kk, {_EK} AS ek FROM f),
hd AS (SELECT repo_id, ek, path, spot, unnest({_HANDLERS}) AS h FROM cc WHERE regexp_matches(code, {_lit(pg.ROUTE)})),
ht AS (SELECT h.*, coalesce(x.ek, u.ek) AS tk FROM (SELECT *, {_SYMBOL.format('h')} AS hsym FROM hd) h LEFT JOIN exact x ON x.repo_id = h.repo_id AND x.full_name = h.h LEFT JOIN uniq u ON u.repo_id = h.repo_id AND u.sym = h.hsym),
ch AS (SELECT c.repo_id, c.ek AS ck, p.ek AS pk FROM exact c JOIN exact p ON p.repo_id = c.repo_id AND p.path = c.path AND p.full_name = nullif(regexp_extract(c.full_name, '^(.*):<lambda>', 1), '')),
gn AS (SELECT graph_id, node_id, kind, stable_key, path, min(line) AS line FROM ({_node('CodeEntity', 'ek')} FROM who UNION ALL {_node('Boundary', 'bk')} FROM ab UNION ALL {_node('Source', "'Source:' || bk || ':' || src")} FROM ab UNION ALL {_node('Sink', 'kk')} FROM sk UNION ALL {_node('Sink', 'kk')} FROM wh) GROUP BY ALL),
ge AS (SELECT DISTINCT * FROM ({_edge('receives', "'Source:' || bk || ':' || src", 'bk')} FROM ab UNION ALL {_edge('registers', 'bk', 'ek')} FROM ab UNION ALL {_edge('calls', 'ek', 'tk', 'path', 'spot')} FROM aim WHERE tk IS NOT NULL UNION ALL {_edge('calls', 'ek', 'kk', 'path', 'line')} FROM sk
  UNION ALL {_edge('calls', 'ek', 'tk', 'path', 'spot', "'route-handler'")} FROM ht WHERE tk IS NOT NULL AND tk <> ek UNION ALL {_edge('flows_to', 'ek', 'kk', 'semantic')} FROM wh UNION ALL {_edge('flows_to', 'pk', 'ck', "'lexical-child'")} FROM ch))"""


def seeds(s, d):
    """One entity in four gets an input from its framework."""
    rows = s.read.parquet(f"{d}/customer.parquet").where("c_custkey % 4 = 0").selectExpr(*(f"{programs.ENTITY[c]} AS {c}" for c in ("repo_id", "full_name", "path", "line")))
    return rows.select("repo_id", "full_name", "path", (F.col("line") + 1).cast("long").alias("line"), F.concat(F.lit("w"), F.col("line").cast("string")).alias("source_name"))


def _code(s, d):
    return pg.code_graph(programs.entities(s, d), seeds(s, d))


def _written_code(s, d):
    pair: list = []

    def built(k):
        if not pair:
            pair.extend(_code(s, d))
        return pair[k]

    return once(s, "code-nodes", d, lambda: built(0)), once(s, "code-edges", d, lambda: built(1))


def _ci(s, d):
    lines = fp._workflow_lines(s, d)
    steps = workflows.steps(lines)
    return pg.workflow_graph(workflows.names(lines), workflows.triggers(lines), steps, workflows.permissions(lines, steps), workflows.artifacts(lines, steps))


def _contracts(s, d):
    """Risks of contracts: every fifth event is one."""
    rows = s.read.parquet(f"{d}/events.parquet").where("event_id % 5 = 0")
    return rows.selectExpr("'repo' || (user_id % 5) AS repo_id", "'contracts/C' || (user_id % 50) || '.sol' AS path", "'C' || (user_id % 50) AS contract", "'f' || (event_id % 7) AS function", "CAST(event_id % 90 AS BIGINT) AS line", "event_id % 90 + 2 AS call_line", "event_id % 90 + 3 AS state_line")


def _findings(s, d):
    """Findings of parts: an order line is one, with a category by its part."""
    rows = s.read.parquet(f"{d}/lineitem.parquet").where("l_linenumber = 1")
    return rows.selectExpr(
        "'repo' || (l_orderkey % 5) AS graph_id", "'f' || l_orderkey || '-' || l_partkey AS finding_id", "'tool' || (l_suppkey % 3) AS tool", "'R' || (l_partkey % 20) AS rule_id",
        "CASE l_partkey % 6 WHEN 0 THEN 'secret' WHEN 1 THEN 'dependency' WHEN 2 THEN 'github-action' WHEN 3 THEN 'iac' WHEN 4 THEN 'sbom' ELSE 'code-pattern' END AS category", "CASE l_suppkey % 4 WHEN 0 THEN 'high' ELSE 'low' END AS severity",
        "CASE WHEN l_partkey % 10 > 0 THEN 'src/a' || (l_partkey % 30) END AS path", "CASE WHEN l_partkey % 10 > 0 THEN CAST(l_quantity AS BIGINT) END AS line", "CASE WHEN l_partkey % 4 = 0 THEN 'pkg' || l_partkey END AS package",
    ).distinct()


def _clusters(s, d):
    """The findings of a category of a graph, one row each."""
    return _findings(s, d).select("graph_id", F.concat(F.lit("c-"), "category").alias("cluster_id"), "category", "finding_id").distinct()


def contexts(s, d):
    """Contexts of findings: those of code patterns in a program are linked to the entities of their file."""
    nodes = _written_code(s, d)[0]
    return nodes.where("kind = 'CodeEntity'").select("graph_id", F.concat(F.lit("f"), F.col("line").cast("string")).alias("finding_id"), F.when(F.col("line") % 2 == 0, "linked").otherwise("standalone").alias("status"), F.array("node_id").alias("node_ids"), F.array().cast("array<string>").alias("edge_ids"))


def coverage(s, d):
    return s.read.parquet(f"{d}/nation.parquet").selectExpr("'repo' || n_regionkey AS graph_id", "'area' || (n_nationkey % 3) AS area", "CASE WHEN n_nationkey % 3 = 1 THEN 'partial' ELSE 'checked' END AS state").distinct()


def _protected(edges):
    """Every seventh call edge is doubled by one that protects its end."""
    extra = edges.where("kind = 'calls' AND conv(substr(edge_id, 6, 4), 16, 10) % 7 = 0").withColumns({"kind": F.lit("protected_by"), "edge_id": F.concat("edge_id", F.lit("p"))})
    return edges.unionByName(extra)


#: Usages of packages by files of programs: a part is one.
USAGE = {"graph_id": "'repo' || (p_partkey % 5)", "package": "'pkg' || p_partkey", "path": programs.PATH.replace(programs.E, "p_partkey"), "kind": "CASE p_partkey % 2 WHEN 0 THEN 'used' ELSE 'imported' END", "line": "1 + p_size"}


def _secret_edges(s, d):
    """Secrets are used by the build steps and resources whose findings are of neighbouring orders."""
    block = F.expr("CAST(split_part(substr(finding_id, 2), '-', 1) AS BIGINT) div 50").alias("block")
    of = lambda *categories: _findings(s, d).where(F.col("category").isin(*categories)).select("graph_id", block, "finding_id", "category")
    pairs = of("secret").withColumnRenamed("finding_id", "secret").drop("category").join(of("github-action", "iac"), ["graph_id", "block"])
    return pg.edges(pairs, "secret-use", "uses", pg.key("QuickScanSubject", "secret", F.col("secret")), pg.key("QuickScanSubject", F.col("category"), F.col("finding_id")))


def _merged_graph(s, d):
    """Code, workflows, infrastructure, content, contracts, findings, uses of packages and of secrets in one graph for each repository."""
    pair: list = []

    def built(k):
        if not pair:
            code, (finding_nodes, finding_edges) = _written_code(s, d), pg.finding_graph(_findings(s, d), _clusters(s, d))
            found = once(s, "finding-nodes", d, lambda: finding_nodes), finding_edges
            parts = s.read.parquet(f"{d}/part.parquet").selectExpr(*(f"CAST({e} AS {'BIGINT' if c == 'line' else 'STRING'}) AS {c}" for c, e in USAGE.items()), "CAST(NULL AS STRING) AS symbol", "CAST(NULL AS STRING) AS affected").distinct()
            needs = s.createDataFrame([], "graph_id string, manifest string, source_name string, name string")
            used = rc.usage_graph(parts, needs, pg.union(code[0].select(*pg.NODE), found[0].select(*pg.NODE)))
            # nodes and edges both read what lines were searched for, so that is written once
            infra, exposed = written(fp._infra(s, d), "infra-resources"), written(fp._exposures(s, d), "content-exposures")
            used = used[0], pg.union(used[1], _secret_edges(s, d))
            pair.extend(pg.merged(code, _ci(s, d), pg.infra_graph(infra), pg.content_graph(exposed), pg.contract_graph(_contracts(s, d)), found, used))
        return pair[k]

    return once(s, "merged-nodes", d, lambda: built(0)), once(s, "merged-edges", d, lambda: built(1))


def _candidates(s, d):
    nodes, edges = _merged_graph(s, d)
    return once(s, "candidates", d, lambda: co.candidates(nodes, _protected(edges), contexts(s, d), coverage(s, d)))


CANDIDATE = ("graph_id", "candidate_id", "rule_id", "title", "reason", "start_key", "end_key")
QUERIES = {
    "g02_g05_j08_j11_code_nodes": lambda s, d: _written_code(s, d)[0].selectExpr(*NODE_COLUMNS),
    "g02_g05_j08_j11_code_edges": lambda s, d: _written_code(s, d)[1].selectExpr(*EDGE_COLUMNS),
    "g06_ci_nodes": lambda s, d: _ci(s, d)[0].selectExpr(*NODE_COLUMNS),
    "g06_ci_edges": lambda s, d: _ci(s, d)[1].selectExpr(*EDGE_COLUMNS),
    "g07_infra_nodes": lambda s, d: pg.infra_graph(fp._infra(s, d))[0].selectExpr(*NODE_COLUMNS),
    "g07_infra_edges": lambda s, d: pg.infra_graph(fp._infra(s, d))[1].selectExpr(*EDGE_COLUMNS),
    "g08_content_nodes": lambda s, d: pg.content_graph(fp._exposures(s, d))[0].selectExpr(*NODE_COLUMNS),
    "g08_content_edges": lambda s, d: pg.content_graph(fp._exposures(s, d))[1].selectExpr(*EDGE_COLUMNS),
    "g09_contract_nodes": lambda s, d: pg.contract_graph(_contracts(s, d))[0].selectExpr(*NODE_COLUMNS),
    "g09_contract_edges": lambda s, d: pg.contract_graph(_contracts(s, d))[1].selectExpr(*EDGE_COLUMNS),
    "g01_finding_nodes": lambda s, d: pg.finding_graph(_findings(s, d), _clusters(s, d))[0].selectExpr(*NODE_COLUMNS),
    "g01_finding_edges": lambda s, d: pg.finding_graph(_findings(s, d), _clusters(s, d))[1].selectExpr(*EDGE_COLUMNS),
    "g10_p23_rule_paths": lambda s, d: co.paths(*_merged_graph(s, d)).select("rule_id", "graph_id", "start_id", "end_id", F.array_join("edge_ids", ">").alias("edges")),
    "g11_code_flows": lambda s, d: co.flows(*_written_code(s, d)).select("graph_id", "flow_id", "source_id", "sink_id", F.array_join("edge_ids", ">").alias("edges")),
    "g12_reached": lambda s, d: co.reached(*_merged_graph(s, d)).select("graph_id", "node_id", "start_id", F.array_join("edge_ids", ">").alias("edges")),
    "g14_g16_candidates": lambda s, d: _candidates(s, d).select(*CANDIDATE, *(F.array_join(c, ",").alias(c) for c in ("finding_ids", "contradicting_edge_ids", "coverage_refs", "required_validation"))),
    "a17_merged_candidates": lambda s, d: co.merged(_candidates(s, d)).select("graph_id", "rule_id", "title", "start_key", "end_key", "n_paths", "candidate_id", F.array_join("supporting_edge_ids", ",").alias("edges"), F.array_join("finding_ids", ",").alias("finding_ids")),
    "p28_w04_limited": lambda s, d: co.limited(co.merged(_candidates(s, d)), 5).select("graph_id", "rule_id", "candidate_id"),
}
_CI_SQL = rf"""{fp._STEPS}, nm AS (SELECT repo_id, path, coalesce({fp._scalar('v')}, regexp_replace({fp._BASE}, '(?i)\.ya?ml$', '')) AS workflow FROM (SELECT repo_id, path, arg_min(v, n) FILTER (WHERE v <> '') AS v FROM (SELECT *, regexp_extract(line, '^\s*name\s*:\s*(.+?)\s*$', 1) AS v FROM w) GROUP BY ALL)),
tr AS (SELECT t.*, workflow FROM (SELECT repo_id, path, event, max(n) AS n FROM (SELECT repo_id, path, n, unnest(list_append(CASE WHEN v LIKE '[%]' THEN list_transform(string_split(v[2:-2], ','), lambda x: {fp._scalar('x')}) WHEN v IS NOT NULL THEN [v] ELSE [] END, b)) AS event
  FROM (SELECT *, {fp._scalar(fp._ON)} AS v, regexp_extract(line, '^\s{{2,}}([A-Za-z_][\w-]*)\s*:', 1) AS b FROM w)) WHERE event IN ({fp._IN(workflows.EVENTS)}) GROUP BY repo_id, path, event) t JOIN nm USING (repo_id, path)),
st AS (SELECT s.*, workflow FROM s JOIN nm USING (repo_id, path)), pm AS (SELECT p.repo_id, p.path, p.n, p.scope, p.access, f.step_id, workflow FROM (SELECT *, lower(regexp_extract(line, '{workflows.PERMISSION}', 1)) AS scope, lower(regexp_extract(line, '{workflows.PERMISSION}', 2)) AS access FROM w) p JOIN nm USING (repo_id, path) LEFT JOIN (SELECT repo_id, path, arg_min(step_id, n) AS step_id FROM s GROUP BY ALL) f ON f.repo_id = p.repo_id AND f.path = p.path WHERE scope <> ''),
ar AS (SELECT repo_id, path, n, step_id, coalesce(next_name, next_path, 'artifact-' || step_id) AS name FROM s WHERE contains(lower(uses), 'actions/upload-artifact'))"""
_WK, _TK, _SK, _PK, _AK = "'CIWorkflow:' || path || ':' || workflow", "'CITrigger:' || path || ':' || event", "'CIStep:' || path || ':' || step_id", "'CIToken:' || path || ':' || coalesce(step_id, 'workflow') || ':' || scope || ':' || access", "'CIArtifact:' || path || ':' || step_id || ':' || name"
_OWNER = f"(CASE WHEN step_id IS NULL THEN {_WK} ELSE {_SK} END)"
_IR = fp._IAC.rsplit("SELECT a.repo_id", 1)
_INFRA_ROWS = f"{_IR[0]}, ir AS (SELECT a.repo_id{_IR[1]})"
_IK = "'IaCResource:' || path || ':' || resource_type || ':' || name"
_CR = fp._CONTENT_SQL.rsplit("SELECT repo_id, path, n, exposure, subject", 1)
_CONTENT_ROWS = f"{_CR[0]}, cr2 AS (SELECT repo_id, path, n, exposure, subject{_CR[1]})"
_CK = "'Content{0}:' || exposure || ':' || path || ':' || n || ':' || subject"
_CON = "con AS (SELECT 'repo' || (user_id % 5) AS repo_id, 'contracts/C' || (user_id % 50) || '.sol' AS path, 'C' || (user_id % 50) AS contract, 'f' || (event_id % 7) AS fun, event_id % 90 AS line FROM events WHERE event_id % 5 = 0)"
_MK, _RK = "'SmartContract:' || path || ':' || contract", "'SmartContractRisk:' || path || ':' || contract || ':' || fun || ':reentrancy'"
_FI = """fi AS (SELECT DISTINCT 'repo' || (l_orderkey % 5) AS graph_id, 'f' || l_orderkey || '-' || l_partkey AS finding_id, CASE l_partkey % 6 WHEN 0 THEN 'secret' WHEN 1 THEN 'dependency' WHEN 2 THEN 'github-action' WHEN 3 THEN 'iac' WHEN 4 THEN 'sbom' ELSE 'code-pattern' END AS category,
  CASE WHEN l_partkey % 10 > 0 THEN 'src/a' || (l_partkey % 30) END AS path, CASE WHEN l_partkey % 10 > 0 THEN CAST(floor(l_quantity) AS BIGINT) END AS line FROM lineitem WHERE l_linenumber = 1)"""
_FK, _FP, _FS = "'QuickScanFinding:' || finding_id", "'QuickScanFile:' || path", "'QuickScanSubject:' || category || ':' || finding_id"
_KIND = "CASE category WHEN 'secret' THEN 'Secret' WHEN 'dependency' THEN 'Component' WHEN 'sbom' THEN 'Component' WHEN 'github-action' THEN 'BuildStep' WHEN 'iac' THEN 'InfraResource' ELSE 'CodeEntity' END"
_MIN = lambda inner: f"SELECT graph_id, node_id, kind, stable_key, path, min(line) AS line FROM ({inner}) GROUP BY ALL"
_DIS = lambda inner: f"SELECT DISTINCT * FROM ({inner})"
ORACLE_SQL = {
    "g02_g05_j08_j11_code_nodes": f"WITH {CODE} SELECT * FROM gn",
    "g02_g05_j08_j11_code_edges": f"WITH {CODE} SELECT * FROM ge",
    "g06_ci_nodes": f"WITH {_CI_SQL} " + _MIN(" UNION ALL ".join([_node("BuildStep", _WK, line="1") + " FROM nm", _node("BuildStep", _TK, line="n") + " FROM tr", _node("BuildStep", _SK, line="n") + " FROM st", _node("Resource", _PK, line="n") + " FROM pm", _node("Resource", _AK, line="n") + " FROM ar"])),
    "g06_ci_edges": f"WITH {_CI_SQL} " + _DIS(" UNION ALL ".join([_edge("contains", _WK, _TK) + " FROM tr", _edge("contains", _WK, _SK) + " FROM st", _edge("depends_on", _OWNER, _PK) + " FROM pm", _edge("writes", _SK, _AK) + " FROM ar"])),
    "g07_infra_nodes": f"WITH {_INFRA_ROWS} " + _MIN(_node("InfraResource", _IK, line="n") + " FROM ir UNION ALL " + _node("ExternalService", f"'{pg.PUBLIC_KEY}'", "NULL", "NULL") + " FROM ir WHERE public"),
    "g07_infra_edges": f"WITH {_INFRA_ROWS} " + _DIS(_edge("exposes", _IK, f"'{pg.PUBLIC_KEY}'") + " FROM ir WHERE public UNION ALL " + _edge("supported_by", "'QuickScanFinding:' || finding_id", _IK) + " FROM (SELECT *, unnest(finding_ids) AS finding_id FROM ir)"),
    "g08_content_nodes": f"WITH {_CONTENT_ROWS} " + _MIN(_node("Resource", _CK.format("Resource"), line="n") + " FROM cr2 UNION ALL " + _node("Sink", _CK.format("Sink"), line="n") + " FROM cr2"),
    "g08_content_edges": f"WITH {_CONTENT_ROWS} " + _DIS(_edge("exposes", _CK.format("Resource"), _CK.format("Sink")) + " FROM cr2"),
    "g09_contract_nodes": f"WITH {_CON} " + _MIN(_node("Resource", _MK) + " FROM con UNION ALL " + _node("Sink", _RK) + " FROM con"),
    "g09_contract_edges": f"WITH {_CON} " + _DIS(_edge("flows_to", _MK, _RK) + " FROM con"),
    "g01_finding_nodes": f"WITH {_FI} " + _MIN(" UNION ALL ".join([_node("Finding", _FK, graph="graph_id") + " FROM fi", _node("Resource", _FP, line="NULL", graph="graph_id") + " FROM fi WHERE path IS NOT NULL", _node(_KIND, _FS, graph="graph_id") + " FROM fi", _node("Finding", "'QuickScanFindingCluster:c-' || category", "NULL", "NULL", "graph_id") + " FROM fi"])),
    "g01_finding_edges": f"WITH {_FI} " + _DIS(" UNION ALL ".join([_edge("located_in", _FK, _FP, "line", "line", graph="graph_id") + " FROM fi WHERE path IS NOT NULL", _edge("affects", _FK, _FS, graph="graph_id") + " FROM fi", _edge("supported_by", "'QuickScanFindingCluster:c-' || category", _FK, graph="graph_id") + " FROM fi"])),
    "g11_code_flows": f"""WITH RECURSIVE {CODE}, snk AS (SELECT graph_id, node_id FROM gn WHERE kind = 'Sink'), walk AS (SELECT graph_id, node_id AS source_id, node_id AS end_id, []::VARCHAR[] AS es, [node_id] AS ns, false AS hit FROM gn WHERE kind = 'Source'
  UNION ALL SELECT w.graph_id, source_id, to_id, list_append(es, edge_id), list_append(ns, to_id), EXISTS (SELECT 1 FROM snk WHERE snk.graph_id = ge.graph_id AND snk.node_id = to_id) FROM walk w JOIN ge ON ge.graph_id = w.graph_id AND ge.from_id = w.end_id WHERE NOT hit AND len(es) < {co.MAX_LENGTH} AND NOT list_contains(ns, to_id) AND ge.kind IN ('receives', 'registers', 'calls', 'flows_to'))
SELECT graph_id, 'flow_' || substr(sha256(graph_id || chr(0) || 'flow:' || source_id || ':' || end_id || ':' || array_to_string(es, '>')), 1, 16) AS flow_id, source_id, end_id AS sink_id, array_to_string(es, '>') AS edges FROM walk WHERE hit""",
}
_PARTS = ("g06_ci", "g07_infra", "g08_content", "g09_contract", "g01_finding")
_USE_KEY = "'ComponentUsage:' || path || ':' || line || ':' || package || ':' || kind"
#: Nodes (gn) and edges (ge) of all graphs in one.
MERGED = f"""code_n AS (WITH {CODE} SELECT graph_id, node_id, kind, stable_key FROM gn), code_e AS (WITH {CODE} SELECT * FROM ge),
code_f AS (WITH {CODE} SELECT repo_id, path, CASE WHEN count(*) FILTER (WHERE p) = 1 THEN min(ek) FILTER (WHERE p) WHEN count(*) = 1 THEN min(ek) END AS k FROM (SELECT DISTINCT repo_id, path, ek, ends_with(full_name, '::program') OR sym IN ('<global>', 'program') AS p FROM who) GROUP BY ALL), {_FI},
raw AS (SELECT DISTINCT 'repo' || (l_orderkey % 5) AS graph_id, 'f' || l_orderkey || '-' || l_partkey AS finding_id, l_partkey % 6 AS c, 'R' || (l_partkey % 20) AS rule, CASE WHEN l_partkey % 4 = 0 THEN 'pkg' || l_partkey END AS package FROM lineitem WHERE l_linenumber = 1),
comp AS (SELECT DISTINCT graph_id, 'QuickScanSubject:' || CASE c WHEN 1 THEN 'dependency' ELSE 'sbom' END || ':' || finding_id AS ck, unnest([package, rule]) AS n FROM raw WHERE c IN (1, 4)),
usage AS (SELECT DISTINCT {', '.join(f"CAST({e} AS {'BIGINT' if c == 'line' else 'VARCHAR'}) AS {c}" for c, e in USAGE.items())} FROM part),
used AS (SELECT u.*, ck, k AS known, coalesce(k, {_USE_KEY.replace('path', 'u.path')}) AS owner FROM usage u JOIN comp ON comp.graph_id = u.graph_id AND comp.n = u.package LEFT JOIN code_f ON code_f.repo_id = u.graph_id AND code_f.path = u.path),
gn AS (SELECT DISTINCT * FROM (SELECT * FROM code_n UNION ALL {' UNION ALL '.join(f"SELECT graph_id, node_id, kind, stable_key FROM ({ORACLE_SQL[f'{p}_nodes']})" for p in _PARTS)} UNION ALL SELECT graph_id, {_nid('owner', 'graph_id')}, 'CodeEntity', owner FROM used WHERE known IS NULL)),
ge AS (SELECT DISTINCT * FROM (SELECT * FROM code_e UNION ALL {' UNION ALL '.join(f"SELECT * FROM ({ORACLE_SQL[f'{p}_edges']})" for p in _PARTS)} UNION ALL {_edge('imports', 'owner', 'ck', 'path', 'line', 'package', "''", graph='graph_id')} FROM used WHERE kind = 'imported' UNION ALL {_edge('uses', 'owner', 'ck', 'path', 'line', 'package', "''", graph='graph_id')} FROM used WHERE kind = 'used'
  UNION ALL SELECT * FROM (WITH pairs AS (SELECT a.graph_id, a.finding_id AS secret, b.category, b.finding_id FROM fi a JOIN fi b ON b.graph_id = a.graph_id AND split_part(substr(b.finding_id, 2), '-', 1)::BIGINT // 50 = split_part(substr(a.finding_id, 2), '-', 1)::BIGINT // 50 WHERE a.category = 'secret' AND b.category IN ('github-action', 'iac')) {_edge('uses', "'QuickScanSubject:secret:' || secret", "'QuickScanSubject:' || category || ':' || finding_id", graph='graph_id')} FROM pairs)))"""
_FLOW_SQL = "['receives', 'registers', 'calls', 'flows_to']"
#: Rules by hand: id, kinds and keys of starts, kinds and keys of targets and keys that are none, edges, edges that must be, length.
_RULES_SQL = f"""rules(rule_id, sk, sp, tk, tp, tn, ok, rq, m) AS (VALUES
  ('stage2.external-input-dangerous-operation', ['Boundary', 'Source'], '%', ['Sink'], '%', 'Sink:outbound_http:%', {_FLOW_SQL}, []::VARCHAR[], 6), ('stage2.sast-reachable-path', ['Boundary', 'Source'], '%', ['CodeEntity'], '%', '', {_FLOW_SQL}, ['calls'], 6),
  ('stage2.dependency-usage-path', ['Boundary', 'Source', 'CodeEntity'], '%', ['Component'], '%', '', ['receives', 'registers', 'calls', 'imports', 'uses', 'depends_on'], [], 6), ('stage2.ci-supply-chain-path', ['BuildStep'], '%', ['Resource'], '%', '', ['contains', 'depends_on', 'uses', 'writes'], [], 6),
  ('stage2.secret-impact-chain', ['Secret'], '%', ['ExternalService', 'InfraResource', 'BuildStep'], '%', '', ['reads', 'uses', 'depends_on', 'flows_to', 'writes', 'exposes'], [], 6), ('stage2.content-resource-exposure-path', ['Resource'], 'ContentResource:%', ['Sink'], 'ContentSink:%', '', ['exposes'], [], 1),
  ('stage2.smart-contract-risk-path', ['Resource'], 'SmartContract:%', ['Sink'], 'SmartContractRisk:%', '', ['flows_to'], [], 1))"""
_WALK = f"""{_RULES_SQL}, fe AS (SELECT * FROM ge),
walk AS (SELECT rule_id, graph_id, node_id AS start_id, node_id AS end_id, []::VARCHAR[] AS es, [node_id] AS ns, []::VARCHAR[] AS ks FROM gn, rules WHERE list_contains(sk, kind) AND stable_key LIKE sp
  UNION ALL SELECT w.rule_id, w.graph_id, start_id, to_id, list_append(es, edge_id), list_append(ns, to_id), list_append(ks, kind) FROM walk w JOIN rules r ON r.rule_id = w.rule_id JOIN fe ON fe.graph_id = w.graph_id AND fe.from_id = w.end_id AND list_contains(r.ok, fe.kind) WHERE len(es) < m AND NOT list_contains(ns, to_id)),
found AS (SELECT w.* FROM walk w JOIN rules r ON r.rule_id = w.rule_id JOIN gn ON gn.graph_id = w.graph_id AND gn.node_id = w.end_id AND list_contains(r.tk, gn.kind) AND gn.stable_key LIKE r.tp AND NOT gn.stable_key LIKE r.tn WHERE len(es) > 0 AND list_has_all(ks, rq))"""
ORACLE_SQL |= {
    "g10_p23_rule_paths": f"WITH RECURSIVE {MERGED}, {_WALK} SELECT rule_id, graph_id, start_id, end_id, array_to_string(es, '>') AS edges FROM found",
    "g12_reached": f"""WITH RECURSIVE {MERGED}, walk AS (SELECT graph_id, node_id, node_id AS start_id, []::VARCHAR[] AS es FROM gn WHERE kind IN ('Source', 'Boundary')
  UNION ALL SELECT graph_id, node_id, start_id, es FROM (SELECT w.graph_id, to_id AS node_id, w.start_id, list_append(w.es, edge_id) AS es FROM walk w JOIN ge ON ge.graph_id = w.graph_id AND ge.from_id = w.node_id WHERE len(w.es) < 12 AND NOT EXISTS (SELECT 1 FROM recurring.walk x WHERE x.graph_id = ge.graph_id AND x.node_id = ge.to_id)) QUALIFY row_number() OVER (PARTITION BY graph_id, node_id ORDER BY start_id, array_to_string(es, '>')) = 1)
SELECT graph_id, node_id, start_id, array_to_string(es, '>') AS edges FROM walk""",
}
