"""Registered queries of what a reviewer is shown: line items are hypotheses of suppliers, customers are policies, orders are challenges."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.operators import content, quick, repository_map, review
from triagelake.sources import trees
from triagelake.sources.shared import once

from . import assessments, files, graphs, scores
from .quick import _ACTIONS, _findings

_ID = "'h' || l_orderkey || '-' || l_linenumber || '-' || l_partkey"
_BLOCK = "'r' || ({0} - {0} % 36)"
_A = scores._list


def _tables(engine: str) -> dict[str, tuple[str, str, dict[str, str]]]:
    a = lambda *x: _A(engine, *x)
    none = "CAST(array() AS ARRAY<STRING>)" if engine == "spark" else "[]::VARCHAR[]"
    said = {"repo_id": "'r' || l_suppkey", "hypothesis_id": _ID}
    return {
        "said": ("lineitem", "true", said | {"title": "CASE l_linenumber % 2 WHEN 0 THEN 'Path  of ' ELSE ' path OF ' END || (l_partkey % 3)", "status": "CASE l_returnflag WHEN 'R' THEN 'statically_contradicted' WHEN 'A' THEN 'statically_supported' ELSE 'inconclusive' END", "runtime": "l_linestatus = 'O'", "confidence": "l_discount"}),
        "enriched": ("lineitem", "l_linenumber > 1", said | {"attack_description": "CASE l_orderkey % 2 WHEN 0 THEN ' Sends   DATA ' ELSE 'sends data ' END || (l_partkey % 2)", "impact": "'Impact ' || (l_orderkey % 3)", "agent_prompt": "'Fix it'"}),
        "recipes": ("lineitem", "l_linenumber < 4", said | {"required_fixtures": f"CASE l_partkey % 3 WHEN 0 THEN {a("'A  fixture'", "'b'")} ELSE {a("'a FIXTURE'", "'b'")} END", "expected_result": "'Done  ' || (l_linenumber % 2)"}),
        "challenges": ("orders", "true", {"repo_id": _BLOCK.format("o_custkey"), "category": "'cat' || (o_orderkey % 38)"}),
        "policies": ("customer", "true", {"repo_id": _BLOCK.format("c_custkey"), "category": "CASE c_custkey % 7 WHEN 0 THEN 'old' ELSE 'cat' END || (c_custkey % 36)", "ground_truth_ids": f"CASE c_custkey % 4 WHEN 0 THEN {none} ELSE {a("'t' || c_custkey", "'t' || (c_custkey + 1)")} END", "limitation": "CASE WHEN c_custkey % 5 = 0 THEN 'limit ' || c_custkey END", "challenge_gaps": f"CASE c_custkey % 3 WHEN 0 THEN {a("'gap ' || c_custkey", "' '")} ELSE {none} END"}),
        "known": ("customer", "c_acctbal > 0", {"item_id": "'t' || c_custkey"}),
    }


def table(s, d, name):
    source, where, columns = _tables("spark")[name]
    return s.read.parquet(f"{d}/{source}.parquet").where(where).selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def _actions(s, d):
    return quick.actions(_findings(s, d)).select("repo_id", "action_id", "remediation_key")


def _marked(s, d):
    """What is out of the graph's scope stands for what is true but not curated."""
    truth = scores.table(s, d, "static_truth")
    hypotheses = scores.table(s, d, "hypotheses").withColumn("candidate_id", F.concat(F.lit("k"), F.col("ord").cast("string")))
    return once(s, "reviewed", d, lambda: review.reviewed(hypotheses, truth, truth.where("NOT in_scope"), scores.table(s, d, "false_support")))


def _audit(s, d):
    return review.inventory_errors(*(table(s, d, n) for n in ("challenges", "policies", "known")), fail_on_limitations=True, fail_on_gaps=True)


def _code_coverage(s, d):
    nodes, edges = graphs._written_code(s, d)
    seeds = graphs.seeds(s, d).select(F.col("repo_id").alias("graph_id"))
    return review.code_coverage(nodes, nodes, edges, graphs.co.flow_counts(nodes, edges), seeds)


def _observed(s, d):
    """CI and infrastructure that was observed, content and contracts that were scanned, of every repository with files."""
    routed = content.routed(trees.files(s, d)).withColumnRenamed("repo_id", "graph_id")
    one = lambda name: files.QUERIES[name](s, d).select(F.col("repo_id").alias("graph_id"), F.lit(1).alias("n"))
    seen = one("x11_workflow_names").unionByName(one("x16_x18_j12_infra_resources"))
    scanned = lambda c: routed.select("graph_id", F.col(c).alias("n"))
    rows = review.observed_coverage(routed, seen, "ci_iac", "ci-iac-context")
    return rows.unionByName(review.observed_coverage(routed, scanned("n_content"), "content_assets", "content-resource-context")).unionByName(review.observed_coverage(routed, scanned("n_contracts"), "smart_contracts", "smart-contract-context"))


def _map(s, d):
    """The graphs of assessments, with paths for two nodes in three and counts for coverage."""
    nodes, edges, flows, coverage = assessments._of(s, d, "nodes", "edges", "flows", "coverage")
    nodes = nodes.selectExpr("*", f"{_PATH} AS path")
    coverage = coverage.selectExpr("*", "CAST(length(area) AS BIGINT) AS covered", "CAST(length(producer) AS BIGINT) AS total")
    return repository_map.entries(nodes, edges, flows, coverage).withColumns({"evidence_ids": F.array_join("evidence_ids", ","), **{c: F.col(c).cast("string") for c in ("covered_count", "total_count")}})


_PATH = "CASE WHEN CAST(substr(node_id, 2) AS BIGINT) % 3 > 0 THEN 'src/' || (CAST(substr(node_id, 2) AS BIGINT) % 7) END"
_J = lambda c: F.array_join(c, ",").alias(c)
QUERIES = {
    "a22_action_counts": lambda s, d: review.hidden_counts(_actions(s, d), _findings(s, d)),
    "a22_action_buckets": lambda s, d: review.top_buckets(_actions(s, d), _findings(s, d)),
    "w08_owner_facing": lambda s, d: review.reportable(*(table(s, d, n) for n in ("said", "enriched", "recipes"))),
    "w15_review_summary": lambda s, d: review.review_summary(_marked(s, d)),
    "w15_unreviewed_groups": lambda s, d: review.review_groups(_marked(s, d), scores.table(s, d, "candidates")).select("repo_id", "family", "title", "n", _J("ids"), _J("reasons")),
    "j22_a21_inventory": lambda s, d: review.inventory_summary(table(s, d, "challenges"), table(s, d, "policies")),
    "j22_a21_errors": _audit,
    "a14_code_coverage": _code_coverage,
    "a16_observed_coverage": _observed,
    "g25_map_entries": _map,
}
_SQL = {n: f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM {t} WHERE {w})" for n, (t, w, cols) in _tables("duckdb").items()}
_N = lambda c: f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"
_EACH = " UNION ALL ".join(f"SELECT repo_id, remediation_key, '{w}' AS what, {c} AS value FROM fnd" for w, c in (("rules", "rule_id"), ("tools", "tool"), ("severities", "severity")))
_MARKS = f"""{', '.join(scores._SQL[n] for n in ('static_truth', 'candidates', 'hypotheses', 'false_support'))}, sup AS (SELECT * FROM hypotheses WHERE status = 'statically_supported'), held_in AS (SELECT * FROM static_truth WHERE in_scope), out_of AS (SELECT * FROM static_truth WHERE NOT in_scope),
{scores._MATCH(scores._HPAIRS('held_in', 'sup'), 'held')}, unc AS (SELECT DISTINCT repo_id, finding_id FROM ({scores._HPAIRS('out_of', 'sup')})), wrong AS (SELECT DISTINCT repo_id, finding_id FROM ({scores._HPAIRS('false_support', 'sup')})),
marked AS (SELECT s.*, CASE WHEN h.finding_id IS NOT NULL THEN 'expected' WHEN u.finding_id IS NOT NULL THEN 'uncurated' WHEN w.finding_id IS NOT NULL THEN 'false' ELSE 'unreviewed' END AS mark FROM sup s LEFT JOIN held h ON h.repo_id = s.repo_id AND h.finding_id = s.hypothesis_id LEFT JOIN unc u ON u.repo_id = s.repo_id AND u.finding_id = s.hypothesis_id LEFT JOIN wrong w ON w.repo_id = s.repo_id AND w.finding_id = s.hypothesis_id)"""
_READ = f"""{_SQL['challenges']}, {_SQL['policies']}, {_SQL['known']}, c AS (SELECT repo_id, category, count(*) AS n FROM challenges GROUP BY ALL),
b AS (SELECT coalesce(c.repo_id, p.repo_id) AS repo_id, coalesce(c.category, p.category) AS category, n, p.repo_id IS NOT NULL AS has, ground_truth_ids AS ids, limitation, challenge_gaps AS gaps, n IS NOT NULL AND p.repo_id IS NOT NULL AND (len(ground_truth_ids) > 0 OR limitation IS NOT NULL) AS read FROM c FULL JOIN policies p ON p.repo_id = c.repo_id AND p.category = c.category)"""
_FLOWS = graphs.ORACLE_SQL["g11_code_flows"]
_COV = lambda area, state, have, of: f"SELECT graph_id, '{area}' AS area, {state} AS state, {have} AS covered, {of} AS total FROM n"
_SCANNED = f"SELECT repo_id, n_contracts, n_content FROM ({files.ORACLE_SQL['x27_routing']})"
_ENTRY = lambda source, order, **v: f"SELECT graph_id, {', '.join(f'{v.get(c, "NULL")} AS {c}' for c in repository_map.COLUMNS[1:-1])}, row_number() OVER (PARTITION BY graph_id, {v['section']} ORDER BY {order}) AS nth FROM {source}"
_SORTED = "array_to_string(list_sort(evidence_ids), ',')"
_ENDS = lambda t, a, b: f"(SELECT t.*, coalesce(x.label, {a}) AS from_label, coalesce(y.label, {b}) AS to_label FROM {t} t LEFT JOIN nodes x ON x.graph_id = t.graph_id AND x.node_id = {a} LEFT JOIN nodes y ON y.graph_id = t.graph_id AND y.node_id = {b})"
_MAP = " UNION ALL ".join((
    _ENTRY(f"(SELECT *, {assessments._SECTION} AS section, {_PATH} AS path FROM nodes)", "coalesce(path, ''), label, kind, node_id", section="section", entry_id="node_id", kind="kind", path="path", label="label", evidence_ids=_SORTED, state="state") + " WHERE section IS NOT NULL",
    _ENTRY(_ENDS("edges", "from_id", "to_id"), "kind, from_id, to_id, edge_id", section="'relationships'", entry_id="edge_id", kind="kind", from_id="from_id", from_label="from_label", to_id="to_id", to_label="to_label", evidence_ids=_SORTED, state="state"),
    _ENTRY(_ENDS("flows", "source_id", "sink_id"), "flow_id", section="'flows'", entry_id="flow_id", from_id="source_id", from_label="from_label", to_id="sink_id", to_label="to_label", note="array_to_string(edge_ids, '>')", state="state"),
    _ENTRY("coverage", "area, producer, state, coalesce(reason, '')", section="'coverage'", entry_id="area || ':' || producer", kind="producer", label="area", state="state", covered_count="length(area)::VARCHAR", total_count="length(producer)::VARCHAR", note="reason"),
    _ENTRY(f"({assessments.ORACLE_SQL['g26_fact_gaps']})", "source, CASE source WHEN 'coverage' THEN label ELSE '' END, label, gap_id, description", section="'factGaps'", entry_id="gap_id", kind="source", label="label", state="state", note="description"),
))
ORACLE_SQL = {
    "g25_map_entries": f"WITH {assessments._WITH('edges', 'flows', 'coverage')} {_MAP}",
    "a22_action_counts": f"WITH {_ACTIONS}, n AS (SELECT action_id, repo_id, len(finding_ids) AS n, len(files) AS f FROM act) SELECT repo_id, action_id, n AS total_findings, least(n, 10) AS included_findings, n - least(n, 10) AS omitted_findings, f AS total_files, least(f, 20) AS included_files, f - least(f, 20) AS omitted_files FROM n",
    "a22_action_buckets": f"WITH {_ACTIONS}, e AS ({_EACH}), n AS (SELECT repo_id, remediation_key, what, value, count(*) AS n FROM e GROUP BY ALL) SELECT n.repo_id, action_id, what, row_number() OVER (PARTITION BY n.repo_id, n.remediation_key, what ORDER BY n DESC, value) AS nth, value, n FROM n JOIN act a ON a.repo_id = n.repo_id AND a.remediation_key = n.remediation_key QUALIFY nth <= 12",
    "w08_owner_facing": f"""WITH {_SQL['said']}, {_SQL['enriched']}, {_SQL['recipes']} SELECT h.* FROM said h LEFT JOIN enriched e ON e.repo_id = h.repo_id AND e.hypothesis_id = h.hypothesis_id LEFT JOIN recipes r ON r.repo_id = h.repo_id AND r.hypothesis_id = h.hypothesis_id WHERE status <> 'statically_contradicted'
QUALIFY row_number() OVER (PARTITION BY h.repo_id, CASE WHEN e.hypothesis_id IS NULL THEN h.hypothesis_id END, {_N('title')}, status, runtime, {_N('attack_description')}, {_N('impact')}, {_N('agent_prompt')}, r.hypothesis_id IS NULL, list_transform(required_fixtures, lambda x: {_N('x')}), {_N('expected_result')} ORDER BY confidence DESC, title, h.hypothesis_id) = 1""",
    "w15_review_summary": f"WITH RECURSIVE {_MARKS} SELECT repo_id, count(*) AS supported, {', '.join(f"count(*) FILTER (WHERE mark = '{m}') AS {c}" for m, c in (('expected', 'expected_truth'), ('uncurated', 'true_but_uncurated'), ('false', 'false_support'), ('unreviewed', 'unreviewed')))} FROM marked GROUP BY repo_id",
    "w15_unreviewed_groups": f"WITH RECURSIVE {_MARKS} SELECT m.repo_id, coalesce(c.family, 'unknown') AS family, title, count(*) AS n, array_to_string(list(hypothesis_id ORDER BY m.ord)[1:5], ',') AS ids, array_to_string(coalesce(list(c.reason ORDER BY m.ord) FILTER (WHERE c.candidate_id IS NOT NULL), [])[1:3], ',') AS reasons FROM marked m LEFT JOIN candidates c ON c.repo_id = m.repo_id AND c.candidate_id = 'k' || m.ord WHERE mark = 'unreviewed' GROUP BY m.repo_id, coalesce(c.family, 'unknown'), title",
    "j22_a21_inventory": f"WITH {_READ} SELECT repo_id, coalesce(sum(n), 0)::BIGINT AS challenges, count(n) AS categories, count(*) FILTER (WHERE read AND len(ids) > 0) AS covered_categories, count(*) FILTER (WHERE read AND limitation IS NOT NULL) AS limitation_categories, count(*) FILTER (WHERE read AND len(gaps) > 0) AS gap_categories, coalesce(sum(len(gaps)) FILTER (WHERE read), 0)::BIGINT AS gaps FROM b GROUP BY repo_id",
    "j22_a21_errors": f"""WITH {_READ}, er AS (SELECT repo_id, category, CASE WHEN n IS NULL THEN 2 ELSE 1 END AS step, 0 AS g, 0 AS pos, CASE WHEN n IS NULL THEN 'category coverage policy has no matching challenge category: ' || category WHEN NOT has THEN 'category ' || category || ' has ' || n || ' challenges but no inventory coverage policy' WHEN NOT read THEN 'category ' || category || ' coverage must name groundTruthIds or a limitation' END AS error FROM b
UNION ALL SELECT repo_id, category, 1, 1, i, CASE WHEN ids[i] NOT IN (SELECT item_id FROM known) THEN 'category ' || category || ' references missing groundTruth id: ' || ids[i] END FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM b WHERE read)
UNION ALL SELECT repo_id, category, 1, 2, 0, 'category ' || category || ' has documented limitation: ' || limitation FROM b WHERE read
UNION ALL SELECT repo_id, category, 1, 3, i, CASE WHEN trim(gaps[i]) = '' THEN 'category ' || category || ' has an empty challenge gap' ELSE 'category ' || category || ' has open challenge gap: ' || gaps[i] END FROM (SELECT *, unnest(range(1, len(gaps) + 1)) AS i FROM b WHERE read))
SELECT repo_id, step, category, row_number() OVER (PARTITION BY repo_id, step, category ORDER BY g, pos) AS nth, error FROM er WHERE error IS NOT NULL""",
    "a14_code_coverage": f"""WITH {graphs.CODE}, fl AS (SELECT graph_id, count(*) AS flows FROM ({_FLOWS}) GROUP BY ALL), n AS (SELECT g.graph_id, count(*) FILTER (WHERE kind = 'CodeEntity') AS e, count(*) FILTER (WHERE kind = 'Boundary') AS b, (SELECT count(*) FROM ge x WHERE x.graph_id = g.graph_id AND x.kind = 'calls') AS c, coalesce((SELECT flows FROM fl x WHERE x.graph_id = g.graph_id), 0) AS f, (SELECT count(*) FROM seed x WHERE x.repo_id = g.graph_id) AS s FROM gn g GROUP BY g.graph_id),
a AS ({_COV('entities', "CASE WHEN e > 0 THEN 'checked' ELSE 'partial' END", 'e', 'e')} UNION ALL {_COV('boundaries', "CASE WHEN b > 0 THEN 'checked' ELSE 'partial' END", 'b', 'e')} UNION ALL {_COV('call_graph', "CASE WHEN c > 0 THEN 'checked' ELSE 'partial' END", 'c', 'greatest(e, c)')} UNION ALL {_COV('data_flow', "CASE WHEN f > 0 THEN 'checked' WHEN s > 0 THEN 'partial' ELSE 'skipped' END", 'f', 'greatest(b, f, 1)')})
SELECT graph_id, area, 'joern' AS producer, state, covered, total, CASE WHEN state <> 'checked' THEN area || '{review.INCOMPLETE}' END AS reason FROM a""",
    "a16_observed_coverage": f"""WITH ro AS ({_SCANNED}), ob AS (SELECT repo_id, count(*) AS n FROM (SELECT repo_id FROM ({files.ORACLE_SQL['x11_workflow_names']}) UNION ALL SELECT repo_id FROM ({files.ORACLE_SQL['x16_x18_j12_infra_resources']})) GROUP BY repo_id),
a AS (SELECT ro.repo_id, 'ci_iac' AS area, 'ci-iac-context' AS producer, coalesce(n, 0) AS n FROM ro LEFT JOIN ob ON ob.repo_id = ro.repo_id UNION ALL SELECT repo_id, 'content_assets', 'content-resource-context', n_content FROM ro UNION ALL SELECT repo_id, 'smart_contracts', 'smart-contract-context', n_contracts FROM ro)
SELECT repo_id AS graph_id, area, producer, 'checked' AS state, n AS covered, n AS total, NULL AS reason FROM a""",
}
