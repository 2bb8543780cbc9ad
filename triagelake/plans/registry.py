"""Registered queries over the given tables, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.functions import findings as fn
from triagelake.operators import findings as op
from triagelake.operators import graph, integrity
from triagelake.sources import corpus
from triagelake.sources.shared import once

from . import assessments, code, component_records, components, files, graphs, programs, quick, reports, review, routes, scores, tables, triage, composed
from .findings_sql import FILES as _FILES
from .findings_sql import FOUND as _FOUND
from .findings_sql import SEVERITY_RANK as _SEV

def _dedup(spark, d):
    return once(spark, "text-findings", d, lambda: op.deduplicated(op.candidates(spark, d)))


QUERIES = {
    "s01_corpus_files": lambda s, d: corpus.files(s, d),
    "s02_snapshot_hash": lambda s, d: corpus.snapshot_hash(corpus.files(s, d)),
    "s03_s04_exclusions": lambda s, d: corpus.exclusions(corpus.files(s, d)),
    "s03_running_total": lambda s, d: corpus.running_total(corpus.files(s, d)),
    "p01_language": lambda s, d: corpus.files(s, d).select("path", fn.language(F.col("path")).alias("language")),
    "p07_safe_path": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", fn.safe_relative(F.regexp_extract("url", r"://[^/]+/(.*)$", 1)).alias("safe")),
    "x01_candidates": lambda s, d: op.candidates(s, d).select("repo_id", "path", "line_no", "rule_id", "category", "severity"),
    "p10_p20_w01_findings": lambda s, d: _dedup(s, d).select("fingerprint", "repo_id", "path", "line_no", "rule_id", "severity", "snippet"),
    "p10_x01_secrets": lambda s, d: op.secrets(corpus.files(s, d, "text")),
    "a03_clusters": lambda s, d: op.clusters(_dedup(s, d)),
    "a04_w03_actions": lambda s, d: op.actions(_dedup(s, d)),
    "a05_summary": lambda s, d: _dedup(s, d).groupingSets([["severity"], ["category"], []], "severity", "category").agg(F.count("*").alias("n")),
    "a06_verdict": lambda s, d: op.verdicts(_dedup(s, d)),
    "a07_manifest_summary": lambda s, d: corpus.files(s, d).groupBy("repo_id").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes")),
    "v01_unique_keys": lambda s, d: integrity.repeated(s.read.parquet(f"{d}/labels.parquet").unionByName(s.read.parquet(f"{d}/labels.parquet").where("toxic = 1")), "doc_id"),
    "v02_dangling_references": lambda s, d: integrity.dangling(s.read.parquet(f"{d}/orders.parquet"), "o_custkey", s.read.parquet(f"{d}/customer.parquet").where("c_acctbal > 0"), "c_custkey"),
    "g11_flows": lambda s, d: graph.flows(*graph.trade_graph(s, d)),
    "g12_shortest_paths": lambda s, d: graph.distances(*graph.trade_graph(s, d)),
}
ORACLE_SQL = {
    "s01_corpus_files": f"WITH {_FILES} SELECT repo_id, path, size, sha256 FROM f",
    "s02_snapshot_hash": f"WITH {_FILES} SELECT repo_id, count(*) AS n_files, sha256(string_agg(path || chr(0) || sha256 || chr(0) || size || chr(10), '' ORDER BY path)) AS source_hash FROM f GROUP BY repo_id",
    "s03_running_total": f"WITH {_FILES} SELECT repo_id, path, sum(size) OVER (PARTITION BY repo_id ORDER BY path ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM f",
    "p01_language": f"WITH {_FILES} SELECT path, CASE doc_id % 7 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'java' END AS language FROM f",
    "p07_safe_path": r"WITH p AS (SELECT page_id, regexp_extract(url, '://[^/]+/(.*)$', 1) AS p FROM pages) SELECT page_id, p <> '' AND NOT contains(p, chr(0)) AND NOT contains(p, '\') AND NOT list_has_any(string_split(p, '/'), ['', '.', '..']) AS safe FROM p",
    "x01_candidates": f"WITH {_FOUND} SELECT repo_id, path, line_no, rule_id, category, severity FROM c",
    "p10_p20_w01_findings": f"WITH {_FOUND} SELECT fingerprint, repo_id, path, line_no, rule_id, severity, snippet FROM d",
    "a03_clusters": f"WITH {_FOUND} SELECT repo_id, category, rule_id, path, count(*) AS n_findings, arg_max(severity, {_SEV.format('severity')}) AS max_severity FROM d GROUP BY ALL",
    "a04_w03_actions": f"""WITH {_FOUND}, g AS (SELECT repo_id, rule_id, category, arg_max(severity, {_SEV.format('severity')}) AS severity, count(*) AS n_findings, count(DISTINCT path) AS n_files FROM d GROUP BY repo_id, rule_id, category),
h AS (SELECT *, CASE severity WHEN 'critical' THEN 100 WHEN 'high' THEN 80 WHEN 'medium' THEN 50 WHEN 'low' THEN 20 ELSE 10 END + CASE category WHEN 'secret' THEN 10 WHEN 'dependency' THEN 5 ELSE 0 END AS score,
CASE WHEN severity IN ('critical', 'high') THEN 'blocks-deploy' WHEN severity = 'medium' THEN 'degrades' ELSE 'informational' END AS impact FROM g)
SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, rule_id) AS rank FROM h""",
    "a05_summary": f"WITH {_FOUND} SELECT severity, category, count(*) AS n FROM d GROUP BY GROUPING SETS ((severity), (category), ())",
    "a06_verdict": f"WITH {_FOUND} SELECT repo_id, CASE WHEN max({_SEV.format('severity')}) = 4 THEN 'critical-fix-needed' ELSE 'not-ready' END AS verdict, count(*) AS n_findings FROM d GROUP BY repo_id",
    "a07_manifest_summary": f"WITH {_FILES} SELECT repo_id, count(*) AS n_files, sum(size)::BIGINT AS bytes FROM f GROUP BY repo_id",
    "v01_unique_keys": "SELECT doc_id AS record_id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY doc_id HAVING count(*) > 1",
    "v02_dangling_references": "SELECT o_custkey AS record_id, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey",
    "g11_flows": """WITH e AS (SELECT DISTINCT 'c' || o_custkey AS a, 'o' || o_orderkey AS b FROM orders UNION SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem)
SELECT x.a AS source, y.b AS sink, x.a || '>' || x.b || '>' || y.b AS path, 2 AS length FROM e x JOIN e y ON x.b = y.a WHERE x.a LIKE 'c%' AND y.b LIKE 'p%'""",
    "g12_shortest_paths": """WITH e AS (SELECT DISTINCT 'c' || o_custkey AS a, 'o' || o_orderkey AS b FROM orders UNION SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem),
s AS (SELECT DISTINCT a AS node FROM e WHERE a LIKE 'c%'), t AS (SELECT DISTINCT b AS node FROM e JOIN s ON e.a = s.node)
SELECT node, 0 AS distance FROM s UNION SELECT node, 1 FROM t UNION SELECT DISTINCT b, 2 FROM e JOIN t ON e.a = t.node""",
}

for _plan in (triage, code, files, reports, programs, graphs, assessments, scores, quick, tables, components, component_records, routes, composed, review):
    QUERIES |= _plan.QUERIES
    ORACLE_SQL |= _plan.ORACLE_SQL
