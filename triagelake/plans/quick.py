"""Registered queries of quick-scan results, over the candidates of three report shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.operators import correlation, quick
from triagelake.sources import reports as rp
from triagelake.sources.shared import once

from . import scores
from .reports import _FACT, _GOOD, TOOLS, _facts, _records

KINDS = {2: rp.actionlint, 3: rp.zizmor, 6: rp.sarif}


def _candidates(s, d):
    out = None
    for kind, adapter in KINDS.items():
        check = next(c for k, c, _ in TOOLS if k == kind)
        rows = adapter(_records(s, d, check)).drop("target", "item", "metadata").withColumn("stage_ord", F.lit(kind))
        report = F.lpad(F.floor(F.col("ord") / 100).cast("string"), 12, "0")  # records of a report are ordered by what they say
        rows = rows.withColumn("ord", F.concat_ws("-", report, F.coalesce("rule_id", F.lit("")), F.coalesce("message", F.lit("")), F.coalesce("line_no", F.lit(0)).cast("string"), F.coalesce("path", F.lit(""))))
        out = rows if out is None else out.unionByName(rows)
    return out


def _files(s, d):
    return _facts(s, d).where("kind <> 2 AND safe_path IS NOT NULL").select("repo_id", F.col("safe_path").alias("path")).distinct()


def _findings(s, d):
    return once(s, "quick-findings", d, lambda: quick.found(_candidates(s, d), _files(s, d)))


def _coverage(s, d):
    """One row for each order and check, by what the order's number says."""
    return s.read.parquet(f"{d}/orders.parquet").selectExpr("'repo' || (o_custkey % 40) AS repo_id", f"CASE o_orderkey % 7 {' '.join(f"WHEN {k} THEN '{c}'" for k, c, _ in TOOLS)} END AS check", "CASE o_orderkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'checked' END AS status", "CASE WHEN o_orderkey % 5 < 2 THEN 'why' || (o_orderkey % 3) END AS reason").where("repo_id <> 'repo30' OR status = 'checked'").distinct()


def _tools(s, d):
    return s.read.parquet(f"{d}/nation.parquet").selectExpr("'repo' || n_nationkey AS repo_id", "CASE n_regionkey WHEN 0 THEN 'trivy' WHEN 1 THEN 'syft' ELSE 'gitleaks' END AS tool", "n_nationkey % 2 = 0 AS stale")


def _repositories(s, d):
    return s.read.parquet(f"{d}/orders.parquet").selectExpr("'repo' || (o_custkey % 40) AS repo_id").distinct()


def _hypotheses(s, d):
    return s.read.parquet(f"{d}/supplier.parquet").selectExpr("'repo' || (s_suppkey % 45) AS repo_id", "CASE s_suppkey % 3 WHEN 0 THEN 'statically_supported' ELSE 'candidate' END AS status")


def _said(s, d):
    """Hypotheses whose reasons differ in places only."""
    rows = scores.table(s, d, "hypotheses")
    place = F.concat(F.lit("Path (src/a"), (F.col("ord") % 9).cast("string"), F.lit(".py:"), (F.col("ord") % 77).cast("string"), F.lit(") "), "reason")
    return rows.withColumns({"reason": place, "confidence": (F.col("ord") % 50) / 50.0, "supporting_evidence_ids": F.transform(F.sequence(F.lit(0), (F.col("ord") % 4).cast("int")), lambda k: F.concat(F.lit("v"), ((F.col("ord") + k * 3) % 40).cast("string")))})


def _evidence(s, d):
    return s.read.parquet(f"{d}/part.parquet").where("p_partkey < 36").selectExpr("'v' || p_partkey AS evidence_id", "'tool' || (p_partkey % 2) AS tool", "'a' || (p_partkey % 5) AS path", "CAST(p_partkey % 3 AS BIGINT) AS line")


def _labels(s, d):
    """Nodes with labels of every kind: plain, long, functions, content."""
    k = F.col("event_id")
    label = F.when(k % 5 == 0, F.concat(F.lit("function f"), k.cast("string"), F.lit("() {}"))).when(k % 5 == 1, F.repeat(F.concat("event_type", F.lit(" ")), 12)).when(k % 5 == 2, F.concat(F.lit("app.use(x) "), "event_type")).when(k % 5 == 3, F.concat("event_type", F.lit("\n  b"))).otherwise(F.concat(F.lit("  Order   "), "event_type"))
    route = F.when(k % 7 == 0, F.repeat(F.concat(F.lit("/"), "event_type"), 20))
    rows = s.read.parquet(f"{d}/events.parquet")
    return rows.select("event_id", label.alias("label"), F.when(k % 3 > 0, F.concat(F.lit("src/"), "event_type")).alias("path"), F.when(k % 3 > 0, k % 90).alias("line"), F.create_map(F.lit("resourceType"), F.when(k % 7 < 2, "content_resource").otherwise("file"), F.lit("route"), route).alias("properties"))


def _plain(s, d):
    rows = _labels(s, d)
    return rows.select("event_id", correlation.plain_label({c: F.col(c) for c in ("label", "path", "line", "properties")}).alias("shown"))


_J = lambda *c: [F.array_join(x, ",").alias(x) for x in c]
QUERIES = {
    "j01_found": lambda s, d: _findings(s, d).drop("at"),
    "j01_outside": lambda s, d: quick.outside(_candidates(s, d), _files(s, d)),
    "a03_finding_clusters": lambda s, d: quick.clusters(_findings(s, d)).select("repo_id", "cluster_id", "category", "path", *_J("finding_ids"), "max_severity"),
    "a04_p16_actions": lambda s, d: quick.actions(_findings(s, d)).select("repo_id", "action_id", "remediation_key", "score", "severity", *_J("finding_ids", "evidence_ids", "files", "rules"), "impact", "place", "rank"),
    "a08_locations": lambda s, d: quick.locations(quick.actions(f := _findings(s, d)), f),
    "g23_remediations": lambda s, d: quick.remediations(quick.actions(_findings(s, d))),
    "j02_evidence": lambda s, d: quick.with_evidence((f := _findings(s, d)).select("repo_id", "finding_id", F.array("evidence_id").alias("evidence_ids")), f.select("repo_id", "evidence_id", "tool", "path", "line", "snippet")),
    "j04_stale_tools": lambda s, d: quick.stale(_coverage(s, d), _tools(s, d)),
    "a06_verdicts": lambda s, d: quick.verdicts(_repositories(s, d), _findings(s, d), _coverage(s, d), _hypotheses(s, d)),
    "a20_limitations": lambda s, d: quick.limitations(_coverage(s, d).withColumnsRenamed({"check": "area", "status": "state"})),
    "p12_personal": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(quick.without_personal(F.col("text")), 256).alias("masked")),
    "p21_p22_labels": _plain,
    "p33_repositories": lambda s, d: quick.repository(s.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey AS repo_id", "CASE c_custkey % 2 WHEN 0 THEN 'github' ELSE 'local' END AS kind", "'https://host/org/' || c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN '.git' ELSE '' END AS url", "'/home/x/' || c_mktsegment || c_nationkey AS path", "CASE WHEN c_custkey % 5 = 0 THEN 'git@h:' || c_custkey END AS origin_url", "CASE WHEN c_custkey % 7 = 0 THEN 'm' || c_custkey END AS manifest_origin", "CASE WHEN c_custkey % 4 > 0 THEN 'c' || c_custkey END AS commit")),
    "w09_attack_paths": lambda s, d: quick.attack_paths(_said(s, d)).select("repo_id", "hypothesis_id", "family", "reason"),
    "w13_signals": lambda s, d: quick.signals(_said(s, d), _evidence_of(s, d)),
    "a14_a16_coverage": lambda s, d: quick.replaced(_areas(s, d), _counted(s, d)),
}


def _evidence_of(s, d):
    """The evidence that each repository's hypotheses ask for."""
    asked = _said(s, d).select("repo_id", F.explode("supporting_evidence_ids").alias("evidence_id")).distinct()
    return asked.join(_evidence(s, d), "evidence_id")


def _areas(s, d):
    return s.read.parquet(f"{d}/nation.parquet").selectExpr("'repo' || (n_nationkey % 5) AS graph_id", "CASE n_regionkey WHEN 0 THEN 'entities' WHEN 1 THEN 'boundaries' ELSE 'data_flow' END AS area", "'code' AS producer", "'partial' AS state", "CAST(0 AS BIGINT) AS covered", "CAST(n_nationkey AS BIGINT) AS total").groupBy("graph_id", "area", "producer", "state", "covered").agg(F.max("total").alias("total"))


def _counted(s, d):
    """Coverage of a graph: entities, boundaries and the flows between them, counted from parts."""
    k = F.col("p_partkey")
    rows = s.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("repo"), (k % 4).cast("string")).alias("graph_id"), "p_size")
    counts = rows.groupBy("graph_id").agg(F.count("*").alias("entities"), F.count_if(F.col("p_size") > 10).alias("boundaries"))
    areas = F.array(*(F.struct(F.lit(a).alias("area"), have.alias("covered"), of.alias("total")) for a, have, of in (("entities", F.col("entities"), F.col("entities")), ("boundaries", F.col("boundaries"), F.greatest("boundaries", F.lit(1).cast("long"))))))
    each = counts.select("graph_id", F.explode(areas).alias("x")).select("graph_id", "x.*")
    return each.select("graph_id", "area", F.lit("code").alias("producer"), F.when(F.col("covered") >= F.col("total"), "checked").otherwise("partial").alias("state"), "covered", "total")


_CASES = lambda table: " ".join(f"WHEN {k} THEN '{c}'" for k, c, _ in table)
_FOUND = f"""{_FACT}, {_GOOD}, known AS (SELECT DISTINCT repo_id, safe_path AS path FROM fact WHERE kind <> 2 AND safe_path IS NOT NULL),
cand AS (SELECT *, CASE kind {' '.join(f"WHEN {k} THEN '{t}'" for k, _, t in TOOLS)} END AS tool, CASE WHEN kind = 2 THEN NULL ELSE severity END AS sev FROM good WHERE kind IN (2, 3, 6) AND safe_path IS NOT NULL),
f0 AS (SELECT c.repo_id, kind, concat_ws('-', lpad(report_id::VARCHAR, 12, '0'), coalesce(rule, ''), coalesce(message, ''), coalesce(line_no, 0), c.safe_path) AS ord, tool, coalesce(rule, tool || '-finding') AS rule_id, CASE WHEN kind = 6 THEN 'code-pattern' ELSE 'github-action' END AS category, c.safe_path AS path, CASE WHEN line_no > 0 THEN line_no ELSE 1 END::BIGINT AS line, message, lower(sev) AS sev FROM cand c JOIN known k ON k.repo_id = c.repo_id AND k.path = c.safe_path),
f1 AS (SELECT *, rule_id || ': ' || coalesce(message, tool || ' reported ' || rule_id) AS snippet, CASE sev WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'high' WHEN 'low' THEN 'low' WHEN 'medium' THEN 'medium' ELSE CASE category WHEN 'github-action' THEN 'medium' ELSE 'unknown' END END AS severity FROM f0),
f2 AS (SELECT *, substr(sha256(tool || chr(0) || rule_id || chr(0) || path || chr(0) || line || chr(0) || sha256(snippet)), 1, 16) AS h FROM f1),
fnd AS (SELECT *, 'finding_' || substr(sha256('fp_' || h), 1, 16) AS finding_id, 'ev_' || h AS evidence_id, 'fp_' || h AS fingerprint, CASE category WHEN 'github-action' THEN 'github-actions-hardening' ELSE 'code-pattern-review' END AS remediation_key, kind || '-' || ord AS at_ FROM f2 QUALIFY row_number() OVER (PARTITION BY repo_id, h ORDER BY kind, ord) = 1)"""
_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_SCORE = "CASE severity WHEN 'critical' THEN 100 WHEN 'high' THEN 80 WHEN 'medium' THEN 50 WHEN 'low' THEN 20 ELSE 10 END"
_ORD = lambda c: f"list({c} ORDER BY at_)"
_UNIQ = lambda c: f"list_filter({_ORD(c)}, lambda x, i: list_position({_ORD(c)}, x) = i)"
_ACTIONS = f"""{_FOUND}, g AS (SELECT repo_id, remediation_key, 'action_' || substr(sha256(array_to_string(list_sort(list(fingerprint)), chr(0))), 1, 16) AS action_id, arg_max(severity, {_RANK}) AS severity, {_ORD('finding_id')} AS finding_ids, {_ORD('evidence_id')} AS evs, {_ORD('path')} AS ps, {_ORD('rule_id')} AS rs, arg_min(path || ':' || line, at_) AS place FROM fnd GROUP BY repo_id, remediation_key),
act AS (SELECT repo_id, action_id, remediation_key, {_SCORE} AS score, severity, finding_ids, list_filter(evs, lambda x, i: list_position(evs, x) = i) AS evidence_ids, list_filter(ps, lambda x, i: list_position(ps, x) = i) AS files, list_filter(rs, lambda x, i: list_position(rs, x) = i) AS rules, CASE WHEN severity IN ('critical', 'high') THEN 'blocks-deploy' WHEN severity = 'medium' THEN 'degrades' ELSE 'informational' END AS impact, place FROM g)"""
_COVER = f"""cov AS (SELECT DISTINCT 'repo' || (o_custkey % 40) AS repo_id, CASE o_orderkey % 7 {_CASES(TOOLS)} END AS "check", CASE o_orderkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'checked' END AS status, CASE WHEN o_orderkey % 5 < 2 THEN 'why' || (o_orderkey % 3) END AS reason FROM orders WHERE o_custkey % 40 <> 30 OR o_orderkey % 5 > 1)"""
_TXT = lambda k: f"CASE remediation_key {' '.join(f"WHEN '{n}' THEN '{t[k].replace(chr(39), chr(39) * 2)}'" for n, t in quick.TEXTS.items() if n)} ELSE '{quick.TEXTS[''][k]}' END"
_SAID = f"""{scores._SQL['hypotheses']}, said AS (SELECT * EXCLUDE (reason), 'Path (src/a' || (ord % 9) || '.py:' || (ord % 77) || ') ' || reason AS reason, (ord % 50) / 50.0 AS confidence FROM hypotheses)"""
_LAB = """lab AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'function f' || event_id || '() {}' WHEN 1 THEN repeat(event_type || ' ', 12) WHEN 2 THEN 'app.use(x) ' || event_type WHEN 3 THEN event_type || chr(10) || '  b' ELSE '  Order   ' || event_type END AS label,
  CASE WHEN event_id % 3 > 0 THEN 'src/' || event_type || ':' || (event_id % 90) END AS spot, CASE WHEN event_id % 7 = 0 THEN repeat('/' || event_type, 20) END AS route, event_id % 7 < 2 AS content FROM events), t AS (SELECT *, trim(regexp_replace(label, '\\s+', ' ', 'g')) AS x, trim(regexp_replace(coalesce(route, label), '\\s+', ' ', 'g')) AS y FROM lab)"""
ORACLE_SQL = {
    "j01_found": f"WITH {_FOUND} SELECT repo_id, finding_id, tool, rule_id, category, severity, path, line, snippet, evidence_id, fingerprint, remediation_key FROM fnd",
    "j01_outside": f"WITH {_FOUND} SELECT DISTINCT repo_id, tool, safe_path AS path FROM cand c WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.repo_id = c.repo_id AND k.path = c.safe_path)",
    "a03_finding_clusters": f"WITH {_FOUND} SELECT repo_id, 'cluster_' || substr(sha256(category || chr(0) || remediation_key || chr(0) || path), 1, 16) AS cluster_id, category, path, array_to_string({_ORD('finding_id')}, ',') AS finding_ids, arg_max(severity, {_RANK}) AS max_severity FROM fnd GROUP BY repo_id, category, remediation_key, path",
    "a04_p16_actions": f"WITH {_ACTIONS} SELECT repo_id, action_id, remediation_key, score, severity, array_to_string(finding_ids, ',') AS finding_ids, array_to_string(evidence_ids, ',') AS evidence_ids, array_to_string(files, ',') AS files, array_to_string(rules, ',') AS rules, impact, place, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, remediation_key) AS rank FROM act",
    "a08_locations": f"WITH {_ACTIONS}, e AS (SELECT a.repo_id, a.action_id, i AS ord, a.finding_ids[i] AS f FROM act a, unnest(range(1, len(a.finding_ids) + 1)) AS u(i)), p AS (SELECT e.repo_id, e.action_id, path || ':' || line AS place, min(e.ord) AS ord FROM e JOIN fnd ON fnd.repo_id = e.repo_id AND fnd.finding_id = e.f GROUP BY ALL) SELECT repo_id, action_id, row_number() OVER (PARTITION BY repo_id, action_id ORDER BY ord) AS nth, place FROM p",
    "g23_remediations": f"WITH {_ACTIONS} SELECT repo_id, action_id, {_TXT(0)} AS title, {_TXT(1)} AS risk, {_TXT(2)} || place || '.' AS first_step, {_TXT(0)} || ' at ' || place || ' (detected rule: ' || array_to_string(rules, ', ') || ').' || chr(10) || {_TXT(3)} AS prompt, {_TXT(4)} || ' {quick._AGAIN}' AS checks FROM act",
    "j02_evidence": f"WITH {_FOUND} SELECT f.repo_id, f.finding_id, f.evidence_id, e.tool, e.path || ':' || e.line AS place, e.snippet FROM fnd f JOIN fnd e ON e.repo_id = f.repo_id AND e.evidence_id = f.evidence_id",
    "j04_stale_tools": f"""WITH {_COVER}, st AS (SELECT DISTINCT 'repo' || n_nationkey AS repo_id, CASE n_regionkey WHEN 0 THEN 'trivy' WHEN 1 THEN 'syft' ELSE 'gitleaks' END AS tool FROM nation WHERE n_nationkey % 2 = 0), m AS (SELECT cov.*, CASE "check" {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in quick.CHECK_TOOLS.items())} END AS tool FROM cov)
SELECT m.repo_id, "check", CASE WHEN status = 'checked' AND st.tool IS NOT NULL THEN 'degraded' ELSE status END AS status, CASE WHEN status = 'checked' AND st.tool IS NOT NULL THEN m.tool || ' database freshness is stale; refresh failed before scan' ELSE reason END AS reason FROM m LEFT JOIN st ON st.repo_id = m.repo_id AND st.tool = m.tool""",
    "a06_verdicts": f"""WITH {_FOUND}, {_COVER}, hyp AS (SELECT DISTINCT 'repo' || (s_suppkey % 45) AS repo_id FROM supplier WHERE s_suppkey % 3 = 0), r AS (SELECT DISTINCT 'repo' || (o_custkey % 40) AS repo_id FROM orders)
SELECT repo_id, CASE WHEN repo_id IN (SELECT repo_id FROM hyp) THEN 'not-ready-to-deploy' WHEN repo_id IN (SELECT repo_id FROM fnd WHERE severity = 'critical') THEN 'critical-fix-needed' WHEN repo_id IN (SELECT repo_id FROM fnd) THEN 'not-ready-to-deploy' WHEN repo_id IN (SELECT repo_id FROM cov WHERE status IN ('failed', 'degraded')) THEN 'scan-incomplete' ELSE 'looks-ok-for-now' END AS verdict FROM r""",
    "a20_limitations": f"""WITH {_COVER} SELECT repo_id, 'Deep Static ' || "check" || ' coverage is ' || status || coalesce(': ' || reason, '.') AS text FROM cov WHERE status <> 'checked'""",
    "p12_personal": f"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '{quick.PERSONAL[0][0]}', '***REDACTED***', 'g'), '{quick.PERSONAL[1][0]}', '***REDACTED***', 'g'), '{quick.PERSONAL[2][0].replace("'", "''")}', '\\1***REDACTED***', 'g')) AS masked FROM documents""",
    "p21_p22_labels": f"""WITH {_LAB} SELECT event_id, CASE WHEN content THEN CASE WHEN length(y) > 120 THEN rtrim(substr(y, 1, 117)) || '...' ELSE y END || coalesce(' (' || spot || ')', '') WHEN contains(label, chr(10)) OR length(x) > 80 OR regexp_matches(x, '^(async )?function |^app\\.use\\(|=>') THEN coalesce(spot, substr(x, 1, 80)) WHEN spot IS NULL OR contains(x, spot) THEN x ELSE x || ' (' || spot || ')' END AS shown FROM t""",
    "p33_repositories": """SELECT c_custkey AS repo_id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_mktsegment || c_nationkey END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'https://host/org/' || c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN '.git' ELSE '' END WHEN c_custkey % 5 = 0 THEN 'git@h:' || c_custkey WHEN c_custkey % 7 = 0 THEN 'm' || c_custkey END AS origin_url,
CASE WHEN c_custkey % 2 = 1 THEN '/home/x/' || c_mktsegment || c_nationkey END AS local_path, CASE WHEN c_custkey % 4 > 0 THEN 'c' || c_custkey END AS "commit" FROM customer""",
    "w09_attack_paths": f"WITH {_SAID} SELECT repo_id, hypothesis_id, family, reason FROM said WHERE status <> 'statically_contradicted' QUALIFY row_number() OVER (PARTITION BY repo_id, family, regexp_replace(reason, '\\s\\([^()\\n]+:\\d+\\)', '', 'g') ORDER BY confidence DESC, title, hypothesis_id) = 1",
    "w13_signals": f"""WITH {_SAID}, e AS (SELECT repo_id, hypothesis_id, k AS ord, (ord + k * 3) % 40 AS p FROM said, unnest(range(0, 4)) AS u(k) WHERE k <= ord % 4), p AS (SELECT repo_id, hypothesis_id, 'tool' || (p % 2) AS tool, 'a' || (p % 5) || ':' || (p % 3) AS place, min(ord) AS ord FROM e WHERE p < 36 AND p IN (SELECT p_partkey FROM part) GROUP BY ALL)
SELECT repo_id, hypothesis_id, row_number() OVER (PARTITION BY repo_id, hypothesis_id ORDER BY ord) AS nth, tool, place FROM p""",
    "a14_a16_coverage": """WITH a AS (SELECT 'repo' || (n_nationkey % 5) AS graph_id, CASE n_regionkey WHEN 0 THEN 'entities' WHEN 1 THEN 'boundaries' ELSE 'data_flow' END AS area, max(n_nationkey)::BIGINT AS total FROM nation GROUP BY ALL), c AS (SELECT 'repo' || (p_partkey % 4) AS graph_id, count(*) AS e, count(*) FILTER (WHERE p_size > 10) AS b FROM part GROUP BY ALL),
n AS (SELECT graph_id, 'entities' AS area, e AS covered, e AS total FROM c UNION ALL SELECT graph_id, 'boundaries', b, greatest(b, 1) FROM c)
SELECT graph_id, area, 'code' AS producer, 'partial' AS state, 0::BIGINT AS covered, total FROM a WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.graph_id = a.graph_id AND n.area = a.area) UNION ALL SELECT graph_id, area, 'code', CASE WHEN covered >= total THEN 'checked' ELSE 'partial' END, covered, total FROM n""",
}
