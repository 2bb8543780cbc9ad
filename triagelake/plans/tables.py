"""Registered queries of tables that are written and read back, and of slices of programs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from triagelake.sources import programs, slices, tables
from triagelake.sources.shared import folder
from triagelake.streaming import events

from . import assessments as az
from .programs import _CONTEXT


def _at(s, name):
    return f"{folder(s)}/{name}-{uuid.uuid4().hex}"


def _artifacts(s, d):
    """Every document's text, stored twice."""
    path = _at(s, "artifacts")
    contents = s.read.parquet(f"{d}/documents.parquet").select(F.encode("text", "UTF-8").alias("content"))
    tables.store_artifacts(contents.where(F.length("content") < 3000), path)
    stored = tables.store_artifacts(contents, path)
    return tables.artifacts(s, path).select("sha256", "bytes").join(stored.select("sha256", "location"), "sha256")


def _graphs(s, d):
    """Nodes of all graphs, then those of two graphs again, without resources, then one graph by nothing."""
    path, nodes = _at(s, "graphs"), az.nodes(s, d).drop("evidence_ids")
    tables.replace_graphs({"nodes": nodes}, path)
    tables.replace_graphs({"nodes": nodes.where("graph_id IN ('g1', 'g2') AND kind <> 'Resource'")}, path)
    tables.replace_graphs({"nodes": nodes.where("false")}, path, s.createDataFrame([("g3",)], "graph string"))
    return tables.graph_table(s, path, "nodes").select("graph_id", "node_id", "kind")


def _history(s, d):
    path = _at(s, "history")
    rows = s.read.parquet(f"{d}/orders.parquet").selectExpr("'run' || (o_custkey % 50) AS run_id", "'stage' || (o_orderkey % 4) AS stage", "CAST(o_orderkey % 3 AS INT) AS attempt", "'done' AS status")
    tables.append_history(rows.where("attempt < 2"), path)
    tables.append_history(rows, path)
    return tables.history(s, path, rows.schema)


def _coverage(s, d):
    path = _at(s, "coverage")
    rows = s.read.parquet(f"{d}/part.parquet").selectExpr("'run' || (p_partkey % 6) AS run_id", "'area' || (p_partkey % 5) AS area", "'p' || (p_size % 3) AS producer", "'checked' AS state").distinct()
    tables.replace_coverage(rows, path)
    tables.replace_coverage(rows.where("run_id = 'run2' AND area <> 'area1'").withColumn("state", F.lit("partial")), path)
    tables.replace_coverage(rows.where("false"), path, s.createDataFrame([("run3",)], "run string"))
    return tables.coverage_of(s, path, "run1", "run2", "run3")


def _assessments(s, d):
    """One nested record for each repository, written as JSON and read back."""
    path = _at(s, "assessments")
    finding = F.struct(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("severity"), F.array(F.struct(F.concat(F.lit("a"), (F.col("o_orderkey") % 9).cast("string")).alias("filePath"), (F.col("o_orderkey") % 50).alias("startLine"))).alias("locations"))
    rows = s.read.parquet(f"{d}/orders.parquet").groupBy(F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("repo_id")).agg(F.array_sort(F.collect_list(finding)).alias("findings"), F.lit("not-ready-to-deploy").alias("verdict"))
    tables.write_assessments(rows, path, "run1")
    back = tables.read_assessments(s, path, "repo_id string, verdict string, findings array<struct<id string, severity string, locations array<struct<filePath string, startLine long>>>>", "run1")
    each = back.select("repo_id", "verdict", F.explode("findings").alias("f"))
    return each.select("repo_id", "verdict", F.col("f.id").alias("finding_id"), F.col("f.severity").alias("severity"), F.concat(F.col("f.locations")[0]["filePath"], F.lit(":"), F.col("f.locations")[0]["startLine"].cast("string")).alias("place"))


def _expectations(s, d):
    k = F.col("c_custkey")
    one = F.struct(F.concat(F.lit("x"), k.cast("string")).alias("id"), F.struct(F.concat(F.lit("https://h/"), F.col("c_name")).alias("originUrl")).alias("match"), (k % 9).alias("minFindings"))
    version = F.when(k % 7 == 0, 2).when(k % 7 < 6, 1)
    raw = F.when(k % 5 == 0, F.to_json(F.struct(version.alias("version"), F.lit("none").alias("repositories")))).otherwise(F.to_json(F.struct(version.alias("version"), F.array(one, one.withField("id", F.lit("y"))).alias("repositories"))))
    rows = s.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("file"), k.cast("string")).alias("file"), F.from_json(raw, tables.EXPECTATIONS).alias("x"))
    return tables.checked_expectations(rows.select("file", "x.version", "x.repositories"))


def _challenges(s, d):
    k = F.col("p_partkey")
    block = F.concat(F.lit("key: k"), k.cast("string"), F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("\n  name: '"), F.col("p_name"), F.lit("'"))), F.lit("\n  category: "), F.col("p_type"))
    rows = s.read.parquet(f"{d}/part.parquet").groupBy((k % 11).alias("g")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), block.alias("b")))), lambda x: x["b"]), "\n-\n").alias("text"))
    return tables.challenges(rows.select(F.concat(F.lit("file"), F.col("g").cast("string")).alias("file"), "text"))


def _files(s, d):
    return programs.entities(s, d).where("line % 4 > 0").select("repo_id", "path").distinct()


def _slices(s, d):
    """Entities as slices of JSON; calls of odd number are of another label."""
    rows = programs.entities(s, d)
    call = lambda c: F.struct(F.struct(c["name"].alias("name"), c["resolved"].alias("resolvedMethod"), c["code"].alias("code"), F.when(c["nth"] % 2 == 0, "CALL").otherwise("IDENTIFIER").alias("label"), c["line"].alias("lineNumber")).alias("targetObj"))
    slice_ = F.struct(F.when(F.col("line") % 13 > 0, F.col("full_name")).alias("fullName"), F.col("path").alias("fileName"), F.col("line").alias("lineNumber"), "boundary", F.transform("parameters", lambda p: F.struct(p["name"].alias("name"), p["type"].alias("typeFullName"))).alias("parameters"), F.transform("calls", call).alias("usages"))
    return rows.select("repo_id", F.to_json(F.struct(F.array(slice_).alias("objectSlices"))).alias("raw"))


def _entities(s, d):
    return slices.entities(_slices(s, d), _files(s, d)).select("repo_id", "full_name", "path", "line", F.col("boundary.route").alias("route"), F.array_join(F.transform("parameters", lambda p: p["name"]), ",").alias("parameters"), F.array_join(F.transform("calls", lambda c: F.coalesce(c["code"], F.lit("-"))), "|").alias("calls"))


def _seeds(s, d):
    k = F.col("line")
    flow = F.struct(F.when(k % 5 == 0, "IDENTIFIER").otherwise(slices.LABEL).alias("label"), F.when(k % 7 == 0, "other").otherwise("a,framework-input").alias("tags"), F.col("path").alias("parentFileName"), F.concat(F.lit("m"), k.cast("string")).alias("parentMethodName"), F.when(k % 3 == 0, "Cls").alias("parentClassName"), (k % 6).alias("lineNumber"), F.when(k % 2 == 0, "req").alias("name"), F.lit("req.body").alias("code"))
    raw = programs.entities(s, d).select("repo_id", F.to_json(F.array(F.struct(F.array(flow).alias("flows")))).alias("raw"))
    return slices.seeds(raw, _files(s, d))


def _usages(s, d):
    k = F.col("l_partkey")
    usage = F.struct(F.concat(F.lit("pkg"), (k % 50).cast("string")).alias("packageName"), F.concat(F.lit("src/"), (k % 20).cast("string"), F.lit(".js")).alias("repoPath"), F.when(k % 5 == 0, "seen").when(k % 2 == 0, "used").otherwise("imported").alias("usageKind"), F.struct((F.col("l_linenumber") - 1).alias("startLine"), F.when(k % 3 == 0, F.col("l_linenumber") + 2).alias("endLine")).alias("lineRange"))
    raw = s.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("repo"), (F.col("l_orderkey") % 5).cast("string")).alias("repo_id"), F.to_json(F.struct(F.array(usage).alias("componentUsages"))).alias("raw"))
    return slices.usages(raw)


def _lines(s, d):
    """Methods of customers, parameters and calls of orders, as rows of tabular text."""
    b64 = lambda c: F.base64(F.encode(c.cast("string"), "UTF-8"))
    row = lambda kind, *x: F.concat_ws("\t", F.lit(kind), *x).alias("line")
    method, path = F.concat(F.lit("m"), F.col("c_custkey").cast("string")), F.concat(F.lit("src/"), "c_mktsegment")
    methods = s.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("repo"), (F.col("c_custkey") % 5).cast("string")).alias("repo_id"), row("METHOD", b64(method), b64(path), (F.col("c_custkey") % 70 + 1).cast("string")))
    of = F.concat(F.lit("m"), F.col("o_custkey").cast("string"))
    orders, repo = s.read.parquet(f"{d}/orders.parquet"), F.concat(F.lit("repo"), (F.col("o_custkey") % 5).cast("string")).alias("repo_id")
    k = F.col("o_orderkey")
    calls = orders.select(repo, row("CALL", b64(of), b64(F.lit("src")), (k % 80).cast("string"), b64(F.concat(F.lit("call"), k.cast("string"))), b64(F.concat(F.lit("call("), "o_orderpriority", F.lit(")"))), F.concat(b64(F.lit("a")), F.lit(","), b64(k), F.lit(";"), b64(F.lit("b")), F.lit(","), b64(F.lit("é")), F.lit(";"))))
    params = orders.where(k % 3 == 0).select(repo, row("PARAM", b64(of), b64(F.lit("src")), (k % 4).cast("string"), b64(F.when(k % 2 == 0, "req").when(k % 5 == 0, "Body").otherwise("x")), b64(F.lit(""))))
    return methods.unionByName(calls).unionByName(params).unionByName(methods.select("repo_id", F.lit("COMMENT\tx").alias("line")))


def _assembled(s, d):
    out = slices.assembled(slices.rows_of(_lines(s, d)))
    return out.select("repo_id", "full_name", "path", "line", F.coalesce(F.array_join(F.transform("parameters", lambda p: p["name"]), ","), F.lit("")).alias("parameters"), F.coalesce(F.array_join(F.transform("calls", lambda c: F.concat(c["name"], F.lit(":"), c["code"])), "|"), F.lit("")).alias("calls"))


QUERIES = {
    "s25_artifacts": _artifacts, "s26_s27_graph_tables": _graphs, "s28_history": _history, "s29_coverage_table": _coverage, "s30_s31_assessments": _assessments, "s32_expectations": lambda s, d: _expectations(s, d).fillna(0, ["min_findings"]), "s33_challenges": _challenges,
    "s20_entities": _entities, "s21_flow_seeds": _seeds, "s22_usages": _usages, "s23_tabular_rows": lambda s, d: slices.rows_of(_lines(s, d)).select("repo_id", "record", "method", F.coalesce("number", F.lit(0)).cast("long").alias("number"), F.coalesce("name", F.lit("")).alias("name"), F.array_join("arguments", ";").alias("arguments")),
    "event_windows": lambda s, d: events.arrived(s, f"{d}/events.parquet", _at(s, "event-windows")).select(F.date_format("since", "yyyy-MM-dd HH").alias("since"), "event_type", "n", "cents"),
    "s24_request_seeds": lambda s, d: slices.request_seeds(slices.rows_of(_lines(s, d))), "s34_assembled": _assembled,
}
_KNOWN = "known AS (SELECT DISTINCT repo_id, path FROM ent WHERE line % 4 > 0)"
ORACLE_SQL = {
    "s25_artifacts": "SELECT DISTINCT sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS bytes, 'blobs/sha256/' || substr(sha256(text), 1, 2) || '/' || sha256(text) AS location FROM documents",
    "s26_s27_graph_tables": f"WITH {az._SQL['edges']}, {az._NODES} SELECT graph_id, node_id, kind FROM nodes WHERE graph_id NOT IN ('g1', 'g2', 'g3') OR (graph_id IN ('g1', 'g2') AND kind <> 'Resource')",
    "s28_history": "SELECT DISTINCT 'run' || (o_custkey % 50) AS run_id, 'stage' || (o_orderkey % 4) AS stage, (o_orderkey % 3)::INT AS attempt, 'done' AS status FROM orders",
    "s29_coverage_table": "WITH c AS (SELECT DISTINCT 'run' || (p_partkey % 6) AS run_id, 'area' || (p_partkey % 5) AS area, 'p' || (p_size % 3) AS producer FROM part) SELECT run_id, area, producer, CASE run_id WHEN 'run2' THEN 'partial' ELSE 'checked' END AS state FROM c WHERE run_id = 'run1' OR (run_id = 'run2' AND area <> 'area1')",
    "s30_s31_assessments": "SELECT 'r' || o_custkey AS repo_id, 'not-ready-to-deploy' AS verdict, 'f' || o_orderkey AS finding_id, o_orderpriority AS severity, 'a' || (o_orderkey % 9) || ':' || (o_orderkey % 50) AS place FROM orders",
    "s32_expectations": """WITH c AS (SELECT *, CASE WHEN c_custkey % 7 = 0 THEN 2 WHEN c_custkey % 7 < 6 THEN 1 END AS v FROM customer), e AS (SELECT 'file' || c_custkey AS file, CASE WHEN v IS DISTINCT FROM 1 THEN 'unsupported version ' || coalesce(v::VARCHAR, 'none') WHEN c_custkey % 5 = 0 THEN 'repositories is not a list' END AS error, * FROM c)
SELECT file, NULL::VARCHAR AS id, NULL::VARCHAR AS origin_url, NULL::VARCHAR AS local_path, 0::BIGINT AS min_findings, error FROM e WHERE error IS NOT NULL UNION ALL SELECT file, unnest(['x' || c_custkey, 'y']), 'https://h/' || c_name, NULL, c_custkey % 9, NULL FROM e WHERE error IS NULL""",
    "s33_challenges": "SELECT 'file' || (p_partkey % 11) AS file, (row_number() OVER (PARTITION BY p_partkey % 11 ORDER BY p_partkey) - 1)::INT AS nth, 'k' || p_partkey AS key, CASE WHEN p_partkey % 6 > 0 THEN p_name END AS name, p_type AS category, p_partkey % 6 > 0 AS complete FROM part",
    "s20_entities": f"""WITH {_CONTEXT}, {_KNOWN}, k2 AS (SELECT entity, string_agg(code, '|' ORDER BY rn) AS calls FROM (SELECT entity, code, nth AS rn FROM cal WHERE nth % 2 = 0) GROUP BY entity) SELECT c.repo_id, full_name, c.path, line::BIGINT AS line, CASE WHEN b_type IS NOT NULL THEN b_route END AS route, array_to_string(own, ',') AS parameters, coalesce(calls, '') AS calls FROM ctx c LEFT JOIN k2 USING (entity) WHERE line % 13 > 0 AND EXISTS (SELECT 1 FROM known k WHERE k.repo_id = c.repo_id AND k.path = c.path)""",
    "s21_flow_seeds": f"""WITH {programs.ENTITIES}, {_KNOWN} SELECT e.repo_id, CASE WHEN line % 3 = 0 THEN 'Cls:m' || line ELSE e.path || '::program:m' || line END AS full_name, e.path, (line % 6)::BIGINT AS line, CASE WHEN line % 2 = 0 THEN 'req' ELSE 'req.body' END AS source_name FROM ent e JOIN known k ON k.repo_id = e.repo_id AND k.path = e.path WHERE line % 5 > 0 AND line % 7 > 0 AND line % 6 > 0""",
    "s22_usages": "SELECT DISTINCT 'repo' || (l_orderkey % 5) AS repo_id, 'pkg' || (l_partkey % 50) AS package, 'src/' || (l_partkey % 20) || '.js' AS path, CASE WHEN l_partkey % 2 = 0 THEN 'used' ELSE 'imported' END AS kind, (l_linenumber - 1)::BIGINT AS line, CASE WHEN l_partkey % 3 = 0 THEN l_linenumber + 2 ELSE l_linenumber - 1 END::BIGINT AS end_line FROM lineitem WHERE l_partkey % 5 > 0 AND l_linenumber > 1",
    "s23_tabular_rows": """SELECT 'repo' || (c_custkey % 5) AS repo_id, 'METHOD' AS record, 'm' || c_custkey AS method, (c_custkey % 70 + 1)::BIGINT AS number, '' AS name, '' AS arguments FROM customer UNION ALL SELECT 'repo' || (o_custkey % 5), 'CALL', 'm' || o_custkey, o_orderkey % 80, 'call' || o_orderkey, 'a=' || o_orderkey || ';b=é' FROM orders
UNION ALL SELECT 'repo' || (o_custkey % 5), 'PARAM', 'm' || o_custkey, o_orderkey % 4, CASE WHEN o_orderkey % 2 = 0 THEN 'req' WHEN o_orderkey % 5 = 0 THEN 'Body' ELSE 'x' END, '' FROM orders WHERE o_orderkey % 3 = 0""",
    "s24_request_seeds": "SELECT 'repo' || (o_custkey % 5) AS repo_id, 'm' || o_custkey AS full_name, 'src/' || c_mktsegment AS path, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 ELSE c_custkey % 70 + 1 END::BIGINT AS line, CASE WHEN o_orderkey % 2 = 0 THEN 'req' ELSE 'Body' END AS source_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 = 0 AND (o_orderkey % 2 = 0 OR o_orderkey % 5 = 0)",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS since, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL",
    "s34_assembled": """WITH c AS (SELECT o_custkey, string_agg('call' || o_orderkey || ':call(' || o_orderpriority || ')', '|' ORDER BY o_orderkey % 80, 'call' || o_orderkey) AS calls FROM orders GROUP BY ALL), p AS (SELECT o_custkey, string_agg(n, ',' ORDER BY k, n) AS parameters FROM (SELECT o_custkey, o_orderkey % 4 AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'req' WHEN o_orderkey % 5 = 0 THEN 'Body' ELSE 'x' END AS n FROM orders WHERE o_orderkey % 3 = 0) GROUP BY ALL)
SELECT 'repo' || (c_custkey % 5) AS repo_id, 'm' || c_custkey AS full_name, 'src/' || c_mktsegment AS path, (c_custkey % 70 + 1)::BIGINT AS line, coalesce(parameters, '') AS parameters, coalesce(calls, '') AS calls FROM customer LEFT JOIN c ON c.o_custkey = c_custkey LEFT JOIN p ON p.o_custkey = c_custkey""",
}
