"""Registered queries of reports, coverage, hypotheses and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.functions import texts
from triagelake.functions import findings as fn
from triagelake.operators import coverage, hypotheses, integrity, scoring
from triagelake.operators import findings as op
from triagelake.sources import scanners

from .findings_sql import FOUND


def _table(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def reports(s, d):
    """What the rules find in each document, as a report of one of three shapes; one in thirteen is cut short."""
    found = op.candidates(s, d).where("rule_id <> 'email'")
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line_no").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), F.col("severity").alias("level"), F.struct(F.col("line").alias("text")).alias("message"), F.array(place).alias("locations"))
    secret = F.struct(F.col("rule_id").alias("RuleID"), F.col("path").alias("File"), F.col("line_no").alias("StartLine"), F.col("rule_id").alias("Secret"), F.concat(F.lit("<"), "rule_id", F.lit(">")).alias("Match"))
    each = found.groupBy("repo_id", "doc_id").agg(F.collect_list(result).alias("results"), F.collect_list(secret).alias("secrets"))
    raw = F.when(F.col("doc_id") % 3 == 0, F.to_json("secrets")).otherwise(F.to_json(F.struct(F.array(F.struct("results")).alias("runs"))))
    raw = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit('{"runs": '), F.substring(raw, 1, 5))).when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Report:\n```json\n"), raw, F.lit("\n```"))).otherwise(raw)
    return each.select("repo_id", raw.alias("raw"))


def _coverage(s, d):
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    state = F.when(status == "F", "checked").when(status == "P", "partial").when(F.col("o_totalprice") > 200000, "failed").otherwise("degraded")
    reason = F.when(status != "F", F.concat(F.lit("status "), status, F.lit(" "), F.year("o_orderdate")))
    return _table(s, d, "orders").select(F.col("o_orderpriority").alias("area"), F.concat(F.lit("p"), F.col("o_custkey") % 7).alias("producer"), k.alias("ord"), state.alias("state"), F.when(k % 3 == 0, F.col("o_custkey")).alias("covered"), F.when(k % 3 == 0, F.col("o_custkey") + 1).alias("total"), reason.alias("reason"))


def _hypotheses(s, d):
    """Customer, order, part as a path of two edges; a returned item contradicts it, a large one is a finding."""
    items = _table(s, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max(F.col("l_returnflag") == "R").alias("contradicted"), F.sum((F.col("l_quantity") >= 45).cast("int")).alias("n_findings"))
    orders = _table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.when(F.col("o_orderstatus") == "F", "checked").when(F.col("o_orderstatus") == "P", "partial").otherwise("failed").alias("coverage"))
    joined = items.join(orders, "l_orderkey").select("o_custkey", "l_orderkey", "l_partkey", "contradicted", "n_findings", "coverage", F.lit(2).alias("n_edges"), F.lit(3).alias("n_nodes"))
    return hypotheses.judged(joined)


def _truth(s, d):
    docs = _table(s, d, "documents").select("doc_id", F.col("lang").alias("language"), F.col("source").alias("family"), F.col("text").rlike("[A-Z]{4,}!!").alias("found"))
    return docs.join(_table(s, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("truth")), "doc_id").withColumn("split", F.col("doc_id") % 2)


def _turns(s, d):
    """Turns whose next turn is not the other role's: the end of an edge is the start of the next."""
    t = _table(s, d, "conversations")
    ends = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.when(F.col("role") == "user", "assistant").otherwise("user").alias("ends"))
    return ends.join(t.select("conv_id", "turn", "role"), ["conv_id", "turn"]).where("ends <> role").select("conv_id", "turn", "role")


def _ranges(s, d):
    bad = F.array(*(F.when(~ok, name) for name, ok in (("discount", F.col("l_discount").between(0, 0.08)), ("quantity", F.col("l_quantity") > 1), ("returnflag", F.col("l_returnflag").isin("A", "N")))))
    return _table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.explode(F.filter(bad, lambda x: x.isNotNull())).alias("violation"))


def _findings(s, d):
    return op.deduplicated(op.candidates(s, d))


QUERIES = {
    "s05_s07_s08_report_records": lambda s, d: scanners.records(reports(s, d)),
    "p13_safe_text": lambda s, d: _table(s, d, "conversations").select("conv_id", "turn", texts.safe(F.col("text")).alias("safe")),
    "p14_truncated": lambda s, d: _table(s, d, "documents").select("doc_id", texts.truncated(F.col("text")).alias("text")),
    "p21_plain_text": lambda s, d: _table(s, d, "documents").select("doc_id", F.sha2(texts.plain(F.col("text")), 256).alias("plain_sha256")),
    "p27_p32_repositories": lambda s, d: _table(s, d, "pages").groupBy(texts.remote(F.col("url")).alias("origin"), texts.repository_name(F.col("url")).alias("name")).agg(F.count("*").alias("n_pages")),
    "a11_coverage_merge": lambda s, d: coverage.merged(_coverage(s, d)),
    "g17_g18_hypotheses": lambda s, d: _hypotheses(s, d).select("o_custkey", "l_orderkey", "l_partkey", "status", "confidence"),
    "w07_hypothesis_ranking": lambda s, d: hypotheses.first(_hypotheses(s, d), ["o_custkey"], [F.desc("confidence"), F.col("l_orderkey"), F.col("l_partkey")], 5).select("o_custkey", "nth", "l_orderkey", "l_partkey", "confidence"),
    "w04_limit_per_rule": lambda s, d: hypotheses.first(_findings(s, d), ["rule_id"], [F.col("path"), F.col("line_no"), F.col("fingerprint")], 25).select("rule_id", "nth", "path", "line_no"),
    "w05_top_values": lambda s, d: hypotheses.first(_findings(s, d).groupBy("repo_id", "path").agg(F.count("*").alias("n")), ["repo_id"], [F.desc("n"), F.col("path")], 12),
    "w06_top_findings": lambda s, d: hypotheses.first(_findings(s, d), ["repo_id", "category"], [fn.severity_rank(F.col("severity")).desc(), F.col("rule_id"), F.col("path"), F.col("line_no"), F.col("fingerprint")], 10).select("repo_id", "category", "nth", "rule_id", "path", "line_no"),
    "w11_latest_attempt": lambda s, d: hypotheses.latest(_table(s, d, "events"), ["user_id", "event_type"], "event_id", "value"),
    "a22_hidden_counts": lambda s, d: _findings(s, d).groupBy("repo_id", "rule_id").agg(F.count("*").alias("total")).withColumn("included", F.least("total", F.lit(10))).withColumn("omitted", F.col("total") - F.col("included")),
    "v03_connectivity": _turns,
    "v04_ranges": _ranges,
    "b04_b07_scores": lambda s, d: scoring.measured(scoring.rolled_up(_truth(s, d))),
    "b08_gates": lambda s, d: scoring.gates(scoring.measured(scoring.rolled_up(_truth(s, d)))),
    "b09_gap": lambda s, d: scoring.gap(scoring.measured(scoring.rolled_up(_truth(s, d), ["split"])), "split"),
}

_H = """h AS (SELECT o_custkey, l_orderkey, l_partkey, CASE WHEN bad THEN 'statically_contradicted' WHEN o_orderstatus <> 'F' THEN 'inconclusive' ELSE 'statically_supported' END AS status,
CASE WHEN bad THEN 1000 WHEN o_orderstatus = 'P' THEN 2500 WHEN o_orderstatus <> 'F' THEN 1500 ELSE least(9500, 7800 + 400 * n) END / 10000.0::DOUBLE AS confidence
FROM (SELECT l_orderkey, l_partkey, bool_or(l_returnflag = 'R') AS bad, count(*) FILTER (l_quantity >= 45) AS n FROM lineitem GROUP BY ALL) JOIN orders ON o_orderkey = l_orderkey)"""
_M = """t AS (SELECT lang, source, doc_id % 2 AS split, toxic = 1 AS truth, regexp_matches(text, '[A-Z]{{4,}}!!') AS found FROM documents JOIN labels USING (doc_id)),
k AS (SELECT 'all' AS key, * FROM t UNION ALL SELECT 'language:' || coalesce(lang, 'none'), * FROM t UNION ALL SELECT 'family:' || coalesce(source, 'none'), * FROM t),
c AS (SELECT key{0}, count(*) FILTER (truth AND found) AS tp, count(*) FILTER (NOT truth AND found) AS fp, count(*) FILTER (truth AND NOT found) AS fn FROM k GROUP BY ALL),
p AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM c),
m AS (SELECT *, CASE WHEN 0.25 * precision + recall = 0 THEN 0 ELSE 1.25::DOUBLE * precision * recall / (0.25::DOUBLE * precision + recall) END AS f_half FROM p)"""
ORACLE_SQL = {
    "s05_s07_s08_report_records": f"""WITH {FOUND}, e AS (SELECT * FROM c WHERE rule_id <> 'email')
SELECT repo_id, CASE WHEN doc_id % 3 = 0 THEN 'secrets' ELSE 'sarif' END AS tool, rule_id, CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE severity END AS severity, path, line_no, CASE WHEN doc_id % 3 = 0 THEN '<[REDACTED]>' ELSE line END AS message FROM e WHERE doc_id % 13 <> 0
UNION ALL SELECT DISTINCT ON (doc_id) repo_id, 'failed', NULL, NULL, NULL, NULL, NULL FROM e WHERE doc_id % 13 = 0""",
    "p13_safe_text": r"""SELECT conv_id, turn, NOT regexp_matches(text, '(^|[ \t\r\n"''`(])(/(tmp|work|Users|home|root|etc|var)\b|[A-Za-z]:\\|\.\.)') AND NOT regexp_matches(text, '(?i)\b(confirmed|exploited|proved|proven)\b') AS safe FROM conversations""",
    "p14_truncated": "SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '... [truncated]' ELSE text END AS text FROM documents",
    "p21_plain_text": r"SELECT doc_id, sha256(trim(regexp_replace(lower(regexp_replace(text, '\([^() ]+:[0-9]+\)', '', 'g')), '[ \t\r\n]+', ' ', 'g'))) AS plain_sha256 FROM documents",
    "p27_p32_repositories": r"WITH o AS (SELECT regexp_replace(regexp_replace(regexp_replace(trim(url), '^git@([^:]+):(.+)$', 'https://\1/\2'), '/+$', ''), '\.git$', '') AS origin FROM pages) SELECT origin, regexp_extract(origin, '([^/]*)$', 1) AS name, count(*) AS n_pages FROM o GROUP BY ALL",
    "a11_coverage_merge": """WITH r AS (SELECT o_orderpriority AS area, 'p' || (o_custkey % 7) AS producer, o_orderkey AS ord, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'P' THEN 3 WHEN o_totalprice > 200000 THEN 5 ELSE 4 END AS rank,
CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS covered, CASE WHEN o_orderstatus <> 'F' THEN 'status ' || o_orderstatus || ' ' || year(o_orderdate) END AS reason FROM orders),
w AS (SELECT area, producer, (['checked', 'skipped', 'partial', 'degraded', 'failed'])[max(rank)] AS state, arg_max(covered, ord) FILTER (covered IS NOT NULL) AS covered FROM r GROUP BY ALL),
d AS (SELECT area, producer, string_agg(reason, '; ' ORDER BY since) AS reason FROM (SELECT area, producer, reason, min(ord) AS since FROM r WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY ALL)
SELECT area, producer, state, covered, covered + 1 AS total, coalesce(reason, '') AS reason FROM w LEFT JOIN d USING (area, producer)""",
    "g17_g18_hypotheses": f"WITH {_H} SELECT * FROM h",
    "w07_hypothesis_ranking": f"WITH {_H} SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY confidence DESC, l_orderkey, l_partkey)::INT AS nth, l_orderkey, l_partkey, confidence FROM h QUALIFY nth <= 5",
    "w04_limit_per_rule": f"WITH {FOUND} SELECT rule_id, row_number() OVER (PARTITION BY rule_id ORDER BY path, line_no, fingerprint)::INT AS nth, path, line_no FROM d QUALIFY nth <= 25",
    "w05_top_values": f"WITH {FOUND}, n AS (SELECT repo_id, path, count(*) AS n FROM d GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, path)::INT AS nth FROM n QUALIFY nth <= 12",
    "w06_top_findings": f"WITH {FOUND} SELECT repo_id, category, row_number() OVER (PARTITION BY repo_id, category ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, rule_id, path, line_no, fingerprint)::INT AS nth, rule_id, path, line_no FROM d QUALIFY nth <= 10",
    "w11_latest_attempt": "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL",
    "a22_hidden_counts": f"WITH {FOUND}, n AS (SELECT repo_id, rule_id, count(*) AS total FROM d GROUP BY ALL) SELECT *, least(total, 10) AS included, total - least(total, 10) AS omitted FROM n",
    "v03_connectivity": "SELECT b.conv_id, b.turn, b.role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn WHERE CASE WHEN a.role = 'user' THEN 'assistant' ELSE 'user' END <> b.role",
    "v04_ranges": """SELECT l_orderkey, l_linenumber, l_partkey, 'discount' AS violation FROM lineitem WHERE l_discount NOT BETWEEN 0 AND 0.08 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'quantity' FROM lineitem WHERE l_quantity <= 1
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'returnflag' FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')""",
    "b04_b07_scores": f"WITH {_M.format('')} SELECT * FROM m",
    "b08_gates": f"WITH {_M.format('')}, g AS (SELECT key, 'precision' AS metric, precision AS value, 0.90 AS target FROM m UNION ALL SELECT key, 'recall', recall, 0.85 FROM m UNION ALL SELECT key, 'f_half', f_half, 0.88 FROM m) SELECT key, metric, value, coalesce(value >= target, key <> 'all') AS passed FROM g",
    "b09_gap": f"""WITH {_M.format(', split')}, x AS (SELECT key, CASE WHEN count(*) = 2 AND count(precision) = 2 AND count(recall) = 2 AND count(f_half) = 2 THEN greatest(max(precision) - min(precision), max(recall) - min(recall), max(f_half) - min(f_half)) END AS gap FROM m GROUP BY key) SELECT key, gap, gap <= 0.1::DOUBLE AS passed FROM x""",
}
