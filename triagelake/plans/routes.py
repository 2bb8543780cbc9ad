"""Registered queries of routes, handlers and source texts of methods, and slices that carry them."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.operators import routes
from triagelake.sources import routed

_KEY = ("repo_id", "full_name", "path", "line")


def _flat(rows, of="boundary"):
    return rows.select(*_KEY, *(F.col(f"{of}.{c}").alias(f"route_{c}") for c in ("type", "route", "method", "source")))


def _blocks(s, d):
    return routes.source_blocks(routed.methods(s, d), routed.files(s, d)).select(*_KEY, "end_line", F.sha2("source", 256).alias("source"))


def _slices(s, d):
    out = routes.enriched(routed.methods(s, d), routed.files(s, d))
    return _flat(out.where("boundary IS NOT NULL")).join(out.select(*_KEY, F.sha2("code", 256).alias("code")), list(_KEY))


def _registered(s, d):
    return routes.registered_routes(routed.methods(s, d)).select("repo_id", "full_name", "route.route", "route.method", "route.source")


QUERIES = {
    "x26_source_blocks": _blocks,
    "x25_handlers": _registered,
    "x24_routes": lambda s, d: _flat(routes.routes(routed.methods(s, d), routed.files(s, d)).where("boundary IS NOT NULL")),
    "s34_routed_slices": _slices,
}
_Q, _NQ = "[\"''`]", "[^\"''`]"
_BLOCK = f"""{routed.METHODS_SQL}, near AS (
  SELECT m.repo_id, m.full_name, m.path, m.line, l.n, l.text, length(regexp_extract(l.text, '^\\s*')) AS depth, first_value(length(regexp_extract(l.text, '^\\s*'))) OVER (PARTITION BY m.full_name, m.line ORDER BY l.n) AS base
  FROM methods m JOIN lines l ON l.path = m.path AND l.n >= m.line AND l.n < m.line + CASE WHEN ends_with(m.path, '.py') THEN 80 ELSE 24 END),
cut AS (SELECT *, min(CASE WHEN n > line AND ends_with(path, '.py') AND trim(text) <> '' AND depth <= base AND regexp_matches(text, '^\\s*(@|async\\s+def\\b|def\\b|class\\b)') THEN n END) OVER (PARTITION BY full_name, line) AS stop FROM near),
block AS (SELECT repo_id, full_name, path, line, max(n) AS end_line, regexp_replace(string_agg(text, chr(10) ORDER BY n), '\\s+$', '') AS source FROM cut WHERE stop IS NULL OR n < stop GROUP BY ALL)"""
# in these files handlers are resolved by their name alone: calls have neither a name nor a method that they resolve to
_HANDLERS = f"""{_BLOCK}, reg AS (
  SELECT repo_id, path, line, full_name, upper(regexp_extract(call, '\\.(get|post|use)\\(', 1)) AS verb, regexp_extract(call, '\\((?:''|")([^''"]+)', 1) AS route, CASE WHEN contains(call, 'asyncHandler(') THEN regexp_extract(call, 'utils\\.(\\w+)\\(', 1) ELSE regexp_extract(call, ', (\\w+)\\)$', 1) END AS handler
  FROM methods WHERE regexp_matches(call, '^\\s*(app\\.get|router\\.post)\\((''|")')),
names AS (SELECT repo_id, handler, min(full_name) AS target FROM (SELECT repo_id, full_name, name AS handler FROM methods WHERE name IS NOT NULL UNION SELECT repo_id, full_name, string_split(full_name, ':')[-1] FROM methods) GROUP BY ALL HAVING count(DISTINCT full_name) = 1),
direct AS (SELECT r.*, target FROM reg r JOIN names USING (repo_id, handler)),
own AS (SELECT repo_id, full_name, max(CASE WHEN asked THEN parameter END) AS parameter, bool_or(asked) AS asked FROM methods GROUP BY ALL),
handled AS (SELECT o.repo_id, o.full_name, d.route, d.verb AS method, coalesce(o.parameter, 'request') AS source FROM own o JOIN direct d ON d.repo_id = o.repo_id AND (d.target = o.full_name OR (o.asked AND starts_with(o.full_name, d.target || ':')))
  QUALIFY row_number() OVER (PARTITION BY o.repo_id, o.full_name ORDER BY d.path, d.line, d.full_name) = 1)"""
_ROUTES = f"""{_HANDLERS}, deco AS (
  SELECT m.full_name, m.line, regexp_extract_all(string_agg(l.text, chr(10) ORDER BY l.n), '@[\\w.]+\\.(?:get|post|put|patch|delete|route)\\s*\\(\\s*{_Q}{_NQ}+{_Q}[\\s\\S]*?\\)')[-1] AS found
  FROM methods m JOIN lines l ON l.path = m.path AND l.n >= m.line - 12 AND l.n < m.line WHERE ends_with(m.path, '.py') GROUP BY ALL),
gol AS (SELECT repo_id, path, n, CASE WHEN regexp_matches(text, 'HandleFunc\\(') THEN 0 ELSE 1 END AS kind, text FROM lines WHERE ends_with(path, '.go') AND regexp_matches(text, '(HandleFunc|r\\.GET|mux\\.Any)\\({_Q}{_NQ}+{_Q}, m\\d+\\)')),
go AS (SELECT repo_id, regexp_extract(text, ', (m\\d+)\\)', 1) AS name, regexp_extract(text, '\\({_Q}({_NQ}+)', 1) AS route, CASE WHEN kind = 0 OR contains(text, 'Any') THEN 'ANY' ELSE 'GET' END AS method FROM gol QUALIFY row_number() OVER (PARTITION BY repo_id, regexp_extract(text, ', (m\\d+)\\)', 1) ORDER BY path, kind, n) = 1),
said AS (SELECT m.*, CASE WHEN m.annotation IS NOT NULL THEN m.annotation WHEN regexp_matches(m.code, '@(Get|Post|Request)Mapping') THEN regexp_extract(m.code, '@(?:Get|Post|Request)Mapping[^\\n)]*\\)?') END AS spring,
  CASE WHEN regexp_matches(m.code, '@app\\.route\\(') THEN regexp_extract(m.code, '@app\\.route\\(''([^'']+)', 1) END AS py, CASE WHEN m.asked AND regexp_matches(m.code, '(app\\.get|router\\.post)\\((''|")') THEN regexp_extract(m.code, '(?:app\\.get|router\\.post)\\((?:''|")[^''"]+') END AS js,
  h.route AS h_route, h.method AS h_method, h.source AS h_source, d.found, g.route AS g_route, g.method AS g_method, CASE WHEN m.asked AND NOT ends_with(m.path, '.java') AND regexp_matches(lower(m.call), '\\b(app|router)\\.(get|post|put|patch|delete|all|use)\\s*\\(') THEN m.call END AS c
  FROM methods m LEFT JOIN handled h USING (repo_id, full_name) LEFT JOIN deco d ON d.full_name = m.full_name AND d.line = m.line LEFT JOIN go g ON g.repo_id = m.repo_id AND g.name = m.name AND ends_with(m.path, '.go')),
routed AS (SELECT repo_id, full_name, path, line,
  CASE WHEN spring IS NOT NULL THEN 'spring' WHEN py IS NOT NULL THEN 'python-web' WHEN js IS NOT NULL OR h_route IS NOT NULL THEN 'javascript-web' WHEN found IS NOT NULL THEN 'python-web' WHEN g_route IS NOT NULL THEN 'go-web' WHEN c IS NOT NULL THEN 'web-route' WHEN asked AND NOT ends_with(path, '.java') THEN 'framework-input' END AS route_type,
  CASE WHEN spring IS NOT NULL THEN coalesce(nullif(regexp_extract(spring, '{_Q}({_NQ}+)', 1), ''), regexp_extract(spring, '@(\\w+)', 1)) WHEN py IS NOT NULL THEN py WHEN js IS NOT NULL THEN regexp_extract(js, '{_Q}({_NQ}+)', 1) WHEN h_route IS NOT NULL THEN h_route WHEN found IS NOT NULL THEN regexp_extract(found, '{_Q}({_NQ}+)', 1) WHEN g_route IS NOT NULL THEN g_route WHEN c IS NOT NULL THEN c ELSE coalesce(name, string_split(full_name, ':')[-1]) END AS route_route,
  CASE WHEN spring IS NOT NULL THEN CASE WHEN contains(spring, 'GetMapping') THEN 'GET' ELSE 'POST' END WHEN py IS NOT NULL THEN 'ROUTE' WHEN js IS NOT NULL THEN CASE WHEN contains(js, 'app.get') THEN 'GET' ELSE 'POST' END WHEN h_route IS NOT NULL THEN h_method
    WHEN found IS NOT NULL THEN CASE WHEN contains(found, '.get(') THEN 'GET' WHEN contains(found, 'methods=') THEN 'POST' ELSE 'ANY' END WHEN g_route IS NOT NULL THEN g_method WHEN c IS NOT NULL THEN 'ROUTE' END AS route_method,
  CASE WHEN spring IS NULL AND py IS NULL AND js IS NULL THEN CASE WHEN h_route IS NOT NULL THEN h_source WHEN found IS NULL AND g_route IS NULL AND c IS NULL THEN parameter ELSE 'request' END ELSE 'request' END AS route_source FROM said)"""
ORACLE_SQL = {
    "x26_source_blocks": f"WITH {_BLOCK} SELECT repo_id, full_name, path, line, end_line, sha256(source) AS source FROM block WHERE source <> ''",
    "x25_handlers": f"WITH {_HANDLERS} SELECT * FROM handled",
    "x24_routes": f"WITH {_ROUTES} SELECT * FROM routed WHERE route_type IS NOT NULL",
    "s34_routed_slices": f"WITH {_ROUTES} SELECT r.*, sha256(coalesce(nullif(b.source, ''), m.code)) AS code FROM routed r JOIN methods m ON m.full_name = r.full_name AND m.line = r.line LEFT JOIN block b ON b.full_name = r.full_name AND b.line = r.line WHERE route_type IS NOT NULL",
}
