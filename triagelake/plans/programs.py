"""Registered queries of code entities: identities, request-controlled names, sinks of calls and of entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.operators import sink_rules as sr
from triagelake.sources import programs


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _like(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {_lit(pattern)})"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_CALLABLE = "string_split(regexp_replace({0}, '^globalThis\\.', ''), ':')[1]"
_SYMBOL = "CASE WHEN contains({0}, '::program:') THEN regexp_extract({0}, '^.*::program:(.*)$', 1) WHEN ends_with({0}, '::program') THEN 'program' WHEN NOT contains(list_filter(string_split(string_split({0}, ':')[1], '.'), lambda x: x <> '')[-1], '/') THEN list_filter(string_split(string_split({0}, ':')[1], '.'), lambda x: x <> '')[-1] ELSE list_filter(string_split({0}, ':'), lambda x: x <> '')[-1] END"


def _method(text: str) -> str:
    callable_ = _CALLABLE.format(text)
    return f"coalesce(regexp_extract_all({callable_}, {_lit(sr.INVOKED)}, 1)[-1], regexp_replace(list_filter(string_split({callable_}, '.'), lambda x: x <> '')[-1], '\\(.*$', ''))"


_NAMES = f"""list_distinct(list_transform(list_concat(list_filter(own, lambda n: lower(n) NOT IN {_in(sr.FRAMEWORK)}), regexp_extract_all(coalesce(b_route, ''), '<(?:(?:string|int|float|path|uuid):)?([A-Za-z_]\\w*)>', 1),
  regexp_extract_all(coalesce(b_route, ''), ':([A-Za-z_]\\w*)', 1), regexp_extract_all(coalesce(b_route, ''), '\\{{([A-Za-z_]\\w*)\\}}', 1), list_filter([regexp_extract(coalesce(b_source, ''), {_lit(r"[.\[\]]([A-Za-z_]\w*)['\"]?\]?$")}, 1)], lambda n: n <> '' AND lower(n) NOT IN {_in(sr.FRAMEWORK)})), lambda n: lower(n)))"""
_CONTEXT = f"""{programs.ENTITIES}, {programs.CALLS}, k AS (SELECT entity, string_agg(concat_ws(chr(10), coalesce(name, ''), coalesce(resolved, ''), coalesce(code, '')), chr(10) ORDER BY nth) AS said FROM cal GROUP BY entity),
ea AS (SELECT ent.*, said, list_filter([p_one, p_two], lambda x: x IS NOT NULL) AS own, concat_ws(chr(10), full_name, path, concat_ws(' ', b_type, b_route, b_method, b_source), p_one, CASE WHEN p_one IS NOT NULL THEN coalesce(t_one, '') END, p_two, CASE WHEN p_two IS NOT NULL THEN '' END) AS descriptor FROM ent LEFT JOIN k USING (entity)),
ctx AS (SELECT *, concat_ws(chr(10), descriptor, said) AS wide, {_NAMES} AS names, coalesce({_like("lower(concat_ws(' ', b_type, b_route))", sr.HTTP_BOUNDARY)} OR starts_with(b_route, '/'), false) AS http, coalesce(b_method IN ('POST', 'PUT', 'PATCH', 'DELETE'), false) AS state,
  coalesce({_like('p_one', sr.REQUESTS)}, false) OR coalesce({_like('p_two', sr.REQUESTS)}, false) OR coalesce(p_one IS NOT NULL AND {_like('t_one', r'\bRequest\b')}, false) OR coalesce({_like('b_source', sr.REQUESTS)}, false) AS external, {_like('path', sr.BROWSER)} AS browser FROM ea)"""
_WITH = "(wide || chr(10) || cand)"
_EXISTS = lambda names, test: f"len(list_filter({names}, lambda n: {test})) > 0"
_DYNAMIC = lambda before, after: f"({_lit(before)} || n || {_lit(after)})"
_WHEN = {
    "jwt": f"({_like('lower(descriptor || chr(10) || cand)', sr.JWT_ENTITY)} OR {_like('low', sr.JWT_CALL)})", "logs": f"({_like('lower(descriptor || chr(10) || cand)', sr.LOG_PATH)} OR {_like('low', sr.LOG_PATH)})",
    "bare_open": f"(NOT browser AND (ends_with(lower(path), '.py') OR {_like('low', 'fs.open|node:fs|fs/promises')}))", "csrf": f"(state AND {_like(_WITH, sr.CSRF_RISK)} AND NOT {_like(_WITH, sr.CSRF_CONTROL)})",
    "raw_html": _EXISTS(f"list_filter(own, lambda x: lower(x) NOT IN {_in(sr.FRAMEWORK)})", "regexp_matches(cand, " + _DYNAMIC(r"(?:\+|\$\{)\s*(?:this\.)?", r"\s*(?:[+)};]|$)") + ")"),
    "resource": f"""(http AND {_like(_WITH, sr.RESOURCE_ID)} AND {_like(_WITH, sr.RESOURCE_USE)} AND ({_EXISTS('names', _like('n', sr.RESOURCE_ID))} OR {_like('cand', sr.REQUEST_ID)} OR (external AND {_like('cand', sr.HANDLER_ID)}))
      AND NOT (({_like(_WITH, sr.OWNED[0])} AND {_like(_WITH, sr.OWNED[1])}) OR {_like(_WITH, sr.OWNED_NEAR)}))""",
}
_OUTBOUND = f"""CASE WHEN browser OR {_like('lower(coalesce(code, cand))', 'this.http|httpclient')} THEN 'outbound_http' WHEN {_like('lower(coalesce(code, cand))', sr.REQUEST_VALUE)} OR ((external OR b_type IS NOT NULL) AND ({_EXISTS('names', "regexp_matches(lower(coalesce(code, cand)), " + _DYNAMIC(r'(?i)\b', r'\b') + ")")} OR (external AND {_like('lower(coalesce(code, cand))', sr.TARGET_NAME)}))) THEN 'server_side_request' ELSE 'outbound_http' END"""


def _rule(rule: sr.Rule) -> str:
    tests = []
    for methods, pattern in rule.calls:
        parts = [f"m IN {_in(methods)}"] if methods else []
        if pattern:
            parts.append(f"({_like('low', pattern)} OR {_like('m', pattern)})" if rule.when == "csrf" else _like("low", pattern))
        tests.append("(" + " AND ".join(parts) + ")")
    out = "(" + " OR ".join(tests) + ")"
    if rule.context:
        out += f" AND {_like('lower(descriptor || chr(10) || cand)', rule.context)}"
    if rule.when:
        out += f" AND {_WHEN[rule.when]}"
    return f"WHEN {out} THEN {_OUTBOUND if rule.sink == 'outbound' else _lit(rule.sink)}"


_SINKS = f"""{_CONTEXT}, tried AS (SELECT ctx.*, nth, name, resolved, code, cal.line AS call_line, t.ord, t.cand FROM ctx JOIN cal USING (entity), unnest([{{'ord': 1, 'cand': coalesce(resolved, name)}}, {{'ord': 2, 'cand': name}}, {{'ord': 3, 'cand': resolved}}, {{'ord': 4, 'cand': code}}]) AS u(t) WHERE t.cand IS NOT NULL AND t.cand <> ''),
low AS (SELECT *, lower(cand) AS low, lower({_method('cand')}) AS m, {_method('cand')} AS label FROM tried), cls AS (SELECT *, CASE {' '.join(map(_rule, sr.RULES))} END AS sink_type FROM low),
sinks AS (SELECT repo_id, full_name, path, coalesce(call_line, line)::BIGINT AS line, nth, coalesce(resolved, name) AS call_name, CASE WHEN contains(cand, 'child_process.exec') THEN 'child_process.exec' WHEN contains(low, 'runtime.exec') THEN 'Runtime.exec' ELSE label END AS label, sink_type FROM cls WHERE sink_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity, nth ORDER BY ord) = 1)"""
_T = "t"
_RAW = _EXISTS("names", f"regexp_matches(t, {_lit(r'(?:\+\s*|\$\{\s*|%\s*|\{\s*)')} || n || {_lit(r'\b|\b')} || n || {_lit(r'\s*(?:\+|%|,|\})')})")
_REFLECTED = f"http AND {_like(_T, sr.RESPONSE)} AND {_RAW} AND NOT {_like(_T, sr.ENCODED)}"
_ENTITY = f"""{_SINKS}, sem AS (SELECT *, lower(concat_ws(chr(10), descriptor, wide)) AS t FROM ctx), f AS (
  SELECT repo_id, full_name, path, line, 'weak_crypto_indicator_verifier' AS semantic, 'crypto_weakness' AS sink_type FROM sem WHERE {_like(_T, sr.VERIFIER)} AND len(list_filter({list(sr.WEAK)}, lambda w: regexp_matches(t, '(?:^|[^a-z0-9])' || w || '(?:[^a-z0-9]|$)'))) >= 2
  UNION ALL SELECT repo_id, full_name, path, line, 'reflected_raw_html_output', 'cross_site_scripting' FROM sem WHERE {_REFLECTED} AND {_like(_T, sr.HTML_TEXT)}
  UNION ALL SELECT repo_id, full_name, path, line, 'reflected_raw_response_output', 'cross_site_scripting' FROM sem WHERE {_REFLECTED} AND NOT {_like(_T, sr.HTML_TEXT)} AND {_like(_T, sr.PLAIN_RESPONSE)}
  UNION ALL SELECT repo_id, full_name, path, line, 'sensitive_server_content_exposure', 'hidden_content_exposure' FROM sem WHERE http AND {_like(_T, sr.ADMIN)} AND {_like(_T, sr.EMAIL)} AND (external OR names <> [] OR {_like(_T, sr.REQUEST_DOT)})
  UNION ALL SELECT repo_id, full_name, path, line, 'weak_authentication_decision', 'authentication_bypass' FROM sem WHERE http AND {' AND '.join(_like(_T, p) for p in sr.LOGIN)} AND {_like(_T, sr.DECISION)}
  UNION ALL SELECT repo_id, full_name, path, line, 'file_upload_handling', 'file_upload_validation' FROM sem s WHERE http AND {' AND '.join(_like(_T, p) for p in sr.UPLOAD)} AND NOT EXISTS (SELECT 1 FROM sinks k WHERE k.repo_id = s.repo_id AND k.full_name = s.full_name AND k.path = s.path AND k.sink_type = 'file_upload_validation'))"""


def _sinks(s, d):
    return sr.call_sinks(programs.entities(s, d))


def _identities(s, d):
    full = F.col("full_name")
    return programs.entities(s, d).select("full_name", sr.symbol(full).alias("symbol"), sr.lexical_parent(full).alias("parent"), sr.is_http(F.col("boundary")).alias("http"), sr.changes_state(F.col("boundary")).alias("state"))


QUERIES = {
    "p30_p31_identities": _identities,
    "k23_request_names": lambda s, d: programs.entities(s, d).select("full_name", F.explode(sr.request_names(F.col("boundary"), F.col("parameters"))).alias("name")),
    "k24_contexts": lambda s, d: sr.contexts(programs.entities(s, d)).select("full_name", F.sha2("descriptor", 256).alias("descriptor"), F.sha2("wide", 256).alias("wide"), "external", "browser"),
    "k01_k17_call_sinks": _sinks,
    "k18_k22_entity_sinks": lambda s, d: sr.entity_sinks(programs.entities(s, d), _sinks(s, d)),
}
ORACLE_SQL = {
    "p30_p31_identities": f"WITH {_CONTEXT} SELECT full_name, {_SYMBOL.format('full_name')} AS symbol, nullif(regexp_extract(full_name, '^(.*):<lambda>', 1), '') AS parent, http, state FROM ctx",
    "k23_request_names": f"WITH {_CONTEXT} SELECT full_name, unnest(names) AS name FROM ctx",
    "k24_contexts": f"WITH {_CONTEXT} SELECT full_name, sha256(descriptor) AS descriptor, sha256(wide) AS wide, external, browser FROM ctx",
    "k01_k17_call_sinks": f"WITH {_SINKS} SELECT * FROM sinks",
    "k18_k22_entity_sinks": f"WITH {_ENTITY} SELECT * FROM f",
}
