"""The SQL that findings are held against."""

FILES = """f AS (SELECT source AS repo_id, doc_id, text, (CASE WHEN doc_id % 11 = 3 THEN 'vendor/' || lang ELSE lang END) || '/file' || doc_id || '.' || (['py','ts','java','md','sol','json','yml'])[(doc_id % 7 + 1)::INT] AS path,
  octet_length(encode(text)) AS size, sha256(text) AS sha256 FROM documents)"""
SEVERITY_RANK = "CASE {0} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
FOUND = FILES + r""",
l AS (SELECT repo_id, path, doc_id, parts[i] AS line, i AS line_no FROM (SELECT *, string_split(text, chr(10)) AS parts FROM f), unnest(range(1, len(parts) + 1)) AS u(i)),
r AS (SELECT * FROM (VALUES (0, 'aws-key', 'secret', 'critical', 'AKIA[0-9A-Z]{16}'), (1, 'email', 'secret', 'low', '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'),
  (2, 'assignment', 'secret', 'high', '(?i)(password|secret|token|api_key)\s*[=:]\s*\S+'), (3, 'license', 'dependency', 'medium', '[Ll]icensed? under|MIT License'), (4, 'shout', 'code', 'unknown', '[A-Z]{4,}!!')) AS v(ord, rule_id, category, severity, pattern)),
c AS (SELECT l.*, ord, rule_id, category, severity FROM l JOIN r ON regexp_matches(line, pattern)),
s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, 'AKIA[0-9A-Z]{16}', '[REDACTED_AWS_KEY]', 'g'), 'gh[pousr]_[A-Za-z0-9]{20,}', '[REDACTED_TOKEN]', 'g'), 'sk_(live|test)_[A-Za-z0-9]+', '[REDACTED_KEY]', 'g'),
  '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[REDACTED_EMAIL]', 'g'), '(password|secret|token|api_key)\s*[=:]\s*\S+', '[REDACTED_VALUE]', 'g') AS snippet FROM c),
k AS (SELECT *, 'fp_' || substr(sha256(repo_id || chr(0) || rule_id || chr(0) || snippet), 1, 16) AS fingerprint FROM s),
d AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY path, line_no, ord) = 1)
"""
