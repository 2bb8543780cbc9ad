"""Registered queries over trees of files: path predicates, inventories, CI, infrastructure and content extractors."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.functions import findings as fn
from triagelake.functions import paths
from triagelake.operators import content, infra, inventory, workflows
from triagelake.sources import corpus, trees

NL = "chr(10)"
_BASE = "string_split(path, '/')[-1]"
_EXT = f"lower(regexp_extract({_BASE}, '\\.([^.]*)$', 1))"
_IN = lambda values: ", ".join(f"'{v}'" for v in values)
_CASE = lambda names: " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())
_MANIFEST = f"({_BASE} IN ({_IN(paths.MANIFESTS)}) OR {' OR '.join(f"regexp_matches({_BASE}, '{p}')" for p in paths.MANIFEST_PATTERNS)})"
_WORKFLOW = f"regexp_matches(path, '{paths.WORKFLOW}')"
_INFRA = rf"""(NOT {_WORKFLOW} AND (regexp_matches({_BASE}, '(?i)^dockerfile([.-].*)?$') OR regexp_matches({_BASE}, '(?i)^(docker-)?compose([.-].*)?\.ya?ml$') OR regexp_matches({_BASE}, '(?i)\.(tf|tfvars)$')
  OR (({_BASE} = 'Chart.yaml' OR regexp_matches({_BASE}, '(?i)^values([.-].*)?\.ya?ml$')) AND (contains(lower(path), '/helm/') OR contains(lower(path), '/charts/')))
  OR (regexp_matches({_BASE}, '(?i)\.(ya?ml|json)$') AND (starts_with(lower(path), 'k8s/') OR starts_with(lower(path), 'kubernetes/') OR contains(lower(path), '/k8s/') OR contains(lower(path), '/kubernetes/')))))"""
_HIDDEN = f"(NOT regexp_matches(path, '{paths.IGNORED_CONTENT}') AND regexp_matches(path, '{paths.IMAGE}') AND (regexp_matches(path, '{paths.HIDING}') OR (contains(path, '/uploads/') AND contains({_BASE}, '#'))))"
_CONTENT = f"(regexp_matches(path, '{paths.CONTENT_TEXT}') AND NOT regexp_matches(path, '{paths.GENERATED}'))"
_SCALAR = r"""CASE WHEN {0} NOT IN ('', '{{}}') THEN {0} END"""
_BARE = r"""regexp_replace(regexp_replace(trim({0}), '^["'']|["'']$', '', 'g'), '\s+#.*$', '')"""


def _scalar(x: str) -> str:
    return _SCALAR.format(_BARE.format(x))


def _value(key: str) -> str:
    return _scalar(rf"regexp_extract(line, '^\s*-?\s*{key}\s*:\s*(.+?)\s*$', 1)")


def _evidence(kind: str, body: str, prefix: str = "ci_iac") -> str:
    return f"'{prefix}_' || substr(sha256('{kind}' || chr(0) || path || chr(0) || {body}), 1, 16)"


_FILES_OF = lambda where: f"{trees.LINES}, w AS (SELECT * FROM lines WHERE {where})"
_ON = r"regexp_extract(line, '^\s*on\s*:\s*(.+?)\s*$', 1)"
_STEPS = rf"""{_FILES_OF(_WORKFLOW)}, v AS (SELECT *, {_value('uses')} AS uses, {_value('run')} AS run, {_value('name')} AS named, {_value('path')} AS spot FROM w),
o AS (SELECT *, last_value(named IGNORE NULLS) OVER (PARTITION BY repo_id, path ORDER BY n ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS above,
  first_value(named IGNORE NULLS) OVER d AS next_name, first_value(spot IGNORE NULLS) OVER d AS next_path FROM v WINDOW d AS (PARTITION BY repo_id, path ORDER BY n ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)),
s AS (SELECT *, n || '-' || substr(regexp_replace(regexp_replace(lower(coalesce(uses, run)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) AS step_id FROM o WHERE coalesce(uses, run) IS NOT NULL)"""
_PUBLIC = lambda x: f"regexp_matches({x}, '{infra.PUBLIC}')"
_IAC = rf"""{_FILES_OF(_INFRA)},
tf AS (SELECT *, regexp_extract(line, '{infra.RESOURCE}', 0) AS head FROM w WHERE regexp_matches(path, '(?i)\.tf(vars)?$')),
tb AS (SELECT *, count(*) FILTER (WHERE head <> '') OVER (PARTITION BY repo_id, path ORDER BY n ROWS UNBOUNDED PRECEDING) AS block FROM tf),
own AS (SELECT repo_id, path, regexp_extract(max(head), '{infra.RESOURCE}', 1) AS resource_type, regexp_extract(max(head), '{infra.RESOURCE}', 2) AS name, min(n) AS n, bool_or({_PUBLIC('line')}) AS public, max(head) AS body FROM tb WHERE block > 0 GROUP BY repo_id, path, block
  UNION ALL SELECT repo_id, path, coalesce(arg_min({_value('kind')}, n) FILTER (WHERE regexp_matches(line, '{infra.KIND}')), 'yaml-resource'), coalesce(arg_min({_value('name')}, n) FILTER (WHERE {_value('name')} IS NOT NULL), {_BASE}), min(n) FILTER (WHERE regexp_matches(line, '{infra.KIND}')),
    bool_or({_PUBLIC('line')}), arg_min(line, n) FILTER (WHERE regexp_matches(line, '{infra.KIND}')) FROM w WHERE regexp_matches(path, '(?i)\.(ya?ml|json)$') GROUP BY repo_id, path HAVING bool_or(regexp_matches(line, '{infra.KIND}'))),
found AS (SELECT repo_id, path, list_sort(list(DISTINCT 'f' || size % 97)) AS finding_ids FROM tree WHERE size % 5 = 0 GROUP BY ALL),
rest AS (SELECT t.repo_id, t.path, lower({_BASE.replace('path', 't.path')}) AS resource_type, {_BASE.replace('path', 't.path')} AS name, 1 AS n, {_PUBLIC('text')} AS public, substr(text, 1, 200) AS body FROM (SELECT * FROM tree WHERE {_INFRA}) t
  WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.repo_id = t.repo_id AND own.path = t.path) AND ({_PUBLIC('text')} OR EXISTS (SELECT 1 FROM found f WHERE f.repo_id = t.repo_id AND f.path = t.path)))
SELECT a.repo_id, a.path, resource_type, name, n, public, {_evidence('iac-resource', 'body').replace('path', 'a.path')} AS evidence_id, coalesce(finding_ids, []) AS finding_ids FROM (SELECT * FROM own UNION ALL SELECT * FROM rest) a LEFT JOIN found f ON f.repo_id = a.repo_id AND f.path = a.path"""
_Q = "'" + '"`'
_CONTENT_SQL = rf"""{trees.LINES}, t AS (SELECT * FROM lines WHERE {_CONTENT} AND NOT regexp_matches(path, '{paths.IGNORED_CONTENT}')),
sr AS (SELECT *, upper(regexp_extract(line, '(?i)\bapp\.(get|post|put|patch|delete|use)\(\s*[''"`]([^''"`]+)[''"`]', 1)) AS verb, regexp_extract(line, '(?i)\bapp\.(get|post|put|patch|delete|use)\(\s*[''"`]([^''"`]+)[''"`]', 2) AS route FROM t),
fb AS (SELECT *, count(*) FILTER (WHERE f <> '') OVER (PARTITION BY repo_id, path ORDER BY n ROWS UNBOUNDED PRECEDING) AS block FROM (SELECT *, regexp_extract(line, '\b(?:export\s+)?function\s+([A-Za-z_$][\w$]*)\s*\(', 1) AS f FROM t)),
ob AS (SELECT repo_id, path, max(f) AS f FROM fb WHERE block > 0 GROUP BY repo_id, path, block HAVING bool_or(regexp_matches(lower(line), '\.tostring\(36\)|fromcharcode|\.reverse\(\)|charcodeat|atob\(|decodeuricomponent\('))),
cr AS (SELECT *, regexp_extract(line, '\bpath\s*:\s*[''"`]([^''"`]+)[''"`]', 1) AS route, lower(string_agg(line, chr(10)) OVER (PARTITION BY repo_id, path ORDER BY n ROWS BETWEEN 2 PRECEDING AND 4 FOLLOWING)) AS block FROM t WHERE regexp_matches(path, '{paths.RUNTIME}')),
a AS (SELECT repo_id, path, 1 AS n, 'steganography_asset' AS exposure, path AS subject, path AS line FROM tree WHERE {_HIDDEN}
  UNION ALL SELECT repo_id, path, n, 'hidden_server_route', verb || ' ' || route, line FROM sr WHERE route <> '' AND (regexp_matches(lower(route), '{content.HIDDEN_ROUTE}') OR (len(list_filter(string_split(lower(route), '/'), lambda x: x <> '')) >= 8 AND length(route) >= 72))
  UNION ALL SELECT m.repo_id, m.path, n, 'obfuscated_frontend_route', m.f, line FROM (SELECT *, regexp_extract(line, '\bmatcher\s*:\s*([A-Za-z_$][\w$]*)', 1) AS f FROM t) m WHERE EXISTS (SELECT 1 FROM ob WHERE ob.repo_id = m.repo_id AND ob.path = m.path AND ob.f = m.f)
  UNION ALL SELECT repo_id, path, n, 'sensitive_frontend_route', route, line FROM cr WHERE route <> '' AND (regexp_matches(lower(route), '{content.SENSITIVE}') OR (regexp_matches(block, '{content.GUARDED}') AND regexp_matches(block, '{content.GUARD}')))
  UNION ALL SELECT repo_id, path, n, 'private_asset_reference', regexp_extract(line, '[''"`]([^''"`]*assets/private/[^''"`\s)]+)[''"`]', 1), line FROM t WHERE regexp_matches(path, '{paths.RUNTIME}') AND regexp_matches(line, '[''"`]([^''"`]*assets/private/[^''"`\s)]+)[''"`]')
  UNION ALL SELECT repo_id, path, n, 'steganography_content_clue', 'hidden image clue', line FROM t WHERE regexp_matches(line, '(?i)steganograph'))
SELECT repo_id, path, n, exposure, subject, 'content_' || substr(sha256(replace(exposure, '_', '-') || chr(0) || path || chr(0) || line), 1, 16) AS evidence_id FROM a"""


def _workflow_lines(s, d):
    return trees.lines(trees.files(s, d).where(paths.is_workflow(F.col("path"))))


def _findings(s, d):
    """One file in five has a finding of infrastructure."""
    return trees.files(s, d).where("size % 5 = 0").select("repo_id", "path", F.lit("iac").alias("category"), F.concat(F.lit("f"), F.expr("size % 97")).alias("finding_id"))


def _exposures(s, d):
    files = trees.files(s, d)
    return content.exposures(files, trees.lines(files))


def _infra(s, d):
    files = trees.files(s, d)
    return infra.resources(files, trees.lines(files), _findings(s, d))


def _flags(s, d):
    path = F.col("path")
    flags = {
        "manifest": paths.is_manifest(path), "workflow": paths.is_workflow(path), "infra": paths.is_infra(path), "content_text": paths.is_content_text(path), "runtime": path.rlike(paths.RUNTIME),
        "image": path.rlike(paths.IMAGE), "contract": paths.is_contract(path), "ignored_content": path.rlike(paths.IGNORED_CONTENT), "ignored_contract": paths.is_ignored_contract(path), "generated": path.rlike(paths.GENERATED),
    }
    return trees.files(s, d).select("path", *(v.alias(k) for k, v in flags.items()), paths.supported(path).alias("supported"), paths.unsupported(path).alias("unsupported"))


def _scanner_paths(s, d):
    """Paths as scanners write them, safe and unsafe."""
    k = F.col("size") % 8
    wrote = F.when(k == 0, F.concat(F.lit("/work/source/"), "path")).when(k == 1, F.concat(F.lit("./"), "path")).when(k == 2, F.concat(F.lit("file:///work/source/"), "path")).when(k == 3, F.concat(F.lit("/etc/"), "path"))
    wrote = wrote.when(k == 4, F.concat(F.lit("a/../"), "path")).when(k == 5, F.concat(F.lit(" "), "path", F.lit(" "))).when(k == 6, F.replace("path", F.lit("/"), F.lit("\\"))).otherwise(F.col("path"))
    return trees.files(s, d).where("NOT contains(path, '#')").select("repo_id", "path", wrote.alias("wrote"))


QUERIES = {
    "p02_p06_path_flags": _flags,
    "p08_scanner_paths": lambda s, d: _scanner_paths(s, d).select("repo_id", "path", paths.scanned(F.col("wrote")).alias("scanned")),
    "p09_quiet_rules": lambda s, d: trees.files(s, d).select("repo_id", "path", paths.is_quiet(F.lit("opengrep"), F.expr("CASE WHEN size % 3 = 0 THEN 'other' WHEN size % 3 = 1 THEN 'javascript-eval' ELSE 'javascript-function-constructor' END"), F.col("path")).alias("quiet")),
    "x11_workflow_names": lambda s, d: workflows.names(_workflow_lines(s, d)),
    "x12_workflow_triggers": lambda s, d: workflows.triggers(_workflow_lines(s, d)),
    "x13_p29_workflow_steps": lambda s, d: workflows.steps(_workflow_lines(s, d)),
    "x14_token_permissions": lambda s, d: workflows.permissions(_workflow_lines(s, d), workflows.steps(_workflow_lines(s, d))),
    "x15_artifacts": lambda s, d: workflows.artifacts(_workflow_lines(s, d), workflows.steps(_workflow_lines(s, d))),
    "x16_x18_j12_infra_resources": _infra,
    "x02_code_patterns": lambda s, d: content.code_patterns(trees.lines(trees.files(s, d))),
    "x03_x08_exposures": _exposures,
    "x27_routing": lambda s, d: content.routed(trees.files(s, d)),
    "a01_inventory": lambda s, d: inventory.summary(trees.files(s, d)),
    "a02_scan_plan": lambda s, d: inventory.scan_plan(inventory.summary(trees.files(s, d))),
    "a09_language_support": lambda s, d: inventory.language_support(trees.files(s, d)),
    "s03_s04_limits": lambda s, d: corpus.limited(trees.files(s, d)),
    "a07_manifest_counts": lambda s, d: corpus.manifest_summary(trees.files(s, d)),
    "s02_tree_hash": lambda s, d: corpus.snapshot_hash(corpus.kept(trees.files(s, d)).withColumn("sha256", F.sha2("text", 256))),
}
_INVENTORY = f"""inv AS (SELECT repo_id, list_sort(coalesce(list(DISTINCT CASE {_EXT} {_CASE(fn.LANGUAGES)} END) FILTER (WHERE CASE {_EXT} {_CASE(fn.LANGUAGES)} END IS NOT NULL), [])) AS languages,
  list_sort(coalesce(list(path) FILTER (WHERE {_MANIFEST}), [])) AS package_manifests, list_sort(coalesce(list(path) FILTER (WHERE {_WORKFLOW}), [])) AS workflows, list_sort(coalesce(list(path) FILTER (WHERE {_INFRA}), [])) AS infra_files,
  count(*) FILTER (WHERE CASE {_EXT} {_CASE(fn.LANGUAGES)} END IS NOT NULL) AS n_code_files FROM tree GROUP BY repo_id)"""
_IGNORED = f"list_has_any(string_split(path, '/')[1:-2], [{_IN(corpus.IGNORED)}])"
_GREEDY = f"""m AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS r FROM tree WHERE NOT {_IGNORED} AND size <= {corpus.FILE_BYTES}),
g AS (SELECT repo_id, 0::BIGINT AS r, '' AS path, 0::BIGINT AS size, 0::BIGINT AS used, 0 AS files, true AS fits FROM (SELECT DISTINCT repo_id FROM m)
  UNION ALL SELECT m.repo_id, m.r, m.path, m.size, CASE WHEN g.files < {corpus.FILES} AND g.used + m.size <= {corpus.REPO_BYTES} THEN g.used + m.size ELSE g.used END, CASE WHEN g.files < {corpus.FILES} AND g.used + m.size <= {corpus.REPO_BYTES} THEN g.files + 1 ELSE g.files END,
    g.files < {corpus.FILES} AND g.used + m.size <= {corpus.REPO_BYTES} FROM g JOIN m ON m.repo_id = g.repo_id AND m.r = g.r + 1),
x AS (SELECT repo_id, path, 'builtin-ignore' AS reason FROM tree WHERE {_IGNORED} UNION ALL SELECT repo_id, path, 'too_large' FROM tree WHERE NOT {_IGNORED} AND size > {corpus.FILE_BYTES} UNION ALL SELECT repo_id, path, 'truncated' FROM g WHERE r > 0 AND NOT fits)"""
_CHECK_ROWS = ", ".join(f"({k}, '{check}', '{tool}', '{needs}', {repr(reason) if reason else 'NULL'})" for k, (check, tool, needs, reason) in enumerate(inventory.CHECKS))
_COUNTS = lambda side: f"""coalesce(list(language || '=' || files ORDER BY language) FILTER (WHERE kind = '{side}'), [])"""
ORACLE_SQL = {
    "p02_p06_path_flags": f"""WITH {trees.TREE} SELECT path, {_MANIFEST} AS manifest, {_WORKFLOW} AS workflow, {_INFRA} AS infra, {_CONTENT} AS content_text, regexp_matches(path, '{paths.RUNTIME}') AS runtime, regexp_matches(path, '{paths.IMAGE}') AS image, regexp_matches(path, '{paths.SOLIDITY}') AS contract,
regexp_matches(path, '{paths.IGNORED_CONTENT}') AS ignored_content, (regexp_matches(path, '{paths.IGNORED_CONTRACT}') OR contains(lower({_BASE}), 'correct')) AS ignored_contract, regexp_matches(path, '{paths.GENERATED}') AS generated, CASE {_EXT} {_CASE(paths.SUPPORTED)} END AS supported, CASE {_EXT} {_CASE(paths.UNSUPPORTED)} END AS unsupported FROM tree""",
    "p08_scanner_paths": f"WITH {trees.TREE} SELECT repo_id, path, CASE WHEN size % 8 IN (3, 4) OR (size % 8 = 6 AND contains(path, '/')) THEN NULL ELSE path END AS scanned FROM tree WHERE NOT contains(path, '#')",
    "p09_quiet_rules": rf"WITH {trees.TREE} SELECT repo_id, path, size % 3 > 0 AND (regexp_matches(lower(path), 'syntax-?highlighter/scripts/sh[a-z0-9_-]*\.js$') OR (regexp_matches(lower(path), '[.-]min\.js$') AND regexp_matches(lower(path), '/(libs|lib|vendor|vendors|third_party|bower_components)/'))) AS quiet FROM tree",
    "x11_workflow_names": rf"WITH {_FILES_OF(_WORKFLOW)}, e AS (SELECT *, regexp_extract(line, '^\s*name\s*:\s*(.+?)\s*$', 1) AS v FROM w), f AS (SELECT repo_id, path, arg_min(v, n) FILTER (WHERE v <> '') AS v, max(n) AS n_lines FROM e GROUP BY ALL) SELECT repo_id, path, coalesce({_scalar('v')}, regexp_replace({_BASE}, '(?i)\.ya?ml$', '')) AS name, n_lines FROM f",
    "x12_workflow_triggers": rf"""WITH {_FILES_OF(_WORKFLOW)}, i AS (SELECT *, {_scalar(_ON)} AS v, regexp_extract(line, '^\s{{2,}}([A-Za-z_][\w-]*)\s*:', 1) AS b FROM w),
e AS (SELECT repo_id, path, n, line, unnest(list_append(CASE WHEN v LIKE '[%]' THEN list_transform(string_split(v[2:-2], ','), lambda x: {_scalar('x')}) WHEN v IS NOT NULL THEN [v] ELSE [] END, b)) AS event FROM i)
SELECT repo_id, path, event, max(n) AS n, {_evidence('workflow-trigger', 'arg_max(line, n)')} AS evidence_id FROM e WHERE event IN ({_IN(workflows.EVENTS)}) GROUP BY repo_id, path, event""",
    "x13_p29_workflow_steps": f"WITH {_STEPS} SELECT repo_id, path, n, step_id, coalesce(above, uses, run) AS name, uses, run, regexp_matches(uses, '(?i)@[0-9a-f]{{40}}$') AS pinned, {_evidence('workflow-step', 'line')} AS evidence_id FROM s",
    "x14_token_permissions": f"WITH {_STEPS}, p AS (SELECT *, lower(regexp_extract(line, '{workflows.PERMISSION}', 1)) AS scope, lower(regexp_extract(line, '{workflows.PERMISSION}', 2)) AS access FROM w) SELECT p.repo_id, p.path, p.n, scope, access, f.step_id, {_evidence('workflow-token', 'line').replace('path', 'p.path')} AS evidence_id FROM p LEFT JOIN (SELECT repo_id, path, arg_min(step_id, n) AS step_id FROM s GROUP BY ALL) f ON f.repo_id = p.repo_id AND f.path = p.path WHERE scope <> ''",
    "x15_artifacts": f"WITH {_STEPS} SELECT repo_id, path, n, step_id, coalesce(next_name, next_path, 'artifact-' || step_id) AS name, next_path AS artifact_path FROM s WHERE contains(lower(uses), 'actions/upload-artifact')",
    "x16_x18_j12_infra_resources": f"WITH {_IAC}",
    "x02_code_patterns": rf"WITH {trees.LINES}, j AS (SELECT * FROM lines WHERE {_EXT} IN ({_IN(k for k, v in paths.SUPPORTED.items() if v in ('javascript', 'typescript'))})) SELECT repo_id, path, n, 'javascript-eval' AS rule_id, 'ERROR' AS severity FROM j WHERE regexp_matches(line, '(^|[^\w$.])eval\s*\(') UNION ALL SELECT repo_id, path, n, 'javascript-function-constructor', 'WARNING' FROM j WHERE regexp_matches(line, '\bnew\s+Function\s*\(')",
    "x03_x08_exposures": f"WITH {_CONTENT_SQL}",
    "x27_routing": f"WITH {trees.TREE} SELECT repo_id, count(*) FILTER (WHERE regexp_matches(path, '{paths.SOLIDITY}')) AS n_contracts, count(*) FILTER (WHERE {_CONTENT} OR {_HIDDEN}) AS n_content, count(*) FILTER (WHERE {_WORKFLOW}) AS n_workflows, count(*) FILTER (WHERE {_INFRA}) AS n_infra FROM tree GROUP BY repo_id",
    "a01_inventory": f"WITH {trees.TREE}, {_INVENTORY} SELECT * FROM inv",
    "a02_scan_plan": f"""WITH {trees.TREE}, {_INVENTORY}, c AS (SELECT * FROM (VALUES {_CHECK_ROWS}) AS v(ord, "check", tool, needs, why)),
p AS (SELECT repo_id, ord, "check", tool, why, CASE needs WHEN 'code' THEN n_code_files > 0 WHEN 'manifests' THEN len(package_manifests) > 0 WHEN 'workflows' THEN len(workflows) > 0 WHEN 'infra' THEN len(infra_files) > 0 ELSE true END AS applicable FROM inv, c)
SELECT repo_id, ord, "check", tool, applicable, true AS required, true AS implemented, CASE WHEN NOT applicable THEN why END AS reason FROM p""",
    "a09_language_support": f"""WITH {trees.TREE}, l AS (SELECT repo_id, CASE WHEN CASE {_EXT} {_CASE(paths.SUPPORTED)} END IS NOT NULL THEN 's' ELSE 'u' END AS kind, coalesce(CASE {_EXT} {_CASE(paths.SUPPORTED)} END, CASE {_EXT} {_CASE(paths.UNSUPPORTED)} END) AS language FROM tree),
c AS (SELECT repo_id, kind, language, count(*) AS files FROM l WHERE language IS NOT NULL GROUP BY ALL), a AS (SELECT r.repo_id, {_COUNTS('s')} AS supported, {_COUNTS('u')} AS unsupported, coalesce(sum(files), 0)::BIGINT AS n_source_files FROM (SELECT DISTINCT repo_id FROM tree) r LEFT JOIN c ON c.repo_id = r.repo_id GROUP BY r.repo_id)
SELECT *, CASE WHEN supported <> [] AND unsupported <> [] THEN 'partial' WHEN supported <> [] THEN 'checked' WHEN unsupported <> [] THEN 'degraded' ELSE 'skipped' END AS state FROM a""",
    "s03_s04_limits": f"WITH RECURSIVE {trees.TREE}, {_GREEDY} SELECT repo_id, path, reason FROM x",
    "a07_manifest_counts": f"WITH RECURSIVE {trees.TREE}, {_GREEDY} SELECT t.repo_id, count(*) FILTER (WHERE x.path IS NULL) AS n_files, coalesce(sum(size) FILTER (WHERE x.path IS NULL), 0)::BIGINT AS bytes, count(x.path) AS n_exclusions FROM tree t LEFT JOIN x ON x.repo_id = t.repo_id AND x.path = t.path GROUP BY t.repo_id",
    "s02_tree_hash": f"WITH RECURSIVE {trees.TREE}, {_GREEDY} SELECT t.repo_id, count(*) AS n_files, sha256(string_agg(t.path || chr(0) || sha256(text) || chr(0) || size || chr(10), '' ORDER BY t.path)) AS source_hash FROM tree t LEFT JOIN x ON x.repo_id = t.repo_id AND x.path = t.path WHERE x.path IS NULL GROUP BY t.repo_id",
}
