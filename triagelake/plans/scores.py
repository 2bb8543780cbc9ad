"""Registered queries of reports against truth: orders are findings and hypotheses, parts are what was labelled."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.operators import truth as tr

O, C, P = "o_orderkey", "o_custkey", "p_partkey"
REPO = f"'r' || CAST(floor({P} / 3) AS BIGINT)"


def _list(engine: str, *items: str) -> str:
    return f"array({', '.join(items)})" if engine == "spark" else f"[{', '.join(items)}]"


def _tables(engine: str) -> dict[str, tuple[str, str, dict[str, str]]]:
    a = lambda *x: _list(engine, *x)
    package = f"map('packageName', 'pkg' || ({O} % 9))" if engine == "spark" else f"MAP {{'packageName': 'pkg' || ({O} % 9)}}"
    matcher = {"tool": f"CASE WHEN {P} % 4 = 0 THEN 'tool' || ({P} % 3) END", "rule_id": f"CASE WHEN {P} % 3 > 0 THEN 'R' || ({P} % 5) END", "category": f"CASE WHEN {P} % 3 = 0 THEN 'cat' || ({P} % 2) END", "severities": f"CASE WHEN {P} % 5 = 0 THEN {a(repr('high'), repr('low'))} END", "path_part": f"CASE WHEN {P} % 7 = 0 THEN 'a' || ({P} % 3) END", "package": f"CASE WHEN {P} % 13 = 0 THEN 'pkg' || ({P} % 9) END"}
    said = {"family": f"CASE WHEN {P} % 4 = 1 THEN 'fam' || ({P} % 3) END", "candidate_family": f"'fam' || ({P} % 3)", "rule_id": f"CASE WHEN {P} % 3 = 1 THEN 'hr' || ({P} % 2) END", "title_parts": f"CASE WHEN {P} % 5 = 0 THEN {a(repr('Path'), f"'of ' || ({P} % 4)")} END", "reason_part": f"CASE WHEN {P} % 6 = 0 THEN 'because ' || ({P} % 6) END", "statuses": f"CASE WHEN {P} % 8 = 0 THEN {a(repr('statically_supported'))} END"}
    item = {"repo_id": REPO, "item_ord": P, "item_id": f"'t' || {P}", "in_scope": f"{P} % 11 > 0", "coverage_area": f"'area' || ({P} % 3)"}
    record = {"repo_id": f"'r' || {C}", "family": f"'fam' || ({O} % 3)", "rule_id": f"'hr' || ({O} % 2)", "reason": f"'because ' || ({O} % 6)"}
    return {
        "findings": ("orders", "true", {"repo_id": f"'r' || {C}", "finding_ord": O, "finding_id": f"'f' || {O}", "tool": f"'tool' || ({O} % 3)", "rule_id": f"'R' || ({O} % 5)", "category": f"'cat' || ({O} % 2)", "severity": f"CASE {O} % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END", "paths": a(f"'src/a' || ({O} % 4)", f"'lib/b' || ({O} % 2)"), "metadata": package}),
        "truth": ("part", "true", item | matcher), "uncurated": ("part", f"{P} % 7 = 2", item | matcher | {"item_id": f"'u' || {P}", "rule_id": f"'R' || (({P} + 1) % 5)"}),
        "static_truth": ("part", "true", item | said), "false_support": ("part", f"{P} % 5 = 3", item | said | {"item_id": f"'w' || {P}", "candidate_family": f"'fam' || (({P} + 1) % 3)", "family": "CAST(NULL AS STRING)" if engine == "spark" else "NULL::VARCHAR"}),
        "hypotheses": ("orders", f"{O} % 2 = 0", record | {"ord": O, "hypothesis_id": f"'h' || {O}", "title": f"'Path ' || ({O} % 7) || ' of ' || ({O} % 4)", "status": f"CASE {O} % 5 WHEN 0 THEN 'statically_contradicted' WHEN 1 THEN 'candidate' ELSE 'statically_supported' END"}),
        "candidates": ("orders", f"{O} % 3 > 0", record | {"ord": O, "candidate_id": f"'k' || {O}"}),
        "repositories": ("customer", "true", {"repo_id": "'r' || c_custkey", "direct_truth": "c_custkey % 4 > 0", "direct_review": "c_custkey % 5 > 0", "static_truth": "c_custkey % 3 > 0", "static_review": "c_custkey % 6 > 0", "split": "CASE c_custkey % 5 WHEN 0 THEN 'canary' WHEN 1 THEN 'tuning' ELSE 'held-out' END"}),
        "areas": ("orders", "true", {"repo_id": f"'r' || {C}", "area": f"CASE {O} % 4 WHEN 3 THEN 'dependency_usage' ELSE 'area' || ({O} % 4) END", "state": f"CASE {O} % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' ELSE 'checked' END", "covered": f"CASE WHEN {O} % 5 > 0 THEN CAST({O} % 6 AS BIGINT) END", "total": f"CASE WHEN {O} % 9 > 0 THEN CAST({O} % 8 AS BIGINT) END", "reason": f"CASE WHEN {O} % 3 = 0 THEN 'no ' || ({O} % 11) END", "ord": O}),
        "wanted": ("part", "true", {"repo_id": f"'r' || {P}", "area": f"'area' || ({P} % 4)", "states": f"CASE WHEN {P} % 2 = 0 THEN {a(repr('checked'), repr('partial'))} END", "min_covered": f"CASE WHEN {P} % 3 = 0 THEN CAST({P} % 7 AS BIGINT) END", "min_total": f"CASE WHEN {P} % 5 = 0 THEN CAST({P} % 9 AS BIGINT) END", "complete": f"{P} % 4 = 1", "reason_part": f"CASE WHEN {P} % 6 = 0 THEN 'no 1' END"}),
        "counts": ("part", "true", {"repo_id": f"'r' || {P}", "min_findings": f"CASE WHEN {P} % 2 = 0 THEN CAST({P} % 20 AS BIGINT) END", "min_candidates": f"CASE WHEN {P} % 3 = 0 THEN CAST({P} % 12 AS BIGINT) END", "min_supported": f"CASE WHEN {P} % 5 = 0 THEN CAST({P} % 6 AS BIGINT) END", "fam": f"'fam' || ({P} % 4)", "fam_n": f"CAST({P} % 5 AS BIGINT)"}),
        "items": ("part", "true", {"repo_id": REPO, "item_id": f"'t' || {P}", "expected": f"CASE WHEN {P} % 4 = 0 THEN 'known_gap' ELSE 'covered' END", "min_count": f"CASE WHEN {P} % 3 = 0 THEN CAST(2 AS BIGINT) END"}),
    }


_SQL = {n: f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM {t} WHERE {w})" for n, (t, w, cols) in _tables("duckdb").items()}
_COV = f"{_SQL['areas']}, coverage AS (SELECT repo_id, area, true AS deep, state, covered, total, reason FROM areas QUALIFY row_number() OVER (PARTITION BY repo_id, area ORDER BY ord) = 1)"


def table(s, d, name):
    source, where, columns = _tables("spark")[name]
    return s.read.parquet(f"{d}/{source}.parquet").where(where).selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def coverage(s, d):
    """The first entry of each area of a repository."""
    first = F.min_by(F.struct("state", "covered", "total", "reason"), "ord").alias("x")
    return table(s, d, "areas").groupBy("repo_id", "area").agg(first).select("repo_id", "area", F.lit(True).alias("deep"), "x.*")


def _of(s, d, *names):
    return [coverage(s, d) if n == "coverage" else table(s, d, n) for n in names]


def _direct(s, d):
    return tr.direct_scores(*_of(s, d, "repositories", "truth", "findings", "uncurated", "coverage"))


def _static(s, d):
    return tr.static_scores(*_of(s, d, "repositories", "static_truth", "candidates", "hypotheses", "false_support", "coverage"))


def _both(s, d):
    static = _static(s, d).select("repo_id", "supported_tp", "false_support", "candidate_tp", "candidate_fn")
    return table(s, d, "repositories").select("repo_id", "split").join(_direct(s, d).select("repo_id", "tp", "fp", "fn"), "repo_id").join(static, "repo_id")


def _summary(s, d):
    return tr.report_summary(*_of(s, d, "findings", "candidates", "hypotheses"))


def _expected(s, d):
    rows = table(s, d, "counts")
    return rows.withColumn("min_families", F.create_map("fam", "fam_n")).drop("fam", "fam_n")


def _verdicts(s, d):
    return table(s, d, "repositories").where("NOT split = 'tuning'").select("repo_id", F.when(F.col("direct_truth"), "not-ready-to-deploy").otherwise("looks-ok-for-now").alias("verdict"))


QUERIES = {
    "p25_finding_matches": lambda s, d: tr.finding_pairs(*_of(s, d, "truth", "findings")),
    "p26_hypothesis_matches": lambda s, d: tr.hypothesis_pairs(*_of(s, d, "static_truth", "hypotheses")),
    "b11_recallable": lambda s, d: tr.recallable(*_of(s, d, "truth", "coverage")).select("repo_id", "item_id", "verdict"),
    "b01_direct_scores": _direct,
    "b02_b03_static_scores": _static,
    "b07_b08_all_targets": lambda s, d: tr.rolled_up(_both(s, d)),
    "b09_split_gap": lambda s, d: tr.split_gap(_both(s, d)),
    "b10_coverage_gates": lambda s, d: tr.coverage_errors(*_of(s, d, "coverage", "wanted")),
    "b12_verdicts": lambda s, d: tr.verdict_errors(_verdicts(s, d), table(s, d, "repositories").select("repo_id", F.when(F.col("static_truth"), F.array(F.lit("not-ready-to-deploy"))).otherwise(F.array(F.lit("looks-ok-for-now"), F.lit("scan-incomplete"))).alias("verdicts"))),
    "b13_expectations": lambda s, d: tr.expectation_errors(_summary(s, d), _expected(s, d)),
    "b14_ground_truth": lambda s, d: tr.ground_truth(table(s, d, "items"), tr.finding_pairs(*_of(s, d, "truth", "findings")).groupBy("repo_id", "item_id").agg(F.count("*").alias("n"))),
    "a18_a19_report_summary": lambda s, d: _summary(s, d).select("repo_id", "findings", "candidates", "hypotheses", "supported", F.array_join(F.transform(F.array_sort(F.map_entries("families")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ").alias("families")),
}
_PAIRS = lambda t, f: f"""SELECT t.repo_id, t.item_ord, t.item_id, f.finding_ord, f.finding_id FROM {t} t JOIN {f} f ON t.repo_id = f.repo_id AND (t.tool IS NULL OR t.tool = f.tool) AND (t.rule_id IS NULL OR t.rule_id = f.rule_id) AND (t.category IS NULL OR t.category = f.category) AND (t.severities IS NULL OR list_contains(t.severities, f.severity))
  AND (t.path_part IS NULL OR len(list_filter(f.paths, lambda p: contains(p, t.path_part))) > 0) AND (t.package IS NULL OR t.package = f.metadata['packageName'])"""  # noqa: E731
_HPAIRS = lambda t, h: f"""SELECT t.repo_id, t.item_ord, t.item_id, h.ord AS finding_ord, h.hypothesis_id AS finding_id FROM {t} t JOIN {h} h ON t.repo_id = h.repo_id AND coalesce(t.family, t.candidate_family) = h.family AND (t.rule_id IS NULL OR t.rule_id = h.rule_id)
  AND (t.title_parts IS NULL OR len(list_filter(t.title_parts, lambda p: NOT contains(h.title, p))) = 0) AND (t.reason_part IS NULL OR contains(h.reason, t.reason_part)) AND (t.statuses IS NULL OR list_contains(t.statuses, h.status))"""  # noqa: E731
_JUDGED = lambda t, ok: f"SELECT t.*, CASE WHEN NOT in_scope THEN 'out_of_scope' WHEN NOT coalesce({ok}, false) THEN 'coverage_loss' ELSE 'asked' END AS verdict FROM {t} t LEFT JOIN coverage c ON c.repo_id = t.repo_id AND c.area = t.coverage_area"
_MATCH = lambda pairs, name: f"""{name}_p AS ({pairs}), {name}_l AS (SELECT repo_id, item_ord, item_id, list(finding_id ORDER BY finding_ord) AS found, row_number() OVER (PARTITION BY repo_id ORDER BY item_ord) AS k FROM {name}_p GROUP BY repo_id, item_ord, item_id),
{name}_g AS (SELECT DISTINCT repo_id, 0::BIGINT AS k, ''::VARCHAR AS item_id, NULL::VARCHAR AS pick, []::VARCHAR[] AS taken FROM {name}_l UNION ALL SELECT l.repo_id, l.k, l.item_id, list_filter(l.found, lambda x: NOT list_contains(g.taken, x))[1], list_append(g.taken, coalesce(list_filter(l.found, lambda x: NOT list_contains(g.taken, x))[1], '')) FROM {name}_g g JOIN {name}_l l ON l.repo_id = g.repo_id AND l.k = g.k + 1),
{name} AS (SELECT repo_id, item_id, pick AS finding_id FROM {name}_g WHERE pick IS NOT NULL)"""  # noqa: E731
_N = lambda source, test, name: f"(SELECT count(*) FROM {source} x WHERE x.repo_id = r.repo_id AND {test}) AS {name}"
_DIRECT = f"""{', '.join(_SQL[n] for n in ('repositories', 'truth', 'findings', 'uncurated'))}, {_COV}, judged AS ({_JUDGED('truth', "c.state = 'checked'")}), {_MATCH(_PAIRS("(SELECT * FROM judged WHERE verdict = 'asked')", 'findings'), 'took')},
unc AS (SELECT DISTINCT repo_id, finding_id FROM ({_PAIRS('uncurated', 'findings')})), rest AS (SELECT f.repo_id, f.finding_id, EXISTS (SELECT 1 FROM unc u WHERE u.repo_id = f.repo_id AND u.finding_id = f.finding_id) AS known FROM findings f WHERE NOT EXISTS (SELECT 1 FROM took t WHERE t.repo_id = f.repo_id AND t.finding_id = f.finding_id)),
n AS (SELECT r.*, {_N('took', 'true', 'tp')}, {_N('judged', "x.verdict = 'asked'", 'na')}, {_N('judged', "x.verdict = 'coverage_loss'", 'coverage_loss')}, {_N('judged', "x.verdict = 'out_of_scope'", 'out_of_scope')}, {_N('rest', 'x.known', 'true_but_uncurated')}, {_N('rest', 'NOT x.known', 'others')} FROM repositories r),
m AS (SELECT *, na - tp AS fn, CASE WHEN direct_truth AND direct_review THEN others ELSE 0 END AS fp, CASE WHEN direct_truth AND direct_review THEN 0 ELSE others END AS unreviewed FROM n),
v AS (SELECT *, CASE WHEN direct_truth AND direct_review AND tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN direct_truth AND tp + fn > 0 THEN tp / (tp + fn) END AS recall FROM m),
direct AS (SELECT repo_id, split, tp, fp, fn, coverage_loss, out_of_scope, true_but_uncurated, unreviewed, precision, recall, CASE WHEN 0.25 * precision + recall = 0 THEN 0.0 ELSE 1.25 * precision * recall / (0.25 * precision + recall) END AS f_half,
  CASE WHEN NOT direct_truth OR NOT direct_review THEN concat_ws('; ', CASE WHEN NOT direct_truth THEN '{tr.INCOMPLETE['direct_truth']}' END, CASE WHEN NOT direct_review THEN '{tr.INCOMPLETE['direct_review']}' END) WHEN tp + fp = 0 THEN '{tr.NO_DENOMINATOR}' ELSE '' END AS precision_blocked_by, CASE WHEN NOT direct_truth THEN '{tr.INCOMPLETE['direct_truth']}' WHEN tp + fn = 0 THEN '{tr.NO_DENOMINATOR}' ELSE '' END AS recall_blocked_by FROM v)"""
_STATIC = f"""{', '.join(_SQL[n] for n in ('static_truth', 'candidates', 'hypotheses', 'false_support'))}, sj AS ({_JUDGED('static_truth', "c.state NOT IN ('failed', 'partial')")}),
seen AS (SELECT DISTINCT t.repo_id, t.item_id FROM sj t JOIN candidates h ON t.repo_id = h.repo_id AND coalesce(t.family, t.candidate_family) = h.family AND (t.rule_id IS NULL OR t.rule_id = h.rule_id) AND (t.reason_part IS NULL OR contains(h.reason, t.reason_part))), against AS (SELECT DISTINCT repo_id, item_id FROM ({_HPAIRS('sj', "(SELECT * FROM hypotheses WHERE status = 'statically_contradicted')")})),
sup AS (SELECT * FROM hypotheses WHERE status = 'statically_supported'), {_MATCH(_HPAIRS('static_truth', 'sup'), 'held')}, wrong AS (SELECT DISTINCT repo_id, finding_id FROM ({_HPAIRS('false_support', 'sup')})),
sl AS (SELECT s.repo_id, EXISTS (SELECT 1 FROM wrong w WHERE w.repo_id = s.repo_id AND w.finding_id = s.hypothesis_id) AS wrong FROM sup s WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.repo_id = s.repo_id AND h.finding_id = s.hypothesis_id)),
sn AS (SELECT r.*, {_N("(SELECT * FROM sj JOIN seen USING (repo_id, item_id))", "x.verdict = 'asked'", 'candidate_tp')}, {_N('sj', "x.verdict = 'asked'", 'na')}, {_N("(SELECT * FROM sj JOIN against USING (repo_id, item_id))", "x.verdict = 'asked'", 'false_contradiction')}, {_N('sj', "x.verdict = 'coverage_loss'", 'coverage_loss')}, {_N('sj', "x.verdict = 'out_of_scope'", 'out_of_scope')}, {_N('held', 'true', 'supported_tp')}, {_N('sl', 'x.wrong', 'w')}, {_N('sl', 'NOT x.wrong', 'others')} FROM repositories r),
sm AS (SELECT *, na - candidate_tp AS candidate_fn, w + CASE WHEN static_review THEN others ELSE 0 END AS false_support, CASE WHEN static_review THEN 0 ELSE others END AS unreviewed FROM sn),
static AS (SELECT repo_id, candidate_tp, candidate_fn, supported_tp, false_support, false_contradiction, coverage_loss, out_of_scope, unreviewed, CASE WHEN static_truth AND na > 0 THEN candidate_tp / na END AS candidate_recall, CASE WHEN static_review AND supported_tp + false_support > 0 THEN supported_tp / (supported_tp + false_support) END AS support_precision,
  CASE WHEN NOT static_truth THEN '{tr.INCOMPLETE['static_truth']}' WHEN na = 0 THEN '{tr.NO_DENOMINATOR}' ELSE '' END AS recall_blocked_by, CASE WHEN NOT static_review THEN '{tr.INCOMPLETE['static_review']}' WHEN supported_tp + false_support = 0 THEN '{tr.NO_DENOMINATOR}' ELSE '' END AS precision_blocked_by FROM sm)"""
_BELOW = lambda have, want, what, head="": f"CASE WHEN coalesce({have}, 0) < {want} THEN {head}'{what} below expectation: ' || coalesce({have}, 0) || '/' || {want} END"
_HEAD = "'coverage ' || w.area || ' ' || "
_SUMMARY = f"""{', '.join(_SQL[n] for n in ('findings', 'candidates', 'hypotheses'))}, fam AS (SELECT repo_id, family, count(*) AS n FROM candidates GROUP BY ALL), ids AS (SELECT repo_id FROM findings UNION SELECT repo_id FROM candidates UNION SELECT repo_id FROM hypotheses),
summary AS (SELECT repo_id, (SELECT count(*) FROM findings x WHERE x.repo_id = i.repo_id) AS findings, (SELECT count(*) FROM candidates x WHERE x.repo_id = i.repo_id) AS candidates, (SELECT count(*) FROM hypotheses x WHERE x.repo_id = i.repo_id) AS hypotheses, (SELECT count(*) FROM hypotheses x WHERE x.repo_id = i.repo_id AND status = 'statically_supported') AS supported, (SELECT string_agg(family || '=' || n, ', ' ORDER BY family) FROM fam x WHERE x.repo_id = i.repo_id) AS families FROM ids i)"""
ORACLE_SQL = {
    "p25_finding_matches": f"WITH {_SQL['truth']}, {_SQL['findings']} {_PAIRS('truth', 'findings')}",
    "p26_hypothesis_matches": f"WITH {_SQL['static_truth']}, {_SQL['hypotheses']} {_HPAIRS('static_truth', 'hypotheses')}",
    "b11_recallable": f"WITH {_SQL['truth']}, {_COV}, judged AS ({_JUDGED('truth', "c.state = 'checked'")}) SELECT repo_id, item_id, verdict FROM judged",
    "b01_direct_scores": f"WITH RECURSIVE {_DIRECT} SELECT * EXCLUDE (split) FROM direct",
    "b02_b03_static_scores": f"WITH RECURSIVE {_DIRECT}, {_STATIC} SELECT * FROM static",
    "b09_split_gap": f"""WITH RECURSIVE {_DIRECT}, {_STATIC}, t AS (SELECT split, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(supported_tp) AS st, sum(false_support) AS fs, sum(candidate_tp) AS ct, sum(candidate_fn) AS cf FROM direct d JOIN static s ON s.repo_id = d.repo_id WHERE split IN ('tuning', 'held-out') GROUP BY split),
each_metric AS (SELECT split, unnest(['a', 'b', 'c', 'd']) AS metric, unnest([tp / nullif(tp + fp, 0), tp / nullif(tp + fn, 0), st / nullif(st + fs, 0), ct / nullif(ct + cf, 0)]) AS v FROM t), both_splits AS (SELECT metric, max(v) - min(v) AS apart, count(v) AS n FROM each_metric GROUP BY metric)
SELECT CASE WHEN count(*) = 4 AND min(n) = 2 THEN max(apart) END AS gap, coalesce(CASE WHEN count(*) = 4 AND min(n) = 2 THEN max(apart) END <= 0.1, false) AS passed FROM both_splits""",
    "b07_b08_all_targets": f"""WITH RECURSIVE {_DIRECT}, {_STATIC}, t AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(supported_tp) AS st, sum(false_support) AS fs, sum(candidate_tp) AS ct, sum(candidate_fn) AS cf FROM direct d JOIN static s ON s.repo_id = d.repo_id WHERE split <> 'canary'),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS rc FROM t), e AS (SELECT unnest([{{'metric': 'direct_precision', 'value': pr, 'target': 0.9}}, {{'metric': 'direct_recall', 'value': rc, 'target': 0.85}}, {{'metric': 'direct_f_half', 'value': CASE WHEN 0.25 * pr + rc = 0 THEN 0.0 ELSE 1.25 * pr * rc / (0.25 * pr + rc) END, 'target': 0.88}},
  {{'metric': 'support_precision', 'value': CASE WHEN st + fs > 0 THEN st / (st + fs) END, 'target': 0.8}}, {{'metric': 'candidate_recall', 'value': CASE WHEN ct + cf > 0 THEN ct / (ct + cf) END, 'target': 0.8}}]) AS x FROM p) SELECT x.metric, x.value, coalesce(x.value >= x.target, false) AS passed FROM e""",
    "b10_coverage_gates": f"""WITH {_COV}, {_SQL['wanted']}, e AS (SELECT w.repo_id, CASE WHEN c.state IS NULL THEN ['missing expected coverage area: ' || w.area] ELSE [CASE WHEN states IS NOT NULL AND NOT list_contains(states, c.state) THEN {_HEAD}'state ' || c.state || ' not in ' || array_to_string(states, ', ') END, {_BELOW('c.covered', 'min_covered', 'coveredCount', _HEAD)}, {_BELOW('c.total', 'min_total', 'totalCount', _HEAD)},
  CASE WHEN complete AND c.total IS NOT NULL AND c.covered IS DISTINCT FROM c.total THEN {_HEAD}'is incomplete: ' || coalesce(c.covered, 0) || '/' || c.total END, CASE WHEN reason_part IS NOT NULL AND NOT coalesce(contains(c.reason, reason_part), false) THEN {_HEAD}'reason does not include ' || reason_part END] END AS es FROM wanted w LEFT JOIN coverage c ON c.repo_id = w.repo_id AND c.area = w.area)
SELECT repo_id, error FROM (SELECT repo_id, unnest(es) AS error FROM e) WHERE error IS NOT NULL UNION ALL SELECT repo_id, 'deep coverage failed for ' || area || coalesce(': ' || reason, '') FROM coverage WHERE state = 'failed' UNION ALL SELECT repo_id, 'dependency_usage is incomplete: ' || coalesce(covered, 0) || '/' || total FROM coverage WHERE area = 'dependency_usage' AND total > 0 AND covered IS DISTINCT FROM total""",
    "b12_verdicts": f"WITH {_SQL['repositories']}, v AS (SELECT repo_id, CASE WHEN split = 'tuning' THEN 'missing' WHEN direct_truth THEN 'not-ready-to-deploy' ELSE 'looks-ok-for-now' END AS actual, CASE WHEN static_truth THEN ['not-ready-to-deploy'] ELSE ['looks-ok-for-now', 'scan-incomplete'] END AS vs FROM repositories) SELECT repo_id, array_to_string(vs, ', ') AS expected, actual FROM v WHERE NOT list_contains(vs, actual)",
    "b13_expectations": f"""WITH {_SUMMARY}, {_SQL['counts']}, e AS (SELECT c.repo_id, unnest([{_BELOW('s.findings', 'min_findings', 'findings')}, {_BELOW('s.candidates', 'min_candidates', 'hypothesisCandidates')}, {_BELOW('s.supported', 'min_supported', 'supported hypotheses')}, CASE WHEN coalesce(f.n, 0) < fam_n THEN 'family ' || fam || ' below expectation: ' || coalesce(f.n, 0) || '/' || fam_n END]) AS error FROM counts c LEFT JOIN summary s ON s.repo_id = c.repo_id LEFT JOIN fam f ON f.repo_id = c.repo_id AND f.family = c.fam) SELECT * FROM e WHERE error IS NOT NULL""",
    "b14_ground_truth": f"""WITH {_SQL['truth']}, {_SQL['findings']}, {_SQL['items']}, m AS (SELECT repo_id, item_id, count(*) AS n FROM ({_PAIRS('truth', 'findings')}) GROUP BY ALL), j AS (SELECT i.*, coalesce(n, 0) >= coalesce(min_count, 1) AS ok FROM items i LEFT JOIN m ON m.repo_id = i.repo_id AND m.item_id = i.item_id)
SELECT repo_id, count(*) AS total, count(*) FILTER (WHERE expected = 'covered' AND ok) AS passed, count(*) FILTER (WHERE expected <> 'covered' AND NOT ok) AS known_gaps, count(*) FILTER (WHERE expected = 'covered' AND NOT ok) AS failed, count(*) FILTER (WHERE expected <> 'covered' AND ok) AS resolved FROM j GROUP BY repo_id""",
    "a18_a19_report_summary": f"WITH {_SUMMARY} SELECT * FROM summary",
}
