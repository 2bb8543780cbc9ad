"""Registered queries of scanner reports and dependencies: an order is a report, its line items are its records."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.functions import paths
from triagelake.operators import dependencies
from triagelake.sources import reports as rp
from triagelake.sources import trees

from .files import _MANIFEST

K, P, L, Q = "l_orderkey", "l_partkey", "l_linenumber", "CAST(l_quantity AS INT)"
#: Facts of a record, by expressions that both engines read.
FACTS = {
    "repo_id": "'repo' || (o_custkey % 23)", "report_id": K, "kind": f"{K} % 7", "nth": L,
    "rule": f"CASE WHEN {P} % 9 = 0 THEN NULL ELSE 'RULE-' || ({P} % 31) END", "other_rule": f"CASE WHEN {P} % 9 = 0 THEN 'ALT-' || {L} END",
    "package": f"CASE WHEN {P} % 6 = 0 THEN 'org/sub/p' || ({P} % 40) ELSE 'p' || ({P} % 40) END", "version": f"{Q} || '.' || ({P} % 4) || '.0'", "fixed": f"CASE WHEN {P} % 5 = 0 THEN '' WHEN {P} % 5 < 3 THEN {Q} || '.9.9' END",
    "severity": f"CASE {P} % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'low' WHEN 2 THEN 'Critical' END", "line_no": f"CASE WHEN {P} % 8 > 0 THEN {Q} + {L} END",
    "path": f"CASE {K} % 5 WHEN 0 THEN 'svc' || ({P} % 50) || '/pom.xml' WHEN 1 THEN './a/b' || ({P} % 9) || '.ts' WHEN 2 THEN '../up' WHEN 3 THEN '/work/source/c' || {L} || '.py' ELSE '' END",
    "safe_path": f"CASE {K} % 5 WHEN 0 THEN 'svc' || ({P} % 50) || '/pom.xml' WHEN 1 THEN 'a/b' || ({P} % 9) || '.ts' WHEN 3 THEN 'c' || {L} || '.py' END",
    "ecosystem": f"CASE {P} % 7 WHEN 0 THEN 'maven' WHEN 1 THEN 'npm' WHEN 2 THEN 'golang' WHEN 3 THEN 'pypi' WHEN 4 THEN 'deb' END", "message": f"'found ' || ({P} % 100)",
}
_FACT = f"fact AS (SELECT {', '.join(f'{e} AS {n}' for n, e in FACTS.items())} FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
#: Tools by kind of report.
TOOLS = ((0, "dependencies.trivy", "trivy"), (1, "dependencies.osv", "osv"), (2, "github-actions.actionlint", "actionlint"), (3, "github-actions.zizmor", "zizmor"), (4, "iac.trivy-config", "trivy"), (5, "sbom.syft", "syft"), (6, "code-patterns.opengrep", "opengrep"))


def _facts(s, d):
    items, orders = (s.read.parquet(f"{d}/{t}.parquet") for t in ("lineitem", "orders"))
    return items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).selectExpr(*(f"{e} AS {n}" for n, e in FACTS.items()))


def _st(**values):
    return F.struct(*((v if not isinstance(v, str) else F.col(v)).alias(k) for k, v in values.items()))


def _of(fact, **values):
    """A struct of a fact's fields, by name, and of other columns."""
    return _st(**{k: fact[v] if isinstance(v, str) else v for k, v in values.items()})


def _vulnerability(f):
    cause = _of(f, Resource=F.when(f["nth"] % 2 == 0, f["path"]), StartLine="line_no")
    purl = F.when(f["ecosystem"].isNotNull(), F.concat(F.lit("pkg:"), f["ecosystem"], F.lit("/"), f["package"]))
    return _of(f, VulnerabilityID="rule", ID="other_rule", Title="message", PkgName="package", InstalledVersion="version", FixedVersion="fixed", Severity="severity", CauseMetadata=cause, PkgIdentifier=_st(PURL=purl))


def _reports(s, d, kind=None):
    """One report for each order, in the shape of its tool; some are fenced or stand inside other text, some are cut short.

    With a kind only reports of that kind, whose records are picked before they are shuffled.
    """
    items, orders = (s.read.parquet(f"{d}/{t}.parquet") for t in ("lineitem", "orders"))
    facts = items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).selectExpr(*(f"{FACTS[n]} AS {n}" for n in ("repo_id", "report_id", "kind")), f"struct({L}, {P}, l_quantity) AS item")
    facts = facts if kind is None else facts.where(F.col("kind") == kind)
    # numbers are grouped; texts are made of them afterwards, and only those of the report's own shape
    rows = facts.groupBy("repo_id", "report_id", "kind").agg(F.collect_list("item").alias("items"))
    of_item = {n: e.replace(K, "report_id").replace(P, f"x.{P}").replace(L, f"x.{L}").replace("l_quantity", "x.l_quantity") for n, e in FACTS.items() if n not in ("repo_id", "report_id", "kind")}
    rows = rows.withColumn("facts", F.expr(f"transform(items, x -> struct({', '.join(f'{e} AS {n}' for n, e in of_item.items())}))"))
    listed = lambda record: F.array_sort(F.transform("facts", lambda f: F.struct(f["nth"].alias("nth"), record(f).alias("r"))))
    bare = lambda records: F.transform(records, lambda x: x["r"])
    trivy, parts = listed(_vulnerability), listed(lambda f: _of(f, name="package", version="version", purl=F.concat(F.lit("pkg:npm/"), f["package"])))
    osv = listed(lambda f: _of(f, packageName=F.when(f["nth"] != 3, f["package"]), version="version", target="path", vulns=F.array(_of(f, id="rule"), _st(id=F.lit("GHSA")))))
    lint = listed(lambda f: _of(f, kind=F.when(f["nth"] % 2 == 0, f["rule"]), Kind=F.when(f["nth"] % 2 != 0, f["rule"]), message="message", filepath="path", Line="line_no"))
    zizmor = listed(lambda f: _of(f, ident="rule", desc="message", determinations=_of(f, severity="severity"), locations=F.array(_of(f, file="path", start_line="line_no"))))
    sarif = listed(lambda f: _of(f, ruleId="rule", level="severity", message=_of(f, text="message"), locations=F.array(_st(physicalLocation=_st(artifactLocation=_of(f, uri="path"), region=_of(f, startLine="line_no"))))))
    odd, even = bare(F.filter(trivy, lambda x: x["nth"] % 2 == 1)), bare(F.filter(trivy, lambda x: x["nth"] % 2 == 0))
    shapes = (_st(Results=F.array(_st(Target=F.lit("web/package.json"), Vulnerabilities=even, Misconfigurations=odd))), _st(results=bare(osv)), bare(lint), bare(zizmor), _st(Vulnerabilities=bare(trivy)), _st(components=bare(parts)), _st(runs=F.array(_st(results=bare(sarif)))))
    if kind is None:
        raw = F.to_json(shapes[6])
        for n, shape in enumerate(shapes[:6]):
            raw = F.when(F.col("kind") == n, F.to_json(shape)).otherwise(raw)
    else:
        raw = F.to_json(shapes[kind])
    k = F.col("report_id")
    raw = F.when(k % 17 == 0, F.substring(raw, 1, 30)).when(k % 5 == 0, F.concat(F.lit("Log:\n```json\n"), raw, F.lit("\n```\nend"))).when(k % 11 == 0, F.concat(F.lit("scan done: "), raw, F.lit(" (0 errors)"))).otherwise(raw)
    raw = F.when(k % 19 == 0, " ").when(k % 23 == 0, "17").otherwise(raw)
    tool = F.array(*(F.struct(F.lit(c).alias("check"), F.lit(t).alias("tool")) for _, c, t in TOOLS))[F.col("kind").cast("int")]
    return rows.select("repo_id", "report_id", tool["check"].alias("check"), tool["tool"].alias("tool"), raw.alias("raw"))


def _manifests(s, d):
    return trees.files(s, d).where(paths.is_manifest(F.col("path"))).select("repo_id", "path")


def _records(s, d, check):
    kind = next(k for k, c, _ in TOOLS if c == check)
    return rp.records(_reports(s, d, kind)).withColumn("ord", F.col("report_id") * 100 + F.col("ord"))


_OUT = ("repo_id", "rule_id", "message", "path", "CAST(coalesce(line_no, 0) AS BIGINT) AS line_no", "severity")


def _npm(s, d):
    """package.json files: the parts of an order as dependencies, in two scopes."""
    rows = _facts(s, d).where("nth <= 4").groupBy("repo_id", "report_id", "package", "nth").agg(F.min("version").alias("version"))
    wrote = F.when(F.col("nth") == 1, F.concat(F.lit("^"), "version")).when(F.col("nth") == 3, F.concat(F.lit("npm:real@"), "version")).otherwise(F.col("version"))
    one = F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.concat("package", F.lit("-"), F.col("nth").cast("string")), wrote))))
    text = F.to_json(_st(name=F.lit("x"), devDependencies=one, peerDependencies=one))
    return rows.groupBy("repo_id", "report_id").agg(text.alias("text")).select("repo_id", F.concat(F.when(F.col("report_id") % 6 == 0, "node_modules/").otherwise("apps/"), F.col("report_id").cast("string"), F.lit("/package.json")).alias("path"), "text")


def _graph_reports(s, d):
    """Package graphs: a package depends on the next; every third result has no edges."""
    grouped = _facts(s, d).groupBy("repo_id", "report_id").agg(F.array_sort(F.collect_set("nth")).alias("all"))

    def package(nth):
        name, follows = F.concat(F.lit("g"), nth.cast("string")), F.concat(F.lit("g"), (nth + 1).cast("string"), F.lit("@"), (nth + 1).cast("string"))
        return _st(ID=F.concat(name, F.lit("@"), nth.cast("string")), Name=F.when(nth % 2 == 0, name), Version=nth.cast("string"), Relationship=F.when(nth == 1, "direct"), DependsOn=F.when(F.col("report_id") % 3 != 0, F.array(follows)))

    target = F.when(F.col("report_id") % 4 == 0, "apps/none.lock").otherwise("../x")
    return grouped.select("repo_id", "report_id", F.to_json(_st(Results=F.array(_st(Target=target, Packages=F.transform("all", package))))).alias("raw"))


def _packages(s, d):
    rows = _facts(s, d)
    evidence = rows.where("nth = 1").groupBy("repo_id", "package").agg(F.min("report_id").alias("ord"), F.array_sort(F.collect_set(F.concat(F.lit("e"), F.col("report_id").cast("string")))).alias("evidence_ids"))
    names = rows.where("nth > 1").select("repo_id", F.expr("CASE WHEN nth % 2 = 0 THEN package ELSE 'sub/' || split(package, '/')[size(split(package, '/')) - 1] END").alias("name")).distinct()
    return names, evidence.withColumnRenamed("package", "package_name")


QUERIES = {
    "s05_s06_failures": lambda s, d: rp.failures(_reports(s, d)).select("repo_id", "report_id", "tool"),
    "s09_s13_trivy": lambda s, d: rp.trivy(_records(s, d, "dependencies.trivy"), _manifests(s, d)).selectExpr(*_OUT, "metadata['packageName'] AS package", "metadata['fixedVersion'] AS fixed"),
    "s09_trivy_config": lambda s, d: rp.trivy(_records(s, d, "iac.trivy-config"), _manifests(s, d)).selectExpr(*_OUT),
    "s10_osv": lambda s, d: rp.osv(_records(s, d, "dependencies.osv")).selectExpr(*_OUT),
    "s11_actionlint": lambda s, d: rp.actionlint(_records(s, d, "github-actions.actionlint")).selectExpr(*_OUT),
    "s12_zizmor": lambda s, d: rp.zizmor(_records(s, d, "github-actions.zizmor")).selectExpr(*_OUT),
    "s08_sarif": lambda s, d: rp.sarif(_records(s, d, "code-patterns.opengrep")).selectExpr(*_OUT),
    "s14_components": lambda s, d: rp.components(_records(s, d, "sbom.syft")),
    "s15_npm_dependencies": lambda s, d: dependencies.npm_dependencies(_npm(s, d)),
    "s16_advised": lambda s, d: dependencies.advised(dependencies.npm_dependencies(_npm(s, d)), _facts(s, d).where("rule IS NOT NULL").select(F.lit("npm").alias("ecosystem"), F.concat("package", F.lit("-2")).alias("name"), "version", F.col("rule").alias("advisory_id")).distinct()),
    "s17_s18_package_graph": lambda s, d: dependencies.package_graph(_graph_reports(s, d), _manifests(s, d)),
    "s19_package_evidence": lambda s, d: dependencies.evidence_for(*_packages(s, d)),
}
_GOOD = "good AS (SELECT *, report_id % 17 = 0 AND report_id % 19 > 0 AND report_id % 23 > 0 AS cut FROM fact WHERE report_id % 17 > 0 AND report_id % 19 > 0 AND report_id % 23 > 0)"
_MAN = f"man AS (SELECT repo_id, path FROM tree WHERE {_MANIFEST})"
_PREF = f"""pref AS (SELECT repo_id, ecosystem, arg_min(path, rank || path) AS manifest FROM man JOIN (VALUES {', '.join(f"('{e}', '{n}', {k})" for e, names in paths.PREFERRED.items() for k, n in enumerate(names))}) AS r(ecosystem, name, rank) ON string_split(path, '/')[-1] = name GROUP BY ALL), any_man AS (SELECT repo_id, min(path) AS manifest FROM man GROUP BY repo_id)"""
_NPM = f"""npm AS (SELECT repo_id, 'apps/' || report_id || '/package.json' AS path, package || '-' || nth AS name, min(version) AS version, 'devDependencies' AS scope FROM fact WHERE nth IN (2, 3, 4) AND report_id % 6 > 0 GROUP BY repo_id, report_id, package, nth)"""
_EV = """ev AS (SELECT repo_id, package AS pn, min(report_id) AS ord, list_sort(list(DISTINCT 'e' || report_id)) AS ids FROM fact WHERE nth = 1 GROUP BY ALL),
nm AS (SELECT DISTINCT repo_id, CASE WHEN nth % 2 = 0 THEN package ELSE 'sub/' || string_split(package, '/')[-1] END AS name FROM fact WHERE nth > 1)"""
ORACLE_SQL = {
    "s05_s06_failures": f"WITH {_FACT}, t AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{t}')" for k, _, t in TOOLS)}) AS v(kind, tool)) SELECT DISTINCT repo_id, report_id, tool FROM fact JOIN t USING (kind) WHERE report_id % 19 > 0 AND (report_id % 23 = 0 OR report_id % 17 = 0)",
    "s09_s13_trivy": f"""WITH {trees.TREE}, {_FACT}, {_GOOD}, {_MAN}, {_PREF}, c AS (SELECT *, CASE WHEN nth % 2 = 0 AND safe_path IS NOT NULL THEN safe_path ELSE 'web/package.json' END AS p FROM good WHERE kind = 0)
SELECT c.repo_id, coalesce(rule, other_rule) AS rule_id, message, coalesce(m.path, CASE WHEN c.ecosystem IN ('maven', 'npm', 'golang', 'pypi') THEN pref.manifest ELSE any_man.manifest END) AS path, coalesce(line_no, 0)::BIGINT AS line_no, severity, package, nullif(fixed, '') AS fixed
FROM c LEFT JOIN man m ON m.repo_id = c.repo_id AND m.path = c.p LEFT JOIN pref ON pref.repo_id = c.repo_id AND pref.ecosystem = c.ecosystem LEFT JOIN any_man ON any_man.repo_id = c.repo_id""",
    "s09_trivy_config": f"WITH {_FACT}, {_GOOD} SELECT repo_id, coalesce(rule, other_rule) AS rule_id, message, CASE WHEN nth % 2 = 0 THEN safe_path END AS path, coalesce(line_no, 0)::BIGINT AS line_no, severity FROM good WHERE kind = 4",
    "s10_osv": f"WITH {_FACT}, {_GOOD}, v AS (SELECT *, coalesce(rule, 'OSV') AS id FROM good WHERE kind = 1 UNION ALL SELECT *, 'GHSA' FROM good WHERE kind = 1) SELECT repo_id, id AS rule_id, CASE WHEN nth <> 3 THEN package || '@' || version || ' is affected by ' || id ELSE 'OSV reports ' || id END AS message, safe_path AS path, 0::BIGINT AS line_no, 'medium' AS severity FROM v",
    "s11_actionlint": f"WITH {_FACT}, {_GOOD} SELECT repo_id, rule AS rule_id, message, safe_path AS path, coalesce(line_no, 0)::BIGINT AS line_no, NULL AS severity FROM good WHERE kind = 2",
    "s12_zizmor": f"WITH {_FACT}, {_GOOD} SELECT repo_id, rule AS rule_id, message, safe_path AS path, coalesce(line_no, 0)::BIGINT AS line_no, severity FROM good WHERE kind = 3",
    "s08_sarif": f"WITH {_FACT}, {_GOOD} SELECT repo_id, rule AS rule_id, message, safe_path AS path, coalesce(line_no, 0)::BIGINT AS line_no, severity FROM good WHERE kind = 6",
    "s14_components": f"WITH {_FACT}, {_GOOD} SELECT repo_id, package AS name, version, 'pkg:npm/' || package AS purl FROM good WHERE kind = 5",
    "s15_npm_dependencies": f"WITH {_FACT}, {_NPM} SELECT * FROM npm",
    "s16_advised": f"WITH {_FACT}, {_NPM} SELECT npm.name, npm.version, npm.repo_id, path, scope, advisory_id FROM npm JOIN (SELECT DISTINCT package || '-2' AS name, version, rule AS advisory_id FROM fact WHERE rule IS NOT NULL) a ON a.name = npm.name AND a.version = npm.version",
    "s17_s18_package_graph": f"""WITH {trees.TREE}, {_FACT}, man AS (SELECT repo_id, path FROM tree WHERE {_MANIFEST} AND regexp_matches(path, '{dependencies.GRAPH_MANIFESTS}')), any_man AS (SELECT repo_id, min(path) AS manifest FROM man GROUP BY repo_id),
p AS (SELECT DISTINCT f.repo_id, report_id, nth, manifest, CASE WHEN report_id % 4 = 0 THEN 'apps/none.lock' END AS target FROM fact f JOIN any_man USING (repo_id)),
e AS (SELECT p.repo_id, p.report_id, p.nth, p.manifest, 'g' || p.nth AS source_name, 'g' || (p.nth + 1) AS name, q.nth::VARCHAR AS version, CASE WHEN p.nth = 1 THEN 'direct' END AS relationship FROM p LEFT JOIN p q ON q.repo_id = p.repo_id AND q.report_id = p.report_id AND q.nth = p.nth + 1 WHERE p.report_id % 3 <> 0
  UNION ALL SELECT repo_id, report_id, nth, manifest, coalesce(target, manifest), 'g' || nth, nth::VARCHAR, CASE WHEN nth = 1 THEN 'direct' ELSE 'package_manifest' END FROM p WHERE report_id % 3 = 0)
SELECT repo_id, manifest, source_name, name, version, relationship FROM e QUALIFY row_number() OVER (PARTITION BY repo_id, manifest, source_name, name, coalesce(relationship, '') ORDER BY report_id, nth) = 1""",
    "s19_package_evidence": f"""WITH {_FACT}, {_EV}, m AS (SELECT nm.repo_id, name, ids, ord, name = pn AS same FROM nm JOIN ev ON ev.repo_id = nm.repo_id AND (name = pn OR ends_with(name, '/' || pn) OR ends_with(pn, '/' || name)))
SELECT nm.repo_id, nm.name, arg_min(ids, (NOT same)::INT * 1000000000 + ord) AS evidence_ids FROM nm LEFT JOIN m ON m.repo_id = nm.repo_id AND m.name = nm.name GROUP BY nm.repo_id, nm.name""",
}
