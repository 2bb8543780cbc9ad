"""Registered queries of code extraction, sinks, joins, merges and samples.

Code is derived from the given tables: an event is a line or a contract, a line item is a call or a usage.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.functions import findings as fn
from triagelake.operators import coverage, extractors, hypotheses, integrity, joins, sinks
from triagelake.sources import corpus

from .findings_sql import FILES

#: Lines by the language of a file and the kind of an event; {k} is a number.
IMPORTS = {
    "ts": ("import x from '@s{k}/p{k}/sub'", 'const x = require("p{k}/lib")', "import('./local')", "import fs from 'node:fs'", "a('b')"),
    "py": ("import p{k}.sub as x, q{k}", "from p{k}.a import b", "from . import c", "x = import_it", "y = 1"),
    "go": ('import "example.com/p{k}"', '"fmt"', 'x "./a.b"', '"g{k}.io/x"', "x := 1"),
    "java": ("import org.p{k}.a.C;", "import java.util.List;", "import static q{k}.B;", "import lone;", "int x;"),
}
CALL, STATE = 'msg.sender.call{value: x}("");', "balances[msg.sender] -= x;"
BODIES = ((CALL, STATE), (STATE, CALL), (f"{CALL} {STATE}", "x++;"), ("if (x) { balances[a] = 0; }", "return;"))
CALLS = (
    ("eval", "eval(x)", "code_execution"), ("exec", "re.exec(x)", None), ("exec", "exec (x)", "code_execution"), ("run", "subprocess.run(x)", "code_execution"),
    ("ProcessBuilder.start", "processBuilder.start()", "code_execution"), ("readObject", "ObjectInputStream.readObject()", "deserialization"), ("load", "yaml.load(f)", "deserialization"),
    ("redirect", "res.redirect(u)", "redirect"), ("view", "new RedirectView(u)", "redirect"), ("render_template_string", "render_template_string(t)", "template_render"),
    ("process", "templateEngine.process(t)", "template_render"), ("log", "console.log(x)", None),
)


def _table(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _pick(values, at):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (at + 1).cast("int"))


def _id(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def import_lines(s, d):
    user, event, line = F.col("user_id"), F.col("event_id"), None
    for n, shapes in enumerate(IMPORTS.values()):
        here = _pick(shapes, event % 5)
        line = F.when(user % 4 == n, here) if line is None else line.when(user % 4 == n, here)
    path = F.concat(_id("src/u", "user_id"), F.lit("."), _pick(IMPORTS, user % 4))
    return _table(s, d, "events").select(path.alias("path"), event.alias("line_no"), F.replace(line, F.lit("{k}"), (event % 17).cast("string")).alias("line"))


def contract_lines(s, d):
    event = F.col("event_id")
    body = [_pick([b[k] for b in BODIES], event % 4) for k in (0, 1)]
    lines = F.array(F.concat(_id("contract C", "event_id"), F.lit(" {")), F.concat(_id("function f", "event_id"), F.lit("() {")), *body, F.lit("}"), F.lit("}"))
    each = _table(s, d, "events").select(F.concat(_id("contracts/u", "user_id"), F.lit(".sol")).alias("path"), "event_id", F.posexplode(lines).alias("i", "line"))
    return each.select("path", (event * 8 + F.col("i")).alias("line_no"), "line")


def _sinks(s, d):
    name, code = (_pick([c[k] for c in CALLS], F.col("l_partkey") % len(CALLS)) for k in (0, 1))
    return _table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", sinks.sink_type(name, code).alias("sink_type"))


def _contained(s, d):
    path = corpus.path_of(F.col("doc_id"), F.col("lang"))
    path = F.when(F.col("doc_id") % 10 == 9, F.concat(path, F.lit(".gone"))).when(F.col("doc_id") % 3 == 0, F.concat(F.lit("checkout/"), path)).otherwise(path)
    found = _table(s, d, "documents").select("doc_id", F.col("source").alias("repo_id"), path.alias("path"))
    return joins.contained(found, corpus.files(s, d), "checkout/").select("doc_id", "known_path")


def _planned(s, d):
    plan = _table(s, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 5 != 0).alias("applicable"), (F.col("n_nationkey") % 2 == 0).alias("implemented"))
    runs = _table(s, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.when(F.max("s_acctbal") > 8000, "checked").otherwise("partial").alias("state"))
    return joins.planned(plan, runs, "n_nationkey")


def _by_suffix(s, d):
    name = lambda c: F.concat(F.lit("g"), (F.col(c) % 7).cast("string"), F.lit("/n"), F.col(c).cast("string"))
    k = F.col("l_orderkey") % 4
    usage = F.when(k == 0, name("l_partkey")).when(k == 1, _id("n", "l_partkey")).when(k == 2, F.concat(F.lit("reg/"), name("l_partkey"))).otherwise(_id("x/n", "l_partkey"))
    usages = _table(s, d, "lineitem").select(usage.alias("usage"), "l_orderkey", "l_linenumber", "l_partkey")
    return joins.by_suffix(_table(s, d, "part").select(name("p_partkey").alias("component")), usages).drop("usage")


def _resolved(s, d):
    cust, k = F.col("c_custkey"), F.col("o_orderkey") % 3
    entities = _table(s, d, "customer").select(_id("c", "c_custkey").alias("name"), F.when(cust % 2 == 0, _id("s", "c_custkey")).otherwise(_id("common", "c_nationkey")).alias("symbol"))
    calls = _table(s, d, "orders").select("o_orderkey", F.when(k == 0, _id("c", "o_custkey")).otherwise("other").alias("name"), F.when(k == 1, _id("s", "o_custkey")).otherwise(F.concat(F.lit("common"), (F.col("o_custkey") % 30).cast("string"))).alias("symbol"), F.when(F.col("o_orderpriority").startswith("1"), "sink").alias("sink"))
    return joins.resolved(calls, entities).select("o_orderkey", "target", "how")


def _actions(s, d):
    """Orders in work as the findings of a customer's action; returned items' orders as the findings of a part's hypothesis."""
    actions = _table(s, d, "orders").where("o_orderstatus = 'P'").groupBy(_id("a", "o_custkey").alias("action")).agg(F.collect_set("o_orderkey").alias("finding_ids"))
    return actions, _table(s, d, "lineitem").where("l_returnflag = 'R'").groupBy(_id("h", "l_partkey").alias("hypothesis")).agg(F.collect_set("l_orderkey").alias("finding_ids"))


def _expected(s, d):
    docs = _table(s, d, "documents").select("doc_id")
    return joins.expected(_table(s, d, "labels").select("doc_id"), docs.where("doc_id % 3 <> 0").unionByName(docs.where("doc_id % 7 = 0")), "doc_id")


def _labelled(s, d):
    edges = _table(s, d, "lineitem").select(_id("o", "l_orderkey").alias("a"), _id("p", "l_partkey").alias("b")).distinct()
    return joins.labelled(edges, _table(s, d, "part").where("p_size > 10").select(_id("p", "p_partkey").alias("node"), F.col("p_name").alias("label")))


def _areas(s, d):
    return _table(s, d, "orders").where("o_totalprice > 250000").select(F.concat(F.lit("p"), F.col("o_custkey") % 97).alias("producer"), F.col("o_orderpriority").alias("area"))


def _worst(s, d):
    ref = F.when(F.col("l_quantity") > 48, "coverage-unavailable").otherwise(F.concat(F.lit("flow:"), _pick(("checked", "checked", "checked", "partial", "degraded", "skipped", "failed"), F.col("l_partkey") % 7)))
    return _table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(ref).alias("refs")).select("l_orderkey", coverage.worst_of(F.col("refs")).alias("state"))


def _merged(s, d):
    items = _table(s, d, "lineitem").select("l_orderkey", "l_returnflag", F.array(_id("p", "l_partkey"), _id("s", "l_suppkey")).alias("nodes"))
    rows = items.join(_table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority"), "l_orderkey")
    return hypotheses.merged(rows, ["o_custkey", "l_returnflag"], "l_orderkey", ["o_orderpriority"], ["nodes"]).withColumn("nodes", F.array_join("nodes", ","))


def _upserted(s, d):
    rows = _table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return hypotheses.upserted(rows.where("o_orderstatus = 'P'"), rows.where("o_orderstatus <> 'P'"), ["o_custkey"], "o_orderkey")


def _reportable(s, d):
    owner = F.when(F.col("o_orderstatus") == "P", _id("id", "o_orderkey")).otherwise(_id("owner", "o_custkey"))
    rows = _table(s, d, "orders").where("o_orderpriority <> '5-LOW'").select(owner.alias("owner"), "o_orderkey", "o_totalprice")
    return hypotheses.first(rows, ["owner"], [F.desc("o_totalprice"), F.col("o_orderkey")], 1).select("owner", "o_orderkey")


def _sampled(s, d):
    """Groups with their size, first five ids and first ids: only five rows of a group meet in one list."""
    rows = _table(s, d, "orders").select("o_orderpriority", "o_orderstatus", "o_orderkey")
    group = ["o_orderpriority", "o_orderstatus"]
    some = hypotheses.first(rows, group, [F.col("o_orderkey")], 5).groupBy(*group).agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("first_ids"))
    return rows.groupBy(*group).agg(F.count("*").alias("n")).join(some, group)


def _unallowed(s, d):
    kinds = lambda where: F.collect_set(F.when(F.col("o_orderstatus") == where, F.col("o_orderpriority")))
    return integrity.unallowed(_table(s, d, "orders").groupBy("o_custkey").agg(kinds("P").alias("required"), kinds("F").alias("allowed")), "o_custkey")


def _incompatible(s, d):
    rows = _table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") > 0).alias("paid"))
    return integrity.incompatible(rows, _table(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") > 0).alias("paid")), "key", "nation", "paid")


def _unexplained(s, d):
    reason = F.when(F.col("o_custkey") % 3 == 0, F.lit(" ")).when(F.col("o_custkey") % 3 == 1, F.col("o_orderpriority"))
    return coverage.unexplained(_table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "checked").otherwise("partial").alias("state"), reason.alias("reason"))).select("o_orderkey", "state")


def _bounded(s, d):
    refs = _table(s, d, "lineitem").select("l_partkey", "l_orderkey").distinct()
    some = hypotheses.first(refs, ["l_partkey"], [F.col("l_orderkey")], 20)
    return some.groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_list("l_orderkey")).cast("array<string>"), ",").alias("refs"))


QUERIES = {
    "x19_x23_imports": lambda s, d: extractors.imports(import_lines(s, d)),
    "x09_x10_reentrancy": lambda s, d: extractors.reentrant(contract_lines(s, d)),
    "k01_k17_sinks": _sinks,
    "j01_contained": _contained,
    "j03_check_plan": _planned,
    "j05_by_suffix": _by_suffix,
    "j08_calls": _resolved,
    "j16_action_links": lambda s, d: joins.linked(*_actions(s, d)),
    "j17_unlinked": lambda s, d: joins.unlinked(*_actions(s, d)).select("hypothesis"),
    "j19_expectations": _expected,
    "j20_labels": _labelled,
    "j22_a21_audit": lambda s, d: joins.audited(_table(s, d, "orders").select("o_custkey"), _table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey"),
    "a10_dominant_language": lambda s, d: coverage.dominant(corpus.files(s, d).withColumn("language", fn.language(F.col("path"))), F.col("path").startswith("vendor/")),
    "a12_known_gaps": lambda s, d: coverage.gaps(_areas(s, d), ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"]),
    "a13_worst_coverage": _worst,
    "a17_semantic_merge": _merged,
    "w02_upsert": _upserted,
    "w08_reportable": _reportable,
    "w10_representative": lambda s, d: hypotheses.representative(_table(s, d, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_type", [F.col("event_id")], 6),
    "w12_bounded_references": _bounded,
    "w15_review_groups": _sampled,
    "v11_coverage_reasons": _unexplained,
    "v14_rules": _unallowed,
    "v16_compatible": _incompatible,
}

_SINK = "[" + ", ".join(f"'{c[2]}'" if c[2] else "NULL" for c in CALLS) + "]"
ORACLE_SQL = {
    "x19_x23_imports": """WITH k AS (SELECT 'src/u' || user_id || '.' || (['ts', 'py', 'go', 'java'])[(user_id % 4 + 1)::INT] AS path, event_id AS line_no, (event_id % 17)::VARCHAR AS k, user_id % 4 * 10 + event_id % 5 AS c FROM events)
SELECT path, line_no, unnest(CASE c WHEN 0 THEN ['@s' || k || '/p' || k] WHEN 1 THEN ['p' || k] WHEN 10 THEN ['p' || k, 'q' || k] WHEN 11 THEN ['p' || k] WHEN 20 THEN ['example.com/p' || k] WHEN 23 THEN ['g' || k || '.io/x'] WHEN 30 THEN ['org.p' || k || '.a'] WHEN 32 THEN ['q' || k || '.B'] ELSE [] END) AS package FROM k""",
    "x09_x10_reentrancy": "SELECT 'contracts/u' || user_id || '.sol' AS path, 'C' || event_id AS contract, 'f' || event_id AS function, event_id * 8 + 2 AS call_line, event_id * 8 + CASE event_id % 4 WHEN 0 THEN 3 ELSE 2 END AS state_line FROM events WHERE event_id % 4 IN (0, 2)",
    "k01_k17_sinks": f"SELECT l_orderkey, l_linenumber, l_partkey, ({_SINK})[(l_partkey % 12 + 1)::INT] AS sink_type FROM lineitem",
    "j01_contained": f"WITH {FILES} SELECT doc_id, CASE WHEN doc_id % 10 <> 9 AND repo_id IS NOT NULL THEN path END AS known_path FROM f",
    "j03_check_plan": "SELECT n_nationkey, coalesce(state, CASE WHEN n_nationkey % 5 = 0 THEN 'skipped' WHEN n_nationkey % 2 = 0 THEN 'failed' ELSE 'degraded' END) AS state FROM nation LEFT JOIN (SELECT s_nationkey, CASE WHEN max(s_acctbal) > 8000 THEN 'checked' ELSE 'partial' END AS state FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON s_nationkey = n_nationkey",
    "j05_by_suffix": "SELECT l_orderkey, l_linenumber, l_partkey, 'g' || (p_partkey % 7) || '/n' || p_partkey AS component FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 4 <> 3",
    "j08_calls": """WITH e AS (SELECT 'c' || c_custkey AS name, CASE WHEN c_custkey % 2 = 0 THEN 's' || c_custkey ELSE 'common' || c_nationkey END AS symbol FROM customer),
c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'c' || o_custkey ELSE 'other' END AS name, CASE WHEN o_orderkey % 3 = 1 THEN 's' || o_custkey ELSE 'common' || (o_custkey % 30) END AS symbol, CASE WHEN o_orderpriority LIKE '1%' THEN 'sink' END AS sink FROM orders),
u AS (SELECT symbol, min(name) AS lone FROM e GROUP BY symbol HAVING count(*) = 1)
SELECT o_orderkey, coalesce(e.name, lone, sink) AS target, CASE WHEN e.name IS NOT NULL THEN 'name' WHEN lone IS NOT NULL THEN 'symbol' ELSE 'sink' END AS how FROM c LEFT JOIN e ON c.name = e.name LEFT JOIN u ON c.symbol = u.symbol WHERE target IS NOT NULL""",
    "j16_action_links": "SELECT 'a' || o_custkey AS action, 'h' || l_partkey AS hypothesis, count(DISTINCT o_orderkey) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P' AND l_returnflag = 'R' GROUP BY ALL",
    "j17_unlinked": "SELECT 'h' || l_partkey AS hypothesis FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey HAVING count(*) FILTER (l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')) = 0",
    "j19_expectations": """WITH r AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 7 = 0) GROUP BY doc_id)
SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' ELSE 'matched' END AS outcome FROM (SELECT DISTINCT doc_id FROM labels) l FULL JOIN r ON l.doc_id = r.doc_id""",
    "j20_labels": "SELECT DISTINCT 'o' || l_orderkey AS a, 'p' || l_partkey AS b, 'o' || l_orderkey AS a_label, coalesce(p_name, 'p' || l_partkey) AS b_label FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10",
    "j22_a21_audit": "SELECT coalesce(o_custkey, c_custkey) AS o_custkey, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'unused' WHEN c_custkey IS NULL THEN 'gap' ELSE 'covered' END AS status FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) FULL JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey",
    "a10_dominant_language": f"""WITH {FILES}, s AS (SELECT repo_id, CASE doc_id % 7 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE 'java' END AS language, sum(CASE WHEN doc_id % 7 = 1 AND path LIKE 'vendor/%' THEN 1 ELSE 10 END)::BIGINT AS score FROM f WHERE doc_id % 7 IN (0, 1, 2) AND path IS NOT NULL GROUP BY ALL)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, list_position(['typescript', 'java', 'python'], language)) = 1""",
    "a12_known_gaps": "WITH a AS (SELECT DISTINCT 'p' || (o_custkey % 97) AS producer, o_orderpriority AS area FROM orders WHERE o_totalprice > 250000) SELECT producer, area, 'skipped' AS state, 'not reported' AS reason FROM (SELECT DISTINCT producer FROM a), (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', '6-NONE']) AS area) WHERE (producer, area) NOT IN (SELECT (producer, area) FROM a)",
    "a13_worst_coverage": "SELECT l_orderkey, CASE WHEN bool_or(l_quantity <= 48 AND l_partkey % 7 = 6) THEN 'failed' WHEN bool_or(l_quantity <= 48 AND l_partkey % 7 = 4) THEN 'degraded' WHEN bool_or(l_quantity <= 48 AND l_partkey % 7 = 3) THEN 'partial' WHEN bool_or(l_quantity > 48 OR l_partkey % 7 = 5) THEN 'skipped' ELSE 'checked' END AS state FROM lineitem GROUP BY l_orderkey",
    "a17_semantic_merge": """WITH r AS (SELECT o_custkey, l_returnflag, l_orderkey, o_orderpriority, unnest(['p' || l_partkey, 's' || l_suppkey]) AS node FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT o_custkey, l_returnflag, arg_min(o_orderpriority, l_orderkey) AS o_orderpriority, string_agg(DISTINCT node, ',' ORDER BY node) AS nodes FROM r GROUP BY ALL""",
    "w02_upsert": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, min(o_orderkey), arg_min(o_orderstatus, o_orderkey) FROM orders WHERE o_orderstatus <> 'P' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY o_custkey",
    "w08_reportable": "SELECT CASE WHEN o_orderstatus = 'P' THEN 'id' || o_orderkey ELSE 'owner' || o_custkey END AS owner, o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW' QUALIFY row_number() OVER (PARTITION BY owner ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "w10_representative": "WITH f AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY k > 1, event_id)::INT AS nth FROM f QUALIFY nth <= 6",
    "w12_bounded_references": "WITH r AS (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem), s AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) <= 20) SELECT l_partkey, string_agg(l_orderkey::VARCHAR, ',' ORDER BY l_orderkey) AS refs FROM s GROUP BY l_partkey",
    "w15_review_groups": "WITH s AS (SELECT o_orderpriority, o_orderstatus, o_orderkey, count(*) OVER g AS n, row_number() OVER (g ORDER BY o_orderkey) AS k FROM orders WINDOW g AS (PARTITION BY o_orderpriority, o_orderstatus)) SELECT o_orderpriority, o_orderstatus, any_value(n) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS first_ids FROM s WHERE k <= 5 GROUP BY ALL",
    "v11_coverage_reasons": "SELECT o_orderkey, 'partial' AS state FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 3 <> 1",
    "v14_rules": "WITH k AS (SELECT o_custkey, list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'P') AS r, list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F') AS a FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN a IS NULL THEN 'none_allowed' ELSE 'required_not_allowed' END AS violation FROM k WHERE a IS NULL OR (r IS NOT NULL AND NOT list_has_all(a, r))",
    "v16_compatible": "WITH b AS (SELECT c_custkey AS key, c_nationkey <> s_nationkey AS n, (c_acctbal > 0) <> (s_acctbal > 0) AS p, s_suppkey IS NULL AS m FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey) SELECT key, 'missing' AS violation FROM b WHERE m UNION ALL SELECT key, 'nation' FROM b WHERE n UNION ALL SELECT key, 'paid' FROM b WHERE p",
}
