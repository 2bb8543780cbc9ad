"""Small tables for extraction, sinks and joins: nulls, ties, repeated rows, empty tables."""

from pyspark.sql import functions as F

from triagelake.operators import coverage, extractors, hypotheses, integrity, joins, sinks


def tuples(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def lines(spark, path, texts):
    return spark.createDataFrame([(path, k, t) for k, t in enumerate(texts)], "path string, line_no int, line string")


def test_imports_of_each_language(spark):
    of = lambda path, *texts: {r["package"] for r in extractors.imports(lines(spark, path, texts)).collect()}
    assert of("a.tsx", "import {b} from '@s/n/deep'", "require('x/y'); import('z')", "from './own'", "import 'https://u/v'", None) == {"@s/n", "x", "z"}
    assert of("a.py", "import a.b as c, d", "  from e.f import g", "from .own import h") == {"a", "d", "e"}
    assert of("a.go", '"fmt"', '  x "h.io/y"') == {"h.io/y"}
    assert of("a.java", "import static a.b.C.d;", "import javax.x.Y;") == {"a.b.C"}
    assert of("a.md", "import a", 'require("b")') == set()


def test_functions_end_where_their_braces_do(spark):
    code = ["contract A {", "function f() {", "if (x) {", "balances[a] = 0;", "}", "}", 'b.call{value: 1}("");', "function g() {", 'b.call{value: 1}("");', "}", "balances[b] -= 1;", "}", "contract B {", "function f()", "{", "b.send(1);", "balances[b] = balances[b] - 1;", "}", "}"]
    assert tuples(extractors.reentrant(lines(spark, "a.sol", code))) == [("a.sol", "B", "f", 15, 16)]
    assert extractors.reentrant(lines(spark, "a.sol", code).limit(0)).count() == 0


def test_the_first_candidate_and_the_first_rule_win(spark):
    calls = spark.createDataFrame([("eval", "res.redirect(x)"), ("log", "pickle.loads(eval(x))"), ("log", None), (None, None), ("re.exec", "re.exec(x)")], "name string, code string")
    assert [r[0] for r in calls.select(sinks.sink_type(F.col("name"), F.col("code"))).collect()] == ["code_execution", "deserialization", None, None, None]


def test_names_meet_by_suffix_either_way(spark):
    components = spark.createDataFrame([("a/b",), ("b",), (None,)], "component string")
    usages = spark.createDataFrame([("b", 1), ("x/a/b", 2), ("ab", 3), ("a/b", 4), (None, 5), ("b", 1)], "usage string, n int")
    got = tuples(joins.by_suffix(components, usages).select("n", "component"))
    assert got == sorted([(1, "a/b"), (1, "b"), (1, "a/b"), (1, "b"), (2, "a/b"), (2, "b"), (4, "a/b"), (4, "b")], key=str)


def test_a_path_is_known_as_it_is_before_it_is_stripped(spark):
    files = spark.createDataFrame([("r", "src/a"), ("r", "a"), ("r", "b"), ("r", "b")], "repo_id string, path string")
    rows = spark.createDataFrame([(1, "r", "src/a"), (2, "r", "src/b"), (3, "s", "a"), (4, "r", None), (5, None, "a")], "n int, repo_id string, path string")
    assert tuples(joins.contained(rows, files, "src/").select("n", "known_path")) == [(1, "src/a"), (2, "b"), (3, None), (4, None), (5, None)]


def test_calls_go_to_names_then_to_symbols_of_one_entity(spark):
    entities = spark.createDataFrame([("m.f", "f"), ("m.g", "g"), ("n.g", "g"), (None, None)], "name string, symbol string")
    calls = spark.createDataFrame([(1, "m.f", "g", None), (2, "x", "f", "s"), (3, "x", "g", "s"), (4, "x", "g", None), (5, None, None, None)], "n int, name string, symbol string, sink string")
    assert tuples(joins.resolved(calls, entities).select("n", "target", "how")) == [(1, "m.f", "name"), (2, "m.f", "symbol"), (3, "s", "sink")]


def test_links_count_shared_findings_once(spark):
    actions = spark.createDataFrame([("a", [1, 2, 2]), ("b", []), ("c", None)], "action string, finding_ids array<int>")
    asked = spark.createDataFrame([("h", [2, 1, 1]), ("i", [3]), ("j", None)], "hypothesis string, finding_ids array<int>")
    assert tuples(joins.linked(actions, asked)) == [("a", "h", 2)]
    assert [r["hypothesis"] for r in joins.unlinked(actions, asked).orderBy("hypothesis").collect()] == ["i", "j"]


def test_what_exists_wins_and_samples_start_with_families(spark):
    base = spark.createDataFrame([(1, 9), (1, 9)], "k int, n int")
    assert tuples(hypotheses.upserted(base, spark.createDataFrame([(1, 1), (2, 7), (2, 5)], "k int, n int"), ["k"], "n")) == [(1, 9), (1, 9), (2, 5)]
    paths = spark.createDataFrame([("g", "x", 1), ("g", "x", 2), ("g", "y", 3), ("g", None, 4), ("g", "x", 5)], "g string, family string, n int")
    assert [r["n"] for r in hypotheses.representative(paths, ["g"], "family", [F.col("n")], 4).orderBy("nth").collect()] == [1, 3, 4, 2]


def test_states_of_references_and_gaps(spark):
    refs = spark.createDataFrame([(["a:partial", "b:failed"],), (["coverage-unavailable", "a:checked"],), (["coverage-unavailable", "a:partial"],), ([],)], "refs array<string>")
    assert [r[0] for r in refs.select(coverage.worst_of(F.col("refs"))).collect()] == ["failed", "skipped", "partial", "checked"]
    rows = spark.createDataFrame([("p", "a"), ("p", "a"), ("q", "c")], "producer string, area string")
    assert tuples(coverage.gaps(rows, ["a", "b"]).select("producer", "area")) == [("p", "b"), ("q", "a"), ("q", "b")]
    files = spark.createDataFrame([("r", "javascript"), ("r", "typescript"), ("r", "python"), ("r", None), ("s", "rust")], "repo_id string, language string")
    assert tuples(coverage.dominant(files, F.lit(False))) == [("r", "typescript", 10)]


def test_rows_that_do_not_fit_their_base(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "d")], "k int, v string")
    base = spark.createDataFrame([(1, "a"), (2, None), (3, "x")], "k int, v string")
    assert tuples(integrity.incompatible(rows, base, "k", "v")) == [(3, "v"), (4, "missing")]
