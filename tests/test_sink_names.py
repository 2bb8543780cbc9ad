"""Parameter names of any characters in sink rules, and scanners' paths."""

import pytest
from pyspark.sql import functions as F

from triagelake.functions import paths
from triagelake.operators import sink_rules

SCHEMA = """repo_id string, full_name string, path string, line long, boundary struct<type string, route string, method string, source string>,
  parameters array<struct<name string, type string>>, calls array<struct<nth bigint, name string, resolved string, code string, line bigint>>"""


def sinks(spark, name, code, path="routes/a.js"):
    rows = [("r", f"{path}::program:f", path, 3, ("express", "/a", "GET", None), [(name, None), ("res", None)], [(1, None, None, code, 4)])]
    entities = spark.createDataFrame(rows, SCHEMA)
    calls = sink_rules.call_sinks(entities)
    return [r["sink_type"] for r in calls.collect()], [r["semantic"] for r in sink_rules.entity_sinks(entities, calls).collect()]


@pytest.mark.parametrize(
    ("name", "code", "sink"),
    [
        ("{ id }", "fetch(base + id)", ["outbound_http"]), ("$id", "fetch(base + $id)", ["server_side_request"]), ("id", "fetch(base + id)", ["server_side_request"]), ("id", "fetch(base + idx)", ["outbound_http"]),
        ("{ id }", 'el.write("<div>" + id)', []), ("$id", 'el.write("<div>" + $id)', ["cross_site_scripting"]), ("a.b[0](c)*+?^|\\", "fetch(x)", ["outbound_http"]), ("é", "fetch(base + é)", ["server_side_request"]),
    ],
)
def test_names_are_no_patterns(spark, name, code, sink):
    assert sinks(spark, name, code)[0] == sink


def test_raw_output_with_odd_names(spark):
    assert sinks(spark, "{ id }", 'res.send("<p>" + id)')[1] == []
    assert sinks(spark, "$id", 'res.send("<p>" + $id)')[1] == sinks(spark, "id", 'res.send("<p>" + id)')[1] == ["reflected_raw_html_output"]


def test_scanner_paths(spark):
    cases = {
        "file:///work/source/a+b.ts": "a+b.ts", "file:///work/source/a%20b.ts": "a b.ts", "file:///work/source/a%zz.ts": None, "file:///work/source/a%2": None, "file://otherhost/a.ts": None, "file://localhost/work/source/a.ts": "a.ts", "file://LOCALHOST/work/source/a.ts": "a.ts",
        "file:///work/source/a%2Fb.ts": None, "file:///work/source/%ff.ts": None, "file:///work/source/x/../b.ts": "b.ts", "file:///work/source/./b.ts": "b.ts", "file:///work/source/b.ts?q=1#f": "b.ts", "file:///work/source/%C3%A9.ts": "é.ts", "file:///etc/passwd": None,
        "  ./a.ts\n": "a.ts", "/work/source/a/b.ts": "a/b.ts", "a//b": None, "a+b%zz.ts": "a+b%zz.ts", "": None, "file://": None, None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", paths.scanned(F.col("p")).alias("s")).collect()
    assert {r["p"]: r["s"] for r in rows} == cases
