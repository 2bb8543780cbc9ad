"""Routes, handlers and source blocks against fixtures and plain step-by-step versions."""

import random
import re

from pyspark.sql import functions as F

from triagelake.operators import routes

METHODS = """repo_id string, full_name string, name string, path string, line long, code string, annotations array<struct<name string, code string>>,
  parameters array<struct<name string, type string>>, calls array<struct<nth bigint, name string, resolved string, code string, line bigint>>"""
FILES = "repo_id string, path string, content string"


def method(full_name, path, line, name=None, code=None, annotations=None, parameters=(), calls=(), repo="r"):
    return (repo, full_name, name, path, line, code, annotations, [(p, None) if isinstance(p, str) else p for p in parameters], [(n, *c) for n, c in enumerate(calls)])


def routed(spark, methods, files=()):
    rows = routes.routes(spark.createDataFrame(methods, METHODS), spark.createDataFrame(list(files), FILES))
    return {r["full_name"]: tuple(r["boundary"]) if r["boundary"] else None for r in rows.collect()}


def test_python_block_and_decorator(spark):
    text = "from flask import Flask\napp = Flask(__name__)\n@app.route('/welcome2/<string:name>')\ndef welcome2(name):\n    data = 'Welcome ' + name\n    return data\n\ndef unrelated():\n    return 'ok'"
    methods, files = [method("app.py:<module>.welcome2", "app.py", 4, "py", "py", parameters=["name"])], [("r", "app.py", text)]
    (row,) = routes.enriched(spark.createDataFrame(methods, METHODS), spark.createDataFrame(files, FILES)).collect()
    assert "data = 'Welcome ' + name" in row["code"] and "return data" in row["code"] and "def unrelated" not in row["code"]
    assert tuple(row["boundary"]) == ("python-web", "/welcome2/<string:name>", "ANY", "request")


def test_handlers_of_setup_code(spark):
    p, req = "src/server.ts::program:", [("req", "express.Request"), ("res", "express.Response")]
    calls = [
        ("app.use", "express.Application.use", "app.use('/api', handler)", 2), ("app.post", "express.Application.post", "app.post('/reset', utils.asyncHandler(resetPassword()))", 3), ("resetPassword", p + "resetPassword", "resetPassword()", 3),
        ("server.post", "express.Application.post", "server.post('/status', serverHandler)", 4), ("app.use", "express.Application.use", "app.use('/limited', rateLimit({ max: 100, keyGenerator }))", 5),
    ]
    s = "src/server.ts"
    methods = [
        method(p + "configureApp", s, 1, "configureApp", "configureApp", parameters=["app", "seq"], calls=calls), method(p + "handler", s, 8, "handler", "handler", parameters=req), method(p + "resetPassword", s, 12, "<lambda>", "resetPassword"),
        method(p + "resetPassword:<lambda>0", s, 13, "<lambda>0", "async ({ body }, res, next) => res.json(body)", parameters=[("body", "express.Request.body"), ("res", "express.Response")]), method(p + "serverHandler", s, 16, "serverHandler", "serverHandler", parameters=req),
        method(p + "max", s, 20, "max", "max", parameters=["value"]), method("src/client.ts::program:resetPassword", "src/client.ts", 1, "resetPassword", "resetPassword"),
    ]
    got = routed(spark, methods)
    assert got[p + "configureApp"] is None and got[p + "max"] is None and got["src/client.ts::program:resetPassword"] is None
    assert got[p + "handler"] == ("javascript-web", "/api", "USE", "req") and got[p + "resetPassword"] == ("javascript-web", "/reset", "POST", "request")
    assert got[p + "resetPassword:<lambda>0"] == ("javascript-web", "/reset", "POST", "body") and got[p + "serverHandler"] == ("javascript-web", "/status", "POST", "req")


def test_order_of_evidence(spark):
    spring = [("Nonsense", "@Nonsense"), ("PostMapping", '@PostMapping("/a")')]
    go = 'mux.HandleFunc("/h", Serve)\nr.GET("/g", List)\nr.Any(`/any`, Serve)\nr.POST("/late", List)'
    methods = [
        method("A.m:void()", "A.java", 2, "m", '@GetMapping("/code")', spring), method("A.n:void()", "A.java", 3, "n", "x\n@RequestMapping(path = {'/named'}, method = RequestMethod.GET)"), method("A.w:void()", "A.java", 3, "w", "@RequestMapping(\n  path = {'/named'})"), method("A.o:void()", "A.java", 4, "o", "@PutMapping\nvoid o()", parameters=[("r", "HttpServletRequest")]),
        method("A.q:void()", "A.java", 5, "q", "void q()", parameters=[("r", "HttpServletRequest")], calls=[(None, None, "app.get('/x', y)", 9)]), method("b.py:f", "b.py", 3, "f", "@router.post('/p')\ndef f(): pass"),
        method("c.js:f", "c.js", 1, "f", "app.all('/j', 1)", parameters=["req"]), method("c.js:g", "c.js", 2, "g", "app.all('/j', 1)", parameters=["x"]), method("c.js:h", "c.js", 3, "h", "h", parameters=["Request"], calls=[(None, "express.use", "x()", 3), ("express.use", None, "APP.use('/k')", 4)]),
        method("c.js:i", "c.js", 5, None, "i", parameters=["REQ"]), method("c.js::program", "c.js", 6, "program", "", parameters=["req"]), method("d.go:Serve", "d.go", 1, "Serve", "Serve"), method("d.go:List", "d.go", 2, "List", "List", parameters=[("c", "gin.Context")]), method("e.js:List", "e.js", 2, "List", "List"),
    ]
    assert routed(spark, methods, [("r", "z.go", go), ("r", "a.go", "x"), ("s", "a.go", 'http.Handle("/other", Serve)'), ("r", "n.go", None)]) == {
        "A.m:void()": ("spring", "/a", "POST", "request"), "A.n:void()": ("spring", "/named", "GET", "request"), "A.w:void()": ("spring", "RequestMapping", "ANY", "request"), "A.o:void()": ("spring", "PutMapping", "PUT", "request"), "A.q:void()": None, "b.py:f": ("python-web", "/p", "POST", "request"), "c.js:f": ("javascript-web", "/j", "ALL", "request"), "c.js:g": None,
        "c.js:h": ("web-route", "APP.use('/k')", "USE", "request"), "c.js:i": ("framework-input", "i", None, "REQ"), "c.js::program": None, "d.go:Serve": ("go-web", "/h", "ANY", "request"), "d.go:List": ("go-web", "/g", "GET", "request"), "e.js:List": None,
    }


def test_arguments(spark):
    cases = {
        "f(a, b)": ["a", "b"], "f()": [], "f(a,)": ["a"], "f(,a)": ["", "a"], "f('a,b', \"c)\", `d,`)": ["'a,b'", '"c)"', "`d,`"], "f(g(a, b), [c, d], {e: 1, f}, h)": ["g(a, b)", "[c, d]", "{e: 1, f}", "h"], r"f('a\', b', c)": [r"'a\', b'", "c"],
        "f": [], ")f(": [], "f((a, b)": ["(a, b"], "f(a)), b)": ["a))", "b"],
    }
    got = spark.createDataFrame([(k,) for k in cases], "c string").select("c", routes.arguments(F.col("c")).alias("a")).collect()
    assert {r["c"]: r["a"] for r in got} == cases


def plain_block(lines, start, python):
    if not 0 < start <= len(lines):
        return None
    out, depth = [], lambda x: len(re.match(r"\s*", x)[0])
    for k in range(start - 1, min(len(lines), start - 1 + (80 if python else 24))):
        x = lines[k]
        if python and k >= start and x.strip() and depth(x) <= depth(lines[start - 1]) and re.match(r"(?:@|async\s+def\b|def\b|class\b)", x.strip()):
            break
        out.append(x)
    return "\n".join(out).rstrip() or None


def test_blocks_on_varied_indents(spark):
    rng = random.Random(3)
    files, methods, want = [], [], {}
    for f in range(40):
        lines = [" " * rng.choice([0, 0, 2, 4, 4, 8]) + rng.choice(["def a():", "x = 1", "", "@deco", "class B:", "async  def c():", "definitely", "return 'x'", "\ty", "# def"]) for _ in range(rng.choice([1, 5, 60, 200]))]
        path = f"f{f}.{rng.choice(['py', 'js'])}"
        files.append(("r", path, rng.choice(["\n", "\r\n"]).join(lines)))
        for n in {1, len(lines), len(lines) + 1, 0, *(rng.randrange(1, len(lines) + 1) for _ in range(6))}:
            methods.append(method(f"{path}:{n}", path, n))
            if block := plain_block(lines, n, path.endswith(".py")):
                want[f"{path}:{n}"] = block
    methods += [method("gone", "gone.py", 1), method("none", None, 1), method("null", "f0.py", None), methods[0]]
    got = routes.source_blocks(spark.createDataFrame(methods, METHODS), spark.createDataFrame(files, FILES)).collect()
    assert {r["full_name"]: r["source"] for r in got} == want and len(got) == len(want)


def one_after_another(methods, found):
    """Routes as registrations give them in order; found: (order, route, verb, handler, exact) as registrations() has them."""
    full = {m[1] for m in methods}
    names = {}
    for m in methods:
        for n in {m[2], m[1].split(":")[-1]} - {None, ""}:
            names.setdefault(n, set()).add(m[1])
    asks = {m[1]: any((p[0] or "").lower() in ("req", "request") for p in m[7]) for m in methods}
    got = {}
    for _, route, verb, handler, exact in sorted(found):
        targets = {e for e in exact if e in full} or names.get(handler, set())
        if len(targets) != 1 or (target := next(iter(targets))) in got:
            continue
        for m in sorted(full):
            if (m == target or (m.startswith(target + ":") and asks[m])) and m not in got:
                got[m] = (route, verb)
    return got


def test_nested_handlers_as_one_after_another(spark):
    rng = random.Random(8)
    for repo in range(6):
        names = ["a", "b", "c"]
        for _ in range(30):
            names.append(rng.choice(names) + ":" + rng.choice(["a", "b", "x", "y", "<lambda>0"]))
        names = sorted(set(names))
        methods = []
        for k, n in enumerate(names):
            calls = [(None, None, rng.choice(["app.get('/{0}', {1})", "router.post('/{0}', auth, {1})", "x.get('/{0}', {1})", "app.use({1})", "app.put(['/{0}'], asyncHandler(q.{1}()))"]).format(rng.randrange(99), rng.choice(["a", "b", "x", "y", *names]).split(":")[-1]), rng.randrange(4)) for _ in range(rng.randrange(4))]
            calls += [(rng.choice("abxy"), rng.choice(names), "z()", rng.randrange(4)) for _ in range(rng.randrange(3))]
            methods.append(method(n, f"p{k % 5}.js", k, rng.choice([None, "a", "q", n.split(":")[-1]]), parameters=rng.choice([["req"], ["x"], []]), calls=calls, repo=str(repo)))
        frame = spark.createDataFrame(methods, METHODS)
        found = [(tuple(r["order"]), r["route"], r["verb"], r["handler"], r["exact"]) for r in routes.registrations(frame).collect()]
        got = {r["full_name"]: (r["route"]["route"], r["route"]["method"]) for r in routes.registered_routes(frame).collect()}
        assert got == one_after_another(methods, found) and found


def test_nothing_and_nulls(spark):
    assert routed(spark, []) == {}
    bare = ("r", "f", None, "x.js", 1, None, None, None, None)
    assert routed(spark, [bare, bare]) == {"f": None}
