"""Web routes of methods, their handlers, and the source text of a method.

Methods are (repo_id, full_name, name, path, line, code, annotations, parameters, calls): annotations an array
of (name, code), parameters of (name, type), calls of (nth, name, resolved, code, line). Files are (repo_id,
path, content). A route is a struct (type, route, method, source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUTE = "struct<type:string,route:string,method:string,source:string>"
#: Lines of a block at most, in Python and elsewhere, and lines above a method that its decorators may take.
PYTHON_LINES, BLOCK_LINES, DECORATOR_LINES = 80, 24, 12
#: What ends a block of Python, and how routes are written.
DECLARATION = r"^(?:@|async\s+def\b|def\b|class\b)"
MAPPING = r"(?:Get|Post|Put|Patch|Delete|Request)Mapping$"
SPRING = r"(?m)@(GetMapping|PostMapping|PutMapping|PatchMapping|DeleteMapping|RequestMapping)[\s\S]*?(?:\)|$)"
SPRING_DIRECT = r"""@\w+Mapping\s*\(\s*(?:"([^"]+)"|'([^']+)')"""
SPRING_NAMED = r"""\b(?:path|value)\s*=\s*(?:\{\s*)?(?:"([^"]+)"|'([^']+)')"""
PYTHON_CODE = r"""@(app|router|blueprint)\.(get|post|put|patch|delete|route)\s*\(\s*["']([^"']+)["']"""
PYTHON_DECORATOR = r"""@[\w.]+\.(get|post|put|patch|delete|route)\s*\(\s*["']([^"']+)["']([\s\S]*?)\)"""
PYTHON_METHODS = r"""(?i)\bmethods\s*=\s*\[?\s*["']([A-Z]+)["']"""
JS_CODE = r"""\b(?:app|router)\.(get|post|put|patch|delete|all|use)\s*\(\s*["']([^"']+)["']"""
JS_CALL = r"\b(?:app|router)\.(?:get|post|put|patch|delete|all|use)\s*\("
GO_HANDLE = r"""\b(?:[\w.]+\.)?(?:HandleFunc|Handle)\s*\(\s*["'`]([^"'`]+)["'`]\s*,\s*(\w+)"""
GO_ROUTER = r"""\b[\w.]+\.(GET|POST|PUT|PATCH|DELETE|ANY|Any|HandleFunc)\s*\(\s*["'`]([^"'`]+)["'`]\s*,\s*(\w+)"""
VERBS = ("get", "post", "put", "patch", "delete", "all", "use")
VERB_CALL = r"(?i)\.\s*(get|post|put|patch|delete|all|use)\s*\("
RECEIVER = r"""(?i)\b([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\.\s*{verb}\s*\(\s*(?:["'`]([^"'`]+)["'`]|\[\s*["'`]([^"'`]+)["'`])"""
ROUTER_TYPE, ROUTER_NAME = r"\bexpress\b|router|express\.application", r"^(app|application|server|.*router|.*routes)$"
NAME, ASYNC, FACTORY = r"^([A-Za-z_$][\w$]*)$", r"\basyncHandler\s*\(\s*(?:[A-Za-z_$][\w$]*\.)*([A-Za-z_$][\w$]*)\s*\(", r"^(?:[A-Za-z_$][\w$]*\.)*([A-Za-z_$][\w$]*)\s*\("
#: Arguments of a registration that are no handlers, and parameters that carry a request.
NO_HANDLERS = ("app", "router", "req", "request", "res", "response", "next", "utils", "asyncHandler", "single", "array", "fields")
REQUEST_NAMES, REQUEST_TYPES = ("req", "request", "httprequest"), "request|gin.context|fiber.ctx|echo.context|fastapi|flask|django"


def _said(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _last(names: Column) -> Column:
    return F.try_element_at(names, F.lit(-1))


def _route(kind: str, route: Column, method: Column, source: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("type"), route.alias("route"), method.cast("string").alias("method"), (F.lit("request") if source is None else source).alias("source"))


def lines_of(files: DataFrame) -> DataFrame:
    """repo_id, path, line_no (from 1), text of files."""
    each = files.select("repo_id", "path", F.posexplode(F.split("content", r"\r?\n")).alias("at", "text"))
    return each.select("repo_id", "path", (F.col("at") + 1).cast("long").alias("line_no"), "text")


def _beside(methods: DataFrame, lines: DataFrame, first: Column, last: Column) -> DataFrame:
    """repo_id, full_name, path, line, near: for each method the lines first..last of its file as an array of (line_no, text).

    Each method asks for its few lines by number, so the join is by equality and a file of many methods is cut
    into as many keys as it has lines.
    """
    asked = methods.select("repo_id", "full_name", "path", "line").distinct().where(last >= first).withColumn("line_no", F.explode(F.sequence(first, last)))
    near = F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("near")
    return asked.join(lines, ["repo_id", "path", "line_no"]).groupBy("repo_id", "full_name", "path", "line").agg(near)


def source_blocks(methods: DataFrame, files: DataFrame) -> DataFrame:
    """repo_id, full_name, path, line, end_line, source: the text of each method from its line on.

    In Python it ends before the next declaration that is indented no deeper, after 80 lines at most;
    elsewhere after 24 lines. Methods whose line their file does not have, and empty texts, have no row.
    Repeated methods are taken once.
    """
    python = F.col("path").endswith(".py")
    start = F.col("line").cast("long")
    near = _beside(methods.where("line > 0"), lines_of(files), start, start + F.when(python, PYTHON_LINES - 1).otherwise(BLOCK_LINES - 1))
    near = near.where(F.col("near")[0]["line_no"] == F.col("line"))
    depth = lambda text: F.length(F.regexp_extract(text, r"^\s*", 0))
    base = depth(F.col("near")[0]["text"])
    ends = lambda x: (x["line_no"] > F.col("line")) & (F.trim(x["text"]) != "") & (depth(x["text"]) <= base) & F.regexp_replace(x["text"], r"^\s+", "").rlike(DECLARATION)
    end = F.when(python, F.get(F.filter("near", ends), F.lit(0))["line_no"])
    kept = F.filter("near", lambda x: F.col("end").isNull() | (x["line_no"] < F.col("end")))
    out = near.withColumn("end", end).withColumn("kept", kept).withColumn("source", F.regexp_replace(F.array_join(F.transform("kept", lambda x: x["text"]), "\n"), r"\s+$", ""))
    return out.where("source <> ''").select("repo_id", "full_name", "path", "line", _last(F.col("kept"))["line_no"].alias("end_line"), "source")


def is_request(parameter: Column) -> Column:
    blank = F.lit("")
    return F.lower(F.coalesce(parameter["name"], blank)).isin(*REQUEST_NAMES) | F.lower(F.coalesce(parameter["type"], blank)).rlike(REQUEST_TYPES.replace(".", r"\."))


def request_of(parameters: Column) -> Column:
    """The first parameter that carries a request; null without one."""
    return F.get(F.filter(parameters, is_request), F.lit(0))


def _spring(annotation: Column, code: Column) -> Column:
    path = F.coalesce(*(_group(code, p, k) for p in (SPRING_DIRECT, SPRING_NAMED) for k in (1, 2)), annotation)
    get, post = code.contains("RequestMethod.GET"), code.contains("RequestMethod.POST")
    method = F.when(annotation.isin("GetMapping", "PostMapping", "PutMapping", "PatchMapping", "DeleteMapping"), F.upper(F.regexp_replace(annotation, "Mapping$", ""))).when(get & ~post, "GET").when(post & ~get, "POST").otherwise("ANY")
    return _route("spring", path, method)


def from_annotations(annotations: Column) -> Column:
    """The route of the first mapping among annotations."""
    first = F.get(F.filter(annotations, lambda a: _said(a["name"]).isNotNull() & _said(a["code"]).isNotNull() & a["name"].rlike(MAPPING)), F.lit(0))
    return F.when(first.isNotNull(), _spring(first["name"], first["code"]))


def from_code(code: Column, parameters: Column) -> Column:
    """The route that a method's own text names: Spring, then Python, then JavaScript (of methods with a request)."""
    code = F.coalesce(_said(code), F.lit(""))
    spring, python, js = _group(code, SPRING), _group(code, PYTHON_CODE, 3), _group(code, JS_CODE, 2)
    return (
        F.when(spring.isNotNull(), _spring(spring, F.regexp_extract(code, SPRING, 0)))
        .when(python.isNotNull(), _route("python-web", python, F.upper(F.regexp_extract(code, PYTHON_CODE, 2))))
        .when(js.isNotNull() & request_of(parameters).isNotNull(), _route("javascript-web", js, F.upper(F.regexp_extract(code, JS_CODE, 1))))
    )


def from_calls(path: Column, parameters: Column, calls: Column) -> Column:
    """The first call of a method with a request that registers a route."""
    call = F.get(F.filter(calls, lambda c: F.lower(F.coalesce(_said(c["code"]), F.lit(""))).rlike(JS_CALL)), F.lit(0))
    name = F.lower(F.coalesce(_said(call["name"]), _said(call["resolved"]), F.lit("route")))
    route = _route("web-route", F.coalesce(_said(call["code"]), _said(call["name"]), F.lit("route")), F.upper(_last(F.split(name, r"\."))))
    return F.when(call.isNotNull() & ~path.endswith(".java") & request_of(parameters).isNotNull(), route)


def from_parameter(full_name: Column, name: Column, path: Column, parameters: Column) -> Column:
    """A method that takes a request is an input of a framework."""
    given = request_of(parameters)
    route = _route("framework-input", F.coalesce(name, _last(F.split(full_name, ":"))), F.lit(None), F.coalesce(given["name"], F.lit("request")))
    return F.when(given.isNotNull() & ~path.endswith(".java") & ~full_name.endswith("::program"), route)


def python_routes(methods: DataFrame, lines: DataFrame) -> DataFrame:
    """repo_id, full_name, path, line, route: the last decorator in the 12 lines above a Python method."""
    line = F.col("line").cast("long")
    wanted = methods.where("line > 1").where(F.col("path").endswith(".py"))
    above = _beside(wanted, lines, F.greatest(line - DECORATOR_LINES, F.lit(1)), line - 1)
    text = F.array_join(F.transform("near", lambda x: x["text"]), "\n")
    found = above.select("repo_id", "full_name", "path", "line", _last(F.regexp_extract_all(text, F.lit(PYTHON_DECORATOR), F.lit(0))).alias("found")).where("found IS NOT NULL")
    verb, rest = F.regexp_extract("found", PYTHON_DECORATOR, 1), F.regexp_extract("found", PYTHON_DECORATOR, 3)
    method = F.when(verb != "route", F.upper(verb)).otherwise(F.coalesce(F.upper(_group(rest, PYTHON_METHODS)), F.lit("ANY")))
    return found.select("repo_id", "full_name", "path", "line", _route("python-web", F.regexp_extract("found", PYTHON_DECORATOR, 2), method).alias("route"))


def go_routes(files: DataFrame) -> DataFrame:
    """repo_id, name, route: how each name is first registered in Go files, by path; in a file Handle and HandleFunc come before methods of a router."""
    files = files.where(F.col("path").endswith(".go")).select("repo_id", "path", "content")
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("content", F.lit(p), F.lit(0)).alias("found")) for k, p in enumerate((GO_HANDLE, GO_ROUTER))))
    each = files.select("repo_id", "path", F.explode(kinds).alias("k")).select("repo_id", "path", "k.kind", F.posexplode("k.found").alias("nth", "text"))
    handle = F.col("kind") == 0
    pick = lambda a, b: F.when(handle, F.regexp_extract("text", GO_HANDLE, a)).otherwise(F.regexp_extract("text", GO_ROUTER, b))
    method = F.when(handle, "ANY").otherwise(F.upper(F.regexp_extract("text", GO_ROUTER, 1)))
    named = each.select("repo_id", pick(2, 3).alias("name"), F.struct("path", "kind", "nth").alias("order"), _route("go-web", pick(1, 2), method).alias("route"))
    return named.groupBy("repo_id", "name").agg(F.min_by("route", "order").alias("route"))


def arguments(code: Column) -> Column:
    """The arguments between a text's first and last parenthesis, cut at commas outside of quotes and brackets."""
    start, end = F.instr(code, "("), F.length(code) - F.instr(F.reverse(code), ")") + 1
    inner = F.substring(code, start + 1, end - start - 1)
    state = "struct<at:int,depth:int,quote:string,escaped:boolean,cuts:array<int>>"
    first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit("").alias("quote"), F.lit(False).alias("escaped"), F.array().cast("array<int>").alias("cuts")).cast(state)

    def step(s: Column, c: Column) -> Column:
        quoted, mark, top = s["quote"] != "", c.isin("'", '"', "`"), s["depth"] == 0
        quote = F.when(quoted & ~s["escaped"] & (c == s["quote"]), "").when(~quoted & mark, c).otherwise(s["quote"])
        depth = F.when(quoted, s["depth"]).when(c.isin("(", "[", "{"), s["depth"] + 1).when(c.isin(")", "]", "}"), F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        cuts = F.when(~quoted & (c == ",") & top, F.concat(s["cuts"], F.array(s["at"] + 1))).otherwise(s["cuts"])
        return F.struct((s["at"] + 1).alias("at"), depth.alias("depth"), quote.alias("quote"), (quoted & ~s["escaped"] & (c == "\\")).alias("escaped"), cuts.alias("cuts")).cast(state)

    cuts = F.aggregate(F.split(inner, ""), first, step, lambda s: F.concat(F.array(F.lit(0)), s["cuts"], F.array(F.length(inner) + 1)))
    parts = F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), lambda k: F.trim(F.substring(inner, F.element_at(cuts, k) + 1, F.element_at(cuts, k + 1) - F.element_at(cuts, k) - 1)))
    parts = F.filter(parts, lambda p, k: (p != "") | (k < F.size(parts) - 1))  # nothing behind the last comma is no argument
    return F.when((start > 0) & (F.instr(code, ")") > 0) & (end > start), parts).otherwise(F.array().cast("array<string>"))


def _handler(argument: Column) -> Column:
    name = F.coalesce(_group(argument, NAME), _group(argument, ASYNC), _group(argument, FACTORY))
    return F.when(~argument.rlike(r"^[\"'`{]") & (argument != ""), name)


def registrations(methods: DataFrame) -> DataFrame:
    """Calls that give a route to handlers: repo_id, order, line, route, verb, handler and exact (what same-line calls of that name resolve to).

    order puts calls in the order of their method's path, line and name, then of the calls and their arguments.
    """
    empty = F.lit("")
    calls = methods.select("repo_id", "path", "line", "full_name", "calls", F.explode("calls").alias("call")).select("repo_id", "path", "line", "full_name", "calls", "call.nth", F.col("call.name").alias("called"), "call.resolved", F.col("call.line").alias("at_line"), _said(F.col("call.code")).alias("code"))
    calls = calls.where(F.col("code").rlike(VERB_CALL))
    named = lambda c: F.when(_last(F.split(F.lower(_said(c)), "[.:#]")).isin(*VERBS), _last(F.split(F.lower(_said(c)), "[.:#]")))
    verb = F.coalesce(named(F.col("called")), named(F.col("resolved")), F.lower(_group(F.col("code"), VERB_CALL)))
    once = lambda value, name: F.explode(F.array_compact(F.array(value))).alias(name)  # noqa: E731  rows without a value leave, and what follows reads it instead of repeating it
    calls = calls.select("*", once(verb, "verb"))
    pattern = F.replace(F.lit(RECEIVER), F.lit("{verb}"), F.col("verb"))
    part = lambda k: F.nullif(F.call_function("regexp_extract", F.col("code"), pattern, F.lit(k)), F.lit(""))
    calls = calls.select("*", once(F.when(part(1).isNotNull(), F.struct(part(1).alias("receiver"), F.coalesce(part(2), part(3)).alias("route"))), "found")).select("*", "found.*").drop("found")
    typed = F.lower(F.coalesce(_said(F.col("resolved")), empty)).rlike(ROUTER_TYPE)
    calls = calls.where(typed | F.lower(_last(F.split("receiver", r"\."))).rlike(ROUTER_NAME))
    given = arguments(F.col("code"))
    handlers = F.array_distinct(F.filter(F.transform(F.slice(given, 2, F.greatest(F.size(given) - 1, F.lit(0))), _handler), lambda h: h.isNotNull() & ~h.isin(*NO_HANDLERS)))
    calls = calls.select("*", once(handlers, "handlers")).select("*", F.posexplode("handlers").alias("at", "handler"))
    same = F.filter("calls", lambda c: c["line"].eqNullSafe(F.col("at_line")) & (_said(c["name"]).eqNullSafe(F.col("handler")) | _last(F.split(_said(c["resolved"]), ":")).eqNullSafe(F.col("handler"))))
    exact = F.array_distinct(F.filter(F.transform(same, lambda c: _said(c["resolved"])), lambda r: r.isNotNull()))
    order = F.struct("path", "line", "full_name", "nth", "at")
    return calls.select("repo_id", order.alias("order"), "route", F.upper("verb").alias("verb"), "handler", exact.alias("exact"))


def registered_routes(methods: DataFrame) -> DataFrame:
    """repo_id, full_name, route: handlers of registrations, and the methods nested in them that take a request.

    A handler's name stands for the method that a call of that name in the same line resolves to, else for
    the only method of the repository with that name; where that is none or several, for nothing. Taken one
    after another, registrations give each method its first route, and pass over one that has a route already.
    A method nested in a handler is nested in all that the handler is nested in, so what a passed-over
    registration would give, an earlier one has given: the first of a method's own registrations and of those
    of the methods around it decides, which takes one join on the beginnings of its name and no iteration.
    """
    known = methods.where((F.trim("full_name") != "") & (F.trim("path") != ""))
    names = F.array_distinct(F.filter(F.array(_said(F.col("name")), _said(_last(F.split("full_name", ":")))), lambda n: n.isNotNull()))
    found = registrations(methods)
    full = known.select("repo_id", "full_name").distinct()
    by_call = found.select("repo_id", "order", "handler", F.explode("exact").alias("full_name")).join(full, ["repo_id", "full_name"])
    by_call = by_call.groupBy("repo_id", "order").agg(F.count("*").alias("n"), F.min("full_name").alias("called"))
    lone = known.select("repo_id", F.explode(names).alias("handler"), "full_name").groupBy("repo_id", "handler").agg(F.min("full_name").alias("named"), F.max("full_name").alias("other")).where("named = other").drop("other")
    resolved = found.join(by_call, ["repo_id", "order"], "left").join(lone, ["repo_id", "handler"], "left")
    target = F.when(F.col("n").isNull(), F.col("named")).when(F.col("n") == 1, F.col("called"))
    direct = resolved.select("repo_id", target.alias("target"), "order", "route", "verb").where("target IS NOT NULL")
    direct = direct.groupBy("repo_id", "target").agg(F.min(F.struct("order", "route", "verb")).alias("r"))
    given = request_of(F.col("parameters"))
    mine = known.groupBy("repo_id", "full_name").agg(F.first(F.struct(given.isNotNull().alias("asked"), given["name"].alias("source")), ignorenulls=True).alias("m")).select("repo_id", "full_name", "m.*")
    colons = F.filter(F.sequence(F.lit(1), F.length("full_name")), lambda k: F.substring("full_name", k, F.lit(1)) == ":")
    around = F.transform(colons, lambda k: F.substring("full_name", F.lit(1), k - 1))
    around = F.when(F.col("asked"), F.concat(around, F.array("full_name"))).otherwise(F.array("full_name"))
    got = mine.withColumn("target", F.explode(F.array_distinct(around))).join(direct, ["repo_id", "target"]).groupBy("repo_id", "full_name").agg(F.min("r").alias("r"), F.first("source").alias("source"))
    return got.select("repo_id", "full_name", _route("javascript-web", F.col("r.route"), F.col("r.verb"), F.coalesce("source", F.lit("request"))).alias("route"))


def routes(methods: DataFrame, files: DataFrame) -> DataFrame:
    """methods with boundary, the first of: an annotation's route, the code's, a registered, a decorator's or a Go one, a call's, the request's.

    Null where a method has none. Null arrays count as empty; methods that repeat a name, path and line get equal routes.
    """
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    kinds = {"annotations": "array<struct<name:string,code:string>>", "parameters": "array<struct<name:string,type:string>>", "calls": "array<struct<nth:bigint,name:string,resolved:string,code:string,line:bigint>>"}
    rows = methods.withColumns({c: empty(c, k) for c, k in kinds.items()})
    key = ["repo_id", "full_name", "path", "line"]
    rows = rows.join(registered_routes(rows).withColumnRenamed("route", "registered"), ["repo_id", "full_name"], "left")
    rows = rows.join(python_routes(rows, lines_of(files)).withColumnRenamed("route", "decorated"), key, "left")
    go = go_routes(files).select(F.col("repo_id").alias("go_repo"), F.col("name").alias("go_name"), F.col("route").alias("handled"))
    rows = rows.join(go, (F.col("repo_id") == F.col("go_repo")) & (F.col("name") == F.col("go_name")) & F.col("path").endswith(".go"), "left").drop("go_repo", "go_name")
    p = F.col("parameters")
    first = F.coalesce(from_annotations(F.col("annotations")), from_code(F.col("code"), p), "registered", "decorated", "handled", from_calls(F.col("path"), p, F.col("calls")), from_parameter(F.col("full_name"), F.col("name"), F.col("path"), p))
    return rows.withColumn("boundary", first.cast(ROUTE)).drop("registered", "decorated", "handled")


def enriched(methods: DataFrame, files: DataFrame) -> DataFrame:
    """Methods as entities: their source text in place of their code where their file has it, and their route as boundary."""
    blocks = source_blocks(methods, files).select("repo_id", "full_name", "path", "line", "source")
    rows = routes(methods, files).join(blocks, ["repo_id", "full_name", "path", "line"], "left")
    return rows.withColumn("code", F.coalesce("source", "code")).drop("source")
