"""Files of code with routes, derived from the lines of documents by expressions that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines by extension and shape (0 to 8); shapes without an entry keep the document's own line. {w} and {next} are expressions.
SHAPES = {
    "py": {0: "@app.route(''/{w}'', methods=[''POST''])", 1: '@bp.get("/{w}/x")', 2: "def {m}(req):", 3: "class {w}:", 4: "", 5: "def {m}(self, a):", 6: "@app.route(''/r{w}'')"},
    "go": {0: 'http.HandleFunc("/{w}", {next})', 1: 'r.GET("/{w}", {next})', 2: "func {m}(req *http.Request) {", 3: "mux.Any(`/{w}`, {next})", 5: "func {m}(x int) {"},
    "java": {0: '@GetMapping("/{w}")', 1: "@RequestMapping(path = ''/{w}'', method = RequestMethod.POST)", 2: "void {m}(HttpServletRequest r) {", 3: "@PostMapping", 5: "void {m}(int x) {"},
    "js": {0: "app.get(''/{w}'', {next})", 1: 'router.post("/{w}", asyncHandler(utils.{next}(1)))', 2: "function {m}(req, res) {", 5: "function {m}(x) {", 6: "app.use({next}, ''/{w}'')"},
}
W, M, NEXT = "'w' || (length(t) % 23)", "'m' || ((doc_id * 31 + n) % 2003)", "'m' || ((doc_id * 31 + n + 1) % 2003)"
EXT = "CASE doc_id % 4 WHEN 0 THEN 'py' WHEN 1 THEN 'go' WHEN 2 THEN 'java' ELSE 'js' END"
SHAPE = "(length(t) + n) % 9"


def _text(shape: str) -> str:
    for name, expression in (("w", W), ("m", M), ("next", NEXT)):
        shape = shape.replace("{" + name + "}", f"' || {expression} || '")
    return f"'{shape}'"


LINE = "CASE " + " ".join(f"WHEN doc_id % 4 = {e} THEN CASE {SHAPE} {' '.join(f'WHEN {k} THEN {_text(s)}' for k, s in shapes.items())} ELSE t END" for e, shapes in enumerate(SHAPES.values())) + " END"
INDENT = "repeat(' ', CAST((length(t) % 3) * 2 AS INT))"
PATH = f"'src/d' || doc_id || '.' || {EXT}"
#: The columns of lines, over (doc_id, source, n, t).
COLUMNS = {"doc_id": "doc_id", "repo_id": "source", "path": PATH, "n": "n", "shape": SHAPE, "name": M, "text": f"{INDENT} || {LINE}"}
#: Those of methods, over lines with before and after: the lines beside them.
METHODS = {
    "repo_id": "repo_id", "full_name": "path || ':' || name || CASE WHEN n % 4 = 0 THEN ':inner' || n ELSE '' END", "name": "CASE WHEN n % 4 > 0 THEN name END", "path": "path", "line": "n", "code": "CASE WHEN n % 2 = 0 THEN coalesce(before, '') || chr(10) || text ELSE text END",
    "annotation": "CASE WHEN n % 3 = 0 AND contains(before, 'Mapping') THEN before END", "parameter": "CASE WHEN shape = 2 THEN 'req' ELSE 'x' END", "kind": "CASE WHEN shape = 2 AND doc_id % 4 = 2 THEN 'HttpServletRequest' END", "call": "CASE WHEN n % 5 < 3 THEN after END",
}


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    each = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("at", "t")).selectExpr("doc_id", "source", "CAST(at + 1 AS BIGINT) AS n", "t")
    return each.selectExpr(*(f"{e} AS {c}" for c, e in COLUMNS.items()))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("n", "text")))
    return lines(spark, sf_dir).groupBy("repo_id", "path").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("content"))


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    beside = "lag(text) OVER (PARTITION BY doc_id ORDER BY n) AS before", "lead(text) OVER (PARTITION BY doc_id ORDER BY n) AS after"
    rows = lines(spark, sf_dir).selectExpr("*", *beside).where("shape IN (2, 5)").selectExpr(*(f"{e} AS {c}" for c, e in METHODS.items()))
    annotation = F.struct(F.regexp_extract("annotation", r"@(\w+)", 1).alias("name"), F.col("annotation").alias("code"))
    call = F.struct(F.lit(0).cast("long").alias("nth"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("resolved"), F.col("call").alias("code"), (F.col("line") + 1).alias("line"))
    one = lambda test, value: F.when(F.col(test).isNotNull(), F.array(value))
    return rows.select("repo_id", "full_name", "name", "path", "line", "code", one("annotation", annotation).alias("annotations"), F.array(F.struct(F.col("parameter").alias("name"), F.col("kind").alias("type"))).alias("parameters"), one("call", call).alias("calls"))


_EACH = f"""src AS (SELECT doc_id, source, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS t FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)),
lines AS (SELECT {', '.join(f'{e} AS {c}' for c, e in COLUMNS.items())} FROM src)"""
LINES_SQL = _EACH
METHODS_SQL = f"""{_EACH}, beside AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY n) AS before, lead(text) OVER (PARTITION BY doc_id ORDER BY n) AS after FROM lines),
methods AS (SELECT {', '.join(f'{e} AS {c}' for c, e in METHODS.items())}, shape = 2 AS asked FROM beside WHERE shape IN (2, 5))"""
