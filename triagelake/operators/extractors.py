"""Rows found in lines of code: imports, functions by their braces, state changed after a call.

Lines are (path, line_no, line). A window never spans more than one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What an import looks like, by the extension of its file.
JS_IMPORT = r"(?:\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)['\"]([^'\"]+)['\"]"
PY_IMPORT, PY_FROM = r"^\s*import\s+(.+)$", r"^\s*from\s+([A-Za-z_]\w*)[\w.]*\s+import\b"
GO_IMPORT = r"[\"`]([^\"`]+)[\"`]"
JAVA_IMPORT = r"^\s*import\s+(?:static\s+)?([\w.]+)"
VALUE_CALL, STATE_CHANGE = r"\.call\s*\{\s*value|\.call\.value\s*\(|\.send\s*\(", r"balances\s*\[[^\]]+\]\s*(-=|=[^=])"


def _js_package(name: Column) -> Column:
    """Scope and name, or the first segment; null for relative paths, node: and urls."""
    return F.when(~name.rlike(r"^(\.|/|[A-Za-z][A-Za-z0-9+.-]*:)"), F.regexp_extract(name, "^(@[^/]+/[^/]+|[^/]+)", 1))


def packages(path: Column, line: Column) -> Column:
    """The packages that a line imports, as an array; none for other files."""
    java = F.regexp_extract(line, JAVA_IMPORT, 1)
    parts = F.split(java, r"\.")
    python = F.concat(F.transform(F.split(F.regexp_extract(line, PY_IMPORT, 1), ","), lambda x: F.regexp_extract(x, r"^\s*([A-Za-z_]\w*)", 1)), F.array(F.regexp_extract(line, PY_FROM, 1)))
    named = (
        F.when(path.rlike(r"\.[cm]?[jt]sx?$"), F.transform(F.regexp_extract_all(line, F.lit(JS_IMPORT), F.lit(1)), _js_package))
        .when(path.endswith(".py"), python)
        .when(path.endswith(".go"), F.filter(F.regexp_extract_all(line, F.lit(GO_IMPORT), F.lit(1)), lambda x: x.contains(".") & ~x.startswith(".")))
        .when(path.endswith(".java") & ~java.rlike(r"^javax?\.") & (F.size(parts) > 1), F.array(F.array_join(F.slice(parts, 1, 3), ".")))
    )
    return F.filter(named, lambda x: x.isNotNull() & (x != ""))


def imports(lines: DataFrame) -> DataFrame:
    """path, line_no, package, each once. Lines that cannot hold an import leave before the shuffle."""
    return lines.select("path", "line_no", F.explode(packages(F.col("path"), F.col("line"))).alias("package")).distinct()


def _marked(lines: DataFrame) -> DataFrame:
    """lines with what functions are found by: step (braces opened less those closed), closes, named and contract_named."""
    braces = lambda b: F.char_length("line") - F.char_length(F.replace("line", F.lit(b), F.lit("")))
    some = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    return lines.withColumns({"step": braces("{") - braces("}"), "closes": F.col("line").contains("}"), "named": some(r"\bfunction\s+(\w+)"), "contract_named": some(r"\bcontract\s+(\w+)")})


def _inside(marked: DataFrame, depth: int) -> DataFrame:
    """Marked lines that lie in a function, with contract, function and start. All windows read one order, so lines are sorted once."""
    in_order = Window.partitionBy("path").orderBy("line_no")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    deep = marked.withColumn("after", F.sum("step").over(so_far)).withColumn("contract", F.last("contract_named", ignorenulls=True).over(so_far)).drop("contract_named")
    starts = F.col("named").isNotNull() & (F.col("after") - F.col("step") == depth)
    head = F.last(F.when(starts, F.struct(F.col("named").alias("function"), F.col("line_no").alias("start"))), ignorenulls=True).over(so_far)
    ends = F.when((F.col("after") <= depth) & F.col("closes"), F.col("line_no"))
    ended = F.max(ends).over(in_order.rangeBetween(Window.unboundedPreceding, -1))
    inside = deep.withColumns({"head": head, "ended": ended}).where("head IS NOT NULL AND (ended IS NULL OR ended < head.start)")
    return inside.select("*", "head.*").drop("head", "ended", "named", "step", "after", "closes")


def functions(lines: DataFrame, depth: int = 1) -> DataFrame:
    """lines of functions, with contract, function and the line it starts in.

    A function starts at brace depth `depth` and ends where the depth returns to it, so that what is nested
    in it belongs to it. The contract is the last one named before.
    """
    return _inside(_marked(lines), depth)


def reentrant(lines: DataFrame) -> DataFrame:
    """path, contract, function, call_line, state_line: a balance changed in or after the line of a value call.

    Texts of lines are read before they are sorted, and lines that say nothing of this are left out.
    """
    calls, changes = F.col("line").rlike(VALUE_CALL), F.col("line").rlike(STATE_CHANGE)
    marked = _marked(lines).withColumns({"calls": calls, "changes": changes}).select("path", "line_no", "step", "closes", "named", "contract_named", "calls", "changes")
    marked = marked.where("step <> 0 OR closes OR calls OR changes OR named IS NOT NULL OR contract_named IS NOT NULL")
    at = lambda flag: F.when(F.col(flag), F.col("line_no"))
    each = _inside(marked, 1).where("calls OR changes").groupBy("path", "contract", "function", "start").agg(F.min(at("calls")).alias("call_line"), F.collect_list(at("changes")).alias("states"))
    later = F.array_min(F.filter("states", lambda x: x >= F.col("call_line")))
    return each.withColumn("state_line", later).where("state_line IS NOT NULL").select("path", "contract", "function", "call_line", "state_line")
