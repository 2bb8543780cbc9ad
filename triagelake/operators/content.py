"""Hidden and sensitive content of web applications: routes, matchers, assets and clues, from lines and paths.

Each finder gives repo_id, path, n, exposure, subject. Input lines are (repo_id, path, n, line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions import findings as fn
from triagelake.functions import paths

from .workflows import FILE

#: Patterns of lines.
SERVER_ROUTE = r"(?i)\bapp\.(get|post|put|patch|delete|use)\(\s*(['\"`])([^'\"`]+)\2"
HIDDEN_ROUTE = r"/(?:hidden|private|secret|easter|paywall)\b|/the/devs/|/we/may/also/|/this/page/is/hidden"
MATCHER, FUNCTION = r"\bmatcher\s*:\s*([A-Za-z_$][\w$]*)", r"\b(?:export\s+)?function\s+([A-Za-z_$][\w$]*)\s*\("
OBFUSCATED = (".tostring(36)", "fromcharcode", ".reverse()", "charcodeat", "atob(", "decodeuricomponent(")
CLIENT_ROUTE = r"\bpath\s*:\s*(['\"`])([^'\"`]+)\1"
SENSITIVE = r"\b(?:admin|administration|backoffice|debug|sandbox|devtools|internal|console|superuser)\b"
GUARDED, GUARD = r"\bcanactivate\s*:", r"\b(?:adminguard|roleguard|permissionguard|rbac|acl|authorization)\b"
PRIVATE_ASSET = r"(['\"`])([^'\"`]*assets/private/[^'\"`\s)]+)\1"
CLUE, NAMED_CLUE = r"(?i)steganograph|pickle\s+rick", r"(?i)%\s*([^%]*pickle\s+rick[^%]*)\s*%"
#: A route of so many segments and characters looks hidden.
MANY_SEGMENTS, MANY_CHARACTERS = 8, 72
#: Rules of code patterns: id, severity, pattern.
CODE_RULES = (("javascript-eval", "ERROR", r"(?<![\w$.])eval\s*\("), ("javascript-function-constructor", "WARNING", r"\bnew\s+Function\s*\("))


def _found(rows: DataFrame, exposure: str, subject: Column) -> DataFrame:
    evidence = fn.stable_id("content", F.lit(exposure.replace("_", "-")), F.col("path"), F.col("line"))
    return rows.select(*FILE, "n", F.lit(exposure).alias("exposure"), subject.alias("subject"), evidence.alias("evidence_id"))


def code_patterns(lines: DataFrame) -> DataFrame:
    """repo_id, path, n, rule_id, severity: lines of JavaScript and TypeScript files that a rule matches."""
    hits = F.array(*(F.when(F.col("line").rlike(pattern), F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"))) for rule, severity, pattern in CODE_RULES))
    script = lines.where(paths.supported(F.col("path")).isin("javascript", "typescript"))
    return script.select(*FILE, "n", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("hit")).select(*FILE, "n", "hit.*")


def server_routes(lines: DataFrame) -> DataFrame:
    """`METHOD /route` of handlers whose route looks hidden."""
    route, method = F.regexp_extract("line", SERVER_ROUTE, 3), F.upper(F.regexp_extract("line", SERVER_ROUTE, 1))
    low = F.lower(route)
    deep = (F.size(F.filter(F.split(low, "/"), lambda x: x != "")) >= MANY_SEGMENTS) & (F.length(low) >= MANY_CHARACTERS)
    return _found(lines.where((route != "") & (low.rlike(HIDDEN_ROUTE) | deep)), "hidden_server_route", F.concat(method, F.lit(" "), route))


def matchers(lines: DataFrame) -> DataFrame:
    """Names of matchers whose function, up to the next one of its file, looks obfuscated."""
    name = F.regexp_extract("line", FUNCTION, 1)
    block = F.sum(F.when(name != "", 1).otherwise(0)).over(Window.partitionBy(*FILE).orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    bad = F.lit(False)
    for sign in OBFUSCATED:
        bad = bad | F.lower("line").contains(sign)
    functions = lines.withColumns({"function": name, "block": block, "bad": bad}).where("block > 0")
    functions = functions.groupBy(*FILE, "block").agg(F.max("function").alias("subject"), F.max("bad").alias("bad")).where("bad").select(*FILE, "subject").distinct()
    used = lines.withColumn("subject", F.regexp_extract("line", MATCHER, 1)).where("subject <> ''").join(functions, [*FILE, "subject"], "left_semi")
    return _found(used, "obfuscated_frontend_route", F.col("subject"))


def client_routes(lines: DataFrame) -> DataFrame:
    """Routes with an administrator's word, or guarded within two lines before and four after."""
    near = Window.partitionBy(*FILE).orderBy("n").rowsBetween(-2, 4)
    rows = lines.where(F.col("path").rlike(paths.RUNTIME)).withColumn("block", F.lower(F.array_join(F.collect_list("line").over(near), "\n")))
    route = F.regexp_extract("line", CLIENT_ROUTE, 2)
    sensitive = F.lower(route).rlike(SENSITIVE) | (F.col("block").rlike(GUARDED) & F.col("block").rlike(GUARD))
    return _found(rows.where((route != "") & sensitive), "sensitive_frontend_route", route)


def private_assets(lines: DataFrame) -> DataFrame:
    asset = F.regexp_extract("line", PRIVATE_ASSET, 2)
    return _found(lines.where(F.col("path").rlike(paths.RUNTIME) & (asset != "")), "private_asset_reference", asset)


def clues(lines: DataFrame) -> DataFrame:
    named = F.trim(F.regexp_extract("line", NAMED_CLUE, 1))
    return _found(lines.where(F.col("line").rlike(CLUE)), "steganography_content_clue", F.when(named != "", named).otherwise("hidden image clue"))


def assets(files: DataFrame) -> DataFrame:
    """Images that seem to hide something, by their path alone: no text is read."""
    rows = files.where(paths.is_hidden_asset(F.col("path"))).select(*FILE, F.lit(1).cast("long").alias("n"), F.col("path").alias("line"))
    return _found(rows, "steganography_asset", F.col("path"))


def exposures(files: DataFrame, lines: DataFrame) -> DataFrame:
    """What all finders see in text files and paths, ignored and generated paths left out."""
    text = lines.where(paths.is_content_text(F.col("path")) & ~F.col("path").rlike(paths.IGNORED_CONTENT))
    out = assets(files)
    for finder in (server_routes, matchers, client_routes, private_assets, clues):
        out = out.unionByName(finder(text))
    return out


def routed(files: DataFrame) -> DataFrame:
    """repo_id and how many files go to each family of extractors, in one pass over paths."""
    path = F.col("path")
    flags = {"contracts": paths.is_contract(path), "content": paths.is_content_text(path) | paths.is_hidden_asset(path), "workflows": paths.is_workflow(path), "infra": paths.is_infra(path)}
    return files.groupBy("repo_id").agg(*(F.count_if(flag).alias(f"n_{name}") for name, flag in flags.items()))
