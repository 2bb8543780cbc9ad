"""Slices of programs from code analysis: entities, flow seeds and component usages in JSON, and calls in tabular text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TARGET = "struct<name string, resolvedMethod string, code string, label string, lineNumber long>"
ENTITIES = f"objectSlices array<struct<fullName string, fileName string, lineNumber long, boundary struct<type string, route string, method string, source string>, parameters array<struct<name string, typeFullName string>>, usages array<struct<targetObj {_TARGET}>>>>"
SEEDS = "array<struct<flows array<struct<label string, tags string, parentFileName string, parentMethodName string, parentClassName string, lineNumber long, name string, code string>>>>"
USAGES = "componentUsages array<struct<packageName string, repoPath string, usageKind string, lineRange struct<startLine long, endLine long>>>"
#: The seeds that count, and kinds of usage.
LABEL, TAG, KINDS = "METHOD_PARAMETER_IN", "framework-input", ("imported", "used")
#: Parameters that carry requests.
REQUEST_PARAMETER = r"(?i)^(req|request|ctx|context|body|params|query)$"


def entities(slices: DataFrame, files: DataFrame) -> DataFrame:
    """Entities of slices (repo_id, raw), as operators/sink_rules reads them: of files of the snapshot, with name, path and line."""
    rows = slices.select("repo_id", F.explode(F.from_json("raw", ENTITIES)["objectSlices"]).alias("s"))
    calls = F.transform(F.filter("s.usages", lambda u: u["targetObj"]["label"] == "CALL"), lambda u, i: F.struct(i.cast("long").alias("nth"), u["targetObj"]["name"].alias("name"), u["targetObj"]["resolvedMethod"].alias("resolved"), u["targetObj"]["code"].alias("code"), u["targetObj"]["lineNumber"].alias("line")))
    parameters = F.transform("s.parameters", lambda p: F.struct(p["name"].alias("name"), p["typeFullName"].alias("type")))
    rows = rows.select("repo_id", F.col("s.fullName").alias("full_name"), F.col("s.fileName").alias("path"), F.col("s.lineNumber").alias("line"), F.col("s.boundary").alias("boundary"), F.coalesce(parameters, F.array().cast("array<struct<name:string,type:string>>")).alias("parameters"), F.coalesce(calls, F.array().cast("array<struct<nth:bigint,name:string,resolved:string,code:string,line:bigint>>")).alias("calls"))
    return rows.where("full_name <> '' AND path <> '' AND line > 0").join(files.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")


def seeds(flows: DataFrame, files: DataFrame) -> DataFrame:
    """repo_id, full_name, path, line, source_name of a framework's inputs in flows (repo_id, raw)."""
    rows = flows.select("repo_id", F.explode(F.from_json("raw", SEEDS)).alias("r")).select("repo_id", F.explode("r.flows").alias("f"))
    owner = F.coalesce(F.concat("f.parentClassName", F.lit(":"), "f.parentMethodName"), F.concat("f.parentFileName", F.lit("::program:"), "f.parentMethodName"))
    rows = rows.where((F.col("f.label") == LABEL) & F.contains("f.tags", F.lit(TAG))).select("repo_id", owner.alias("full_name"), F.col("f.parentFileName").alias("path"), F.col("f.lineNumber").alias("line"), F.coalesce("f.name", "f.code").alias("source_name"))
    return rows.where("full_name IS NOT NULL AND line > 0 AND source_name IS NOT NULL").join(files.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")


def usages(slices: DataFrame) -> DataFrame:
    """repo_id, package, path, kind, line, end_line of imports and uses with a valid range, each once."""
    rows = slices.select("repo_id", F.explode(F.from_json("raw", USAGES)["componentUsages"]).alias("u"))
    r = F.col("u.lineRange")
    rows = rows.select("repo_id", F.col("u.packageName").alias("package"), F.col("u.repoPath").alias("path"), F.col("u.usageKind").alias("kind"), r["startLine"].alias("line"), F.coalesce(F.when(r["endLine"] > 0, r["endLine"]), r["startLine"]).alias("end_line"))
    return rows.where(F.col("kind").isin(*KINDS) & (F.col("line") > 0) & (F.col("package") != "") & (F.col("path") != "")).distinct()


def _plain(column: Column) -> Column:
    return F.try_to_binary(column, F.lit("base64")).cast("string")


def rows_of(lines: DataFrame) -> DataFrame:
    """Lines (repo_id, line) of METHOD, CALL and PARAM rows, by columns: record, method, path, number, name, code, arguments.

    Fields are parted by tabs; names and codes are base64, arguments a `;` list of base64 pairs parted by commas.
    """
    part = F.split("line", "\t")
    get = lambda k: F.get(part, F.lit(k))
    arguments = F.transform(F.filter(F.split(F.coalesce(get(6), F.lit("")), ";"), lambda x: x != ""), lambda x: F.array_join(F.transform(F.split(x, ","), _plain), "="))
    return lines.where(get(0).isin("METHOD", "CALL", "PARAM")).select("repo_id", get(0).alias("record"), _plain(get(1)).alias("method"), _plain(get(2)).alias("path"), get(3).cast("long").alias("number"), _plain(get(4)).alias("name"), _plain(get(5)).alias("code"), arguments.alias("arguments"))


def assembled(rows: DataFrame) -> DataFrame:
    """repo_id, full_name, path, line, parameters, calls: methods with their parameters and calls, in the order of lines."""
    methods = rows.where("record = 'METHOD'").groupBy("repo_id", "method").agg(F.min(F.struct("number", "path")).alias("m")).select("repo_id", F.col("method").alias("full_name"), "m.path", F.col("m.number").alias("line"))
    calls = rows.where("record = 'CALL'").groupBy("repo_id", F.col("method").alias("full_name")).agg(F.array_sort(F.collect_list(F.struct("number", "name", "code"))).alias("calls"))
    parameters = rows.where("record = 'PARAM'").groupBy("repo_id", F.col("method").alias("full_name")).agg(F.array_sort(F.collect_list(F.struct("number", "name"))).alias("parameters"))
    return methods.join(calls, ["repo_id", "full_name"], "left").join(parameters, ["repo_id", "full_name"], "left")


def request_seeds(rows: DataFrame) -> DataFrame:
    """repo_id, full_name, path, line, source_name: parameters of methods that carry requests, at their own line or else the method's."""
    methods = rows.where("record = 'METHOD'").groupBy("repo_id", "method").agg(F.min(F.struct("number", "path")).alias("m"))
    asked = rows.where("record = 'PARAM'").where(F.col("name").rlike(REQUEST_PARAMETER)).select("repo_id", "method", F.col("number").alias("own"), "name")
    return asked.join(methods, ["repo_id", "method"]).select("repo_id", F.col("method").alias("full_name"), "m.path", F.coalesce(F.when(F.col("own") > 0, F.col("own")), "m.number").alias("line"), F.col("name").alias("source_name"))
