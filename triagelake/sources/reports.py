"""Reports of scanners: JSON of every shape to records, and records of each tool to one table of candidates.

Values are read from VARIANT columns by type: a number is no text, and an empty text is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions import paths

_FENCE = r"(?is)```(?:json)?[ \t]*\r?\n(.*?)\r?\n```"
_LIST, _OBJECT = "array<variant>", "map<string,variant>"
#: Lists of a result that carry its target.
NESTED = ("Vulnerabilities", "Misconfigurations", "Secrets")


def parsed(raw: Column) -> Column:
    """Strict JSON, else the body of a fence, else what lies between the first and last bracket; null if none is JSON."""
    text = F.trim(raw)
    slice_ = F.regexp_extract(text, r"(?s)[\[{].*[\]}]", 0)
    fenced = F.get(F.filter(F.transform(F.regexp_extract_all(text, F.lit(_FENCE), F.lit(1)), lambda x: F.try_parse_json(F.nullif(F.trim(x), F.lit("")))), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(F.try_parse_json(text), fenced, F.try_parse_json(slice_))


def _list(value: Column, at: str = "$") -> Column:
    return F.try_variant_get(value, at, _LIST)


def text(value: Column, at: str) -> Column:
    found = F.try_variant_get(value, at, "variant")
    plain = F.try_variant_get(value, at, "string")
    return F.when((F.schema_of_variant(found) == "STRING") & (plain != ""), plain)


def number(value: Column, at: str) -> Column:
    found = F.try_variant_get(value, at, "variant")
    return F.when(F.schema_of_variant(found).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(value, at, "double").cast("long"))


def records(reports: DataFrame) -> DataFrame:
    """reports and one row for each record: ord, target (the result's, where it has one), item.

    Arrays, Results (with Vulnerabilities, Misconfigurations and Secrets), results, runs, Vulnerabilities and
    components are looked for in that order; other objects and blank reports give no rows. See failures.
    """
    with_value = reports.withColumn("value", parsed(F.col("raw")))
    value = F.col("value")
    plain = lambda rows: F.transform(rows, lambda x: F.struct(F.lit(None).cast("string").alias("target"), x.alias("item")))

    def nested(result: Column) -> Column:
        target = text(result, "$.Target")
        parts = [F.coalesce(F.transform(_list(result, f"$.{name}"), lambda x: F.struct(target.alias("target"), x.alias("item"))), F.array().cast("array<struct<target:string,item:variant>>")) for name in NESTED]
        return F.concat(*parts)

    runs = F.flatten(F.transform(_list(value, "$.runs"), lambda r: F.coalesce(_list(r, "$.results"), F.array().cast(_LIST))))
    is_object = F.try_variant_get(value, "$", _OBJECT).isNotNull()
    found = F.when(_list(value).isNotNull(), plain(_list(value))).when(
        is_object, F.coalesce(F.flatten(F.transform(_list(value, "$.Results"), nested)), plain(_list(value, "$.results")), plain(runs), plain(_list(value, "$.Vulnerabilities")), plain(_list(value, "$.components")))
    )
    return with_value.select(*reports.columns, F.posexplode(found).alias("ord", "r")).select(*reports.columns, "ord", "r.target", "r.item")


def failures(reports: DataFrame) -> DataFrame:
    """reports that are neither blank nor JSON with an array or an object at its root."""
    value = parsed(F.col("raw"))
    usable = F.try_variant_get(value, "$", _LIST).isNotNull() | F.try_variant_get(value, "$", _OBJECT).isNotNull()
    return reports.where((F.trim("raw") != "") & ~F.coalesce(usable, F.lit(False)))


def _first(*options: Column) -> Column:
    return F.coalesce(*options)


def _metadata(**values: Column) -> Column:
    known = F.map_filter(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v))), lambda k, v: F.trim(v) != "")
    return F.when(F.size(known) > 0, known)


_COLUMNS = ("rule_id", "message", "path", "line_no", "severity", "metadata")


def _candidate(rows: DataFrame, **given: Column) -> DataFrame:
    kinds = {"line_no": "long", "metadata": "map<string,string>"}
    values = [(given.get(c) if c in given else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in _COLUMNS]
    return rows.select("repo_id", "check", "tool", "ord", "target", "item", *values)


def actionlint(rows: DataFrame) -> DataFrame:
    i = F.col("item")
    either = lambda f, low, high: _first(f(i, f"$.{low}"), f(i, f"$.{high}"))
    return _candidate(rows, rule_id=either(text, "kind", "Kind"), message=either(text, "message", "Message"), path=paths.scanned(either(text, "filepath", "Filepath")), line_no=either(number, "line", "Line"))


def zizmor(rows: DataFrame) -> DataFrame:
    i, at = F.col("item"), "$.locations[0]"
    path = _first(*(text(i, f"{at}.{k}") for k in ("path", "file", "filename")))
    line = _first(*(number(i, f"{at}.{k}") for k in ("line", "start_line", "startLine", "row")))
    return _candidate(rows, rule_id=text(i, "$.ident"), message=text(i, "$.desc"), path=paths.scanned(path), line_no=line, severity=text(i, "$.determinations.severity"))


def sarif(rows: DataFrame) -> DataFrame:
    i, at = F.col("item"), "$.locations[0].physicalLocation"
    return _candidate(rows, rule_id=text(i, "$.ruleId"), message=text(i, "$.message.text"), path=paths.scanned(text(i, f"{at}.artifactLocation.uri")), line_no=number(i, f"{at}.region.startLine"), severity=text(i, "$.level"))


def trivy(rows: DataFrame, manifests: DataFrame) -> DataFrame:
    """Vulnerabilities and misconfigurations; those of dependency checks are placed in a manifest of their repository."""
    i = F.col("item")
    path = _first(paths.scanned(text(i, "$.CauseMetadata.Resource")), paths.scanned(_first(F.col("target"), text(i, "$.Target"))))
    found = _candidate(
        rows, rule_id=_first(*(text(i, f"$.{k}") for k in ("VulnerabilityID", "ID", "AVDID", "RuleID"))), message=_first(*(text(i, f"$.{k}") for k in ("Title", "Message", "Description", "MisconfSummary"))), path=path,
        line_no=number(i, "$.CauseMetadata.StartLine"), severity=text(i, "$.Severity"), metadata=_metadata(packageName=text(i, "$.PkgName"), installedVersion=text(i, "$.InstalledVersion"), fixedVersion=text(i, "$.FixedVersion")),
    )
    return placed(found.withColumn("purl", text(i, "$.PkgIdentifier.PURL")), manifests, F.col("check") == "dependencies.trivy").drop("purl")


def osv(rows: DataFrame) -> DataFrame:
    """One candidate for each vulnerability of a package."""
    i = F.col("item")
    name, version = text(i, "$.packageName"), text(i, "$.version")
    each = rows.select("*", F.explode(_list(i, "$.vulns")).alias("vuln"))
    rule = _first(text(F.col("vuln"), "$.id"), F.lit("OSV"))
    message = F.when(name.isNotNull() & version.isNotNull(), F.concat(name, F.lit("@"), version, F.lit(" is affected by "), rule)).otherwise(F.concat(F.lit("OSV reports "), rule))
    return _candidate(each, rule_id=rule, message=message, path=paths.scanned(text(i, "$.target")), severity=F.lit("medium"), metadata=_metadata(packageName=name, installedVersion=version))


def components(rows: DataFrame) -> DataFrame:
    """repo_id, name, version, purl of a bill of materials; they are no findings."""
    i = F.col("item")
    return rows.select("repo_id", text(i, "$.name").alias("name"), text(i, "$.version").alias("version"), text(i, "$.purl").alias("purl"))


def preferred(manifests: DataFrame) -> DataFrame:
    """repo_id, ecosystem (null: any), manifest: where a repository's findings of an ecosystem are placed.

    Of the ecosystem's names the first that any manifest has, and of those the first path in order.
    """
    name = paths.base(F.col("path"))
    ranks = F.array(*(F.struct(F.lit(e).alias("ecosystem"), F.lit(n).alias("name"), F.lit(k).alias("rank")) for e, names in paths.PREFERRED.items() for k, n in enumerate(names)))
    ranked = manifests.select("repo_id", "path", F.explode(F.filter(ranks, lambda x: x["name"] == name)).alias("x"))
    best = ranked.groupBy("repo_id", "x.ecosystem").agg(F.min_by("path", F.struct("x.rank", "path")).alias("manifest"))
    return best.unionByName(manifests.groupBy("repo_id").agg(F.min("path").alias("manifest")).withColumn("ecosystem", F.lit(None).cast("string")))


def placed(found: DataFrame, manifests: DataFrame, applies: Column) -> DataFrame:
    """found (repo_id, path, purl), with path a manifest where `applies`: the path if it is one, else the ecosystem's preferred."""
    own = manifests.select("repo_id", F.col("path").alias("own"))
    known = F.when(paths.ecosystem(F.col("purl")).isin(*paths.PREFERRED), paths.ecosystem(F.col("purl")))
    place = preferred(manifests).select(F.col("repo_id").alias("at_repo"), F.col("ecosystem").alias("at_ecosystem"), "manifest")
    rows = found.withColumn("known", known).join(own, (own["repo_id"] == found["repo_id"]) & (own["own"] == found["path"]), "left").drop(own["repo_id"])
    rows = rows.join(place, (F.col("repo_id") == F.col("at_repo")) & F.col("known").eqNullSafe(F.col("at_ecosystem")), "left")
    return rows.withColumn("path", F.when(~applies, F.col("path")).otherwise(F.coalesce("own", "manifest"))).select(*found.columns)
