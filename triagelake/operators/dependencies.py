"""Dependencies: of manifests, of package graphs in reports, their advisories, evidence and usages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions import paths
from triagelake.sources import reports as rp
from triagelake.sources.shared import written

#: Scopes of a package.json.
SCOPES = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")
EXACT = r"^\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.-]+)?$"
#: Manifests of package graphs, a smaller set than all manifests.
GRAPH_MANIFESTS = r"(?i)(^|/)(package(-lock)?\.json|pnpm-lock\.yaml|yarn\.lock|pom\.xml|build\.gradle|build\.gradle\.kts|go\.(mod|sum)|requirements\.txt|poetry\.lock|Pipfile\.lock|pyproject\.toml)$"


def npm_dependencies(files: DataFrame) -> DataFrame:
    """repo_id, path, name, version, scope: exact versions in package.json files (repo_id, path, text), the first scope of each."""
    rows = files.where(paths.base(F.col("path")) == "package.json").where(~F.arrays_overlap(F.split("path", "/"), F.array(*(F.lit(x) for x in (".git", "node_modules", "dist")))))
    value = F.try_parse_json("text")
    scopes = F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(s).alias("scope"), F.map_entries(F.try_variant_get(value, f"$.{s}", "map<string,variant>")).alias("all")) for k, s in enumerate(SCOPES)))
    each = rows.select("repo_id", "path", F.explode(scopes).alias("s")).select("repo_id", "path", "s.ord", "s.scope", F.explode("s.all").alias("e"))
    raw = rp.text(F.col("e.value"), "$")
    alias = F.regexp_extract(raw, "^npm:[^@]+@(.+)$", 1)
    exact = each.select("repo_id", "path", "ord", "scope", F.col("e.key").alias("name"), F.trim(F.when(alias != "", alias).otherwise(raw)).alias("version")).where(F.col("version").rlike(EXACT))
    return exact.groupBy("repo_id", "path", "name", "version").agg(F.min_by("scope", "ord").alias("scope"))


def advised(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies (name, version) that an advisory (ecosystem, name, version, advisory_id) of npm names."""
    return dependencies.join(advisories.where("ecosystem = 'npm'").select("name", "version", "advisory_id"), ["name", "version"])


def package_name(identifier: Column) -> Column:
    """The part before the last @ of a package's id, if that is not at its start."""
    before = F.regexp_extract(identifier, "^(.+)@[^@]*$", 1)
    return F.when(before != "", before).when(F.trim(identifier) != "", identifier)


def package_graph(reports: DataFrame, manifests: DataFrame) -> DataFrame:
    """repo_id, manifest, source_name, name, version, relationship: who depends on whom, each key once, the first report's.

    reports are (repo_id, report_id, raw). A result without edges lists its packages under its target instead.
    Reports are parsed once, into written packages, and of a key that comes often each task shuffles one row.
    """
    value = rp.parsed(F.col("raw"))
    results = reports.select("repo_id", "report_id", F.posexplode(F.try_variant_get(value, "$.Results", "array<variant>")).alias("at", "result"))
    packages = results.select("repo_id", "report_id", "at", rp.text(F.col("result"), "$.Target").alias("raw_target"), F.posexplode(F.try_variant_get("result", "$.Packages", "array<variant>")).alias("nth", "package"))
    p = F.col("package")
    target = F.regexp_replace(F.regexp_replace(F.replace("raw_target", F.lit("\\"), F.lit("/")), "^/work/source/", ""), r"^\./", "")
    identifier = rp.text(p, "$.ID")
    packages = packages.select(
        "repo_id", "report_id", "at", "nth", F.when(~target.rlike(r"^$|^\.\./|^/"), target).alias("target"), identifier.alias("id"), F.coalesce(rp.text(p, "$.Name"), package_name(identifier)).alias("package_name"), rp.text(p, "$.Name").alias("own_name"),
        rp.text(p, "$.Version").alias("package_version"), rp.text(p, "$.Relationship").alias("relationship"), F.coalesce(rp.text(p, "$.Identifier.PURL"), rp.text(p, "$.PkgIdentifier.PURL")).alias("purl"), F.try_variant_get(p, "$.DependsOn", "array<string>").alias("depends"),
    )
    packages = written(packages, "report-packages")
    first_purl = packages.groupBy("repo_id", "report_id", "at").agg(F.min_by("purl", F.when(F.col("purl").isNotNull(), F.col("nth"))).alias("purl"), F.first("target").alias("path"))
    where = rp.placed(first_purl, manifests.where(F.col("path").rlike(GRAPH_MANIFESTS)), F.lit(True)).where("path IS NOT NULL").select("repo_id", "report_id", "at", F.col("path").alias("manifest"))
    packages = packages.join(where, ["repo_id", "report_id", "at"])
    by_id = packages.where("id IS NOT NULL").groupBy("repo_id", "report_id", "at", F.col("id").alias("dependency")).agg(F.max_by(F.struct("package_name", "package_version"), "nth").alias("known"))
    edges = packages.where("package_name IS NOT NULL").select("*", F.posexplode("depends").alias("edge", "dependency")).join(by_id, ["repo_id", "report_id", "at", "dependency"], "left")
    edges = edges.withColumn("name", F.coalesce("known.package_name", package_name(F.col("dependency")))).where("name IS NOT NULL")
    key = ["repo_id", "report_id", "at"]
    graph = edges.select(*key, "nth", "edge", "manifest", F.col("package_name").alias("source_name"), "name", F.col("known.package_version").alias("version"), "relationship")
    listed = packages.where("package_name IS NOT NULL").join(edges.select(*key).distinct(), key, "left_anti")
    listed = listed.select(*key, "nth", F.lit(0).alias("edge"), "manifest", F.coalesce("target", "manifest").alias("source_name"), F.col("package_name").alias("name"), F.col("package_version").alias("version"), F.coalesce("relationship", F.lit("package_manifest")).alias("relationship"))
    unique = ["repo_id", "manifest", "source_name", "name", F.coalesce("relationship", F.lit("")).alias("related")]
    first = F.min_by(F.struct("version", "relationship"), F.struct("report_id", "at", "nth", "edge"))
    return graph.unionByName(listed).groupBy(*unique).agg(first.alias("first")).select("repo_id", "manifest", "source_name", "name", "first.version", "first.relationship")


def suffixes(name: Column) -> Column:
    """A name without its first k segments, for every k above 0."""
    parts = F.split(name, "/")
    return F.transform(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda k: k < F.size(parts)), lambda k: F.array_join(F.slice(parts, k + 1, F.size(parts)), "/"))


def same_package(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (repo_id, left_name, right_name) of equal names, or of which one ends with / and the other.

    Three equi-joins; the suffix of one is never held against a suffix of the other.
    """
    left, right = left.select("repo_id", "left_name").distinct(), right.select("repo_id", "right_name").distinct()
    equal = left.join(right, (left["repo_id"] == right["repo_id"]) & (F.col("left_name") == F.col("right_name"))).select(left["repo_id"], "left_name", "right_name")
    longer = left.select("repo_id", "left_name", F.explode(suffixes(F.col("left_name"))).alias("key"))
    one = longer.join(right, (longer["repo_id"] == right["repo_id"]) & (longer["key"] == right["right_name"])).select(longer["repo_id"], "left_name", "right_name")
    other = right.select("repo_id", "right_name", F.explode(suffixes(F.col("right_name"))).alias("key"))
    two = left.join(other, (left["repo_id"] == other["repo_id"]) & (left["left_name"] == other["key"])).select(left["repo_id"], "left_name", "right_name")
    return equal.unionByName(one).unionByName(two).distinct()


def evidence_for(packages: DataFrame, evidence: DataFrame) -> DataFrame:
    """repo_id, name, evidence_ids of packages (repo_id, name): of the equal package, else of the first by order that matches by suffix, of equal orders the shortest name.

    evidence is (repo_id, ord, package_name, evidence_ids), one row for each package name.
    """
    pairs = same_package(packages.withColumnRenamed("name", "left_name"), evidence.withColumnRenamed("package_name", "right_name"))
    known = pairs.join(evidence.select("repo_id", F.col("package_name").alias("right_name"), "ord", "evidence_ids"), ["repo_id", "right_name"]).where(F.size("evidence_ids") > 0)
    best = known.groupBy("repo_id", F.col("left_name").alias("name")).agg(F.min_by("evidence_ids", F.struct(F.col("left_name") != F.col("right_name"), "ord", F.length("right_name"), "right_name")).alias("evidence_ids"))
    return packages.select("repo_id", "name").distinct().join(best, ["repo_id", "name"], "left")
