"""Tables that results are written to and read from: artifacts, graphs, histories, coverage, reports, expectations.

Graphs, coverage and histories are tables of versions. A writer first writes all its rows as a new version,
then one small file of commits that names it, last. Readers take only what a commit names, so they never see
half a write; a job that dies before its commit has changed nothing, and one that is run again, or beside
another, leaves no row twice. A graph or run that is replaced by nothing is gone: its commit names a version
without rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Tables of a graph, and the version that expectation files must have.
GRAPH_TABLES, VERSION = ("graphs", "nodes", "edges", "flows", "coverage"), 1
EXPECTATIONS = "version int, repositories array<struct<id string, match struct<originUrl string, localPathSuffix string>, minFindings long>>"


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table, or an empty one where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # Spark names a missing path by its condition alone
        if getattr(e, "getCondition", lambda: "")() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


COMMITS = "scope string, version string, number long"


def _commit(spark: SparkSession, path: str, scopes: DataFrame, version: str) -> None:
    """Names version as what each scope (a graph, a run) holds from now on; one file, which appears whole or not at all."""
    last = _read(spark, f"{path}/commits", COMMITS).agg(F.max("number")).first()[0] or 0
    scopes.select(F.col("scope").cast("string").alias("scope"), F.lit(version).alias("version"), F.lit(last + 1).cast("long").alias("number")).distinct().coalesce(1).write.mode("append").parquet(f"{path}/commits")


def _live(spark: SparkSession, path: str) -> DataFrame:
    """scope, version: the last commit of each scope; of two at once, the one with the larger version name."""
    commits = _read(spark, f"{path}/commits", COMMITS)
    return commits.groupBy("scope").agg(F.max_by("version", F.struct("number", "version")).alias("version"))


def _spread(rows: DataFrame, scope: str) -> DataFrame:
    """Sorted by scope over the files, so that readers of few scopes skip the others; a scope of any size is cut into many files."""
    return rows.repartitionByRange(scope, F.xxhash64(*rows.columns)).sortWithinPartitions(scope)


def replace(tables: dict[str, DataFrame], path: str, scope: str, scopes: DataFrame | None = None) -> None:
    """Writes the rows of tables in place of all that their scopes had, in all tables at once.

    scopes (one column) names what is replaced; without it, whatever has rows. A scope without rows is emptied.
    """
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, rows in tables.items():
        _spread(rows, scope).write.parquet(f"{path}/{name}/version={version}")
    if scopes is None:
        written = (spark.read.parquet(f"{path}/{name}/version={version}").select(F.col(scope).alias("scope")) for name in tables)
        named = next(written)
        for more in written:
            named = named.unionByName(more)
    else:
        named = scopes.toDF("scope")
    _commit(spark, path, named, version)


def current(spark: SparkSession, path: str, name: str, scope: str, *of: str) -> DataFrame:
    """The rows of a table that commits name, of all scopes or of the given ones. Versions that nothing names are not read."""
    rows, live = spark.read.parquet(f"{path}/{name}"), _live(spark, path)
    if of:
        rows, live = rows.where(F.col(scope).isin(*of)), live.where(F.col("scope").isin(*of))
    return rows.join(live.withColumnsRenamed({"scope": "live_scope", "version": "live_version"}), (F.col(scope).cast("string") == F.col("live_scope")) & (F.col("version") == F.col("live_version")), "left_semi").drop("version")


ARTIFACTS = "sha256 string, bytes long, content binary, prefix string"


def store_artifacts(contents: DataFrame, path: str) -> DataFrame:
    """sha256, bytes, location of contents (content binary); each content is written under the first two digits of its hash.

    Equal contents are told by their hashes alone before the contents themselves move. Writers at the same
    time may write one content twice; artifacts() gives it once.
    """
    spark = contents.sparkSession
    hashed = contents.where("content IS NOT NULL").select(F.sha2("content", 256).alias("sha256"), "content")
    first = hashed.select("sha256").distinct()
    new = first.join(_read(spark, path, ARTIFACTS).select("sha256").distinct(), "sha256", "left_anti")
    rows = hashed.join(new, "sha256", "left_semi").groupBy("sha256").agg(F.first("content").alias("content"))
    rows = rows.select("sha256", F.octet_length("content").cast("long").alias("bytes"), "content", F.substring("sha256", 1, 2).alias("prefix"))
    rows.write.mode("append").partitionBy("prefix").parquet(path)
    return hashed.groupBy("sha256").agg(F.max(F.octet_length("content")).cast("long").alias("bytes")).select("sha256", "bytes", F.concat(F.lit("blobs/sha256/"), F.substring("sha256", 1, 2), F.lit("/"), "sha256").alias("location"))


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """sha256, bytes, content, each once."""
    return _read(spark, path, ARTIFACTS).groupBy("sha256").agg(F.first("bytes").alias("bytes"), F.first("content").alias("content"))


def replace_graphs(tables: dict[str, DataFrame], path: str, graphs: DataFrame | None = None) -> None:
    """Writes the graphs of tables (each with graph_id) in all tables at once; their old rows go, those of other graphs stay.

    graphs (one column) names what is replaced, graphs without rows included; without it, whatever has rows.
    """
    replace(tables, path, "graph_id", graphs)


def graph_table(spark: SparkSession, path: str, name: str, *graphs: str) -> DataFrame:
    """A table of the named graphs, of all without a name."""
    return current(spark, path, name, "graph_id", *graphs)


def append_history(attempts: DataFrame, path: str, key: tuple[str, ...] = ("run_id", "stage", "attempt")) -> None:
    """Adds attempts whose key the table does not have; the first of equal keys is kept."""
    spark = attempts.sparkSession
    known = history(spark, path, attempts.schema, key).select(*key)
    version = uuid.uuid4().hex
    attempts.dropDuplicates(list(key)).join(known, list(key), "left_anti").select(*attempts.columns).write.parquet(f"{path}/attempts/version={version}")
    _commit(spark, path, spark.createDataFrame([(version,)], "scope string"), version)


def history(spark: SparkSession, path: str, schema, key: tuple[str, ...] = ("run_id", "stage", "attempt")) -> DataFrame:
    """The attempts of all commits; of equal keys that writers added at the same time, the one of the first commit."""
    rows = _read(spark, f"{path}/attempts", StructType([*schema.fields, StructField("version", StringType())]))
    rows = rows.join(_read(spark, f"{path}/commits", COMMITS).select("version", "number"), "version")
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*schema.names), F.struct("number", "version")).alias("row"))
    return first.select("row.*")


def replace_coverage(rows: DataFrame, path: str, runs: DataFrame | None = None) -> None:
    """Writes coverage (run_id, area, producer, ...) in place of what the same runs had; runs as graphs in replace_graphs."""
    replace({"coverage": rows}, path, "run_id", runs)


def coverage_of(spark: SparkSession, path: str, *runs: str) -> DataFrame:
    out = current(spark, path, "coverage", "run_id", *runs)
    return out.orderBy("area", "producer") if runs else out


#: Folders that the records of a run are dealt to, by a hash of their repository.
BUCKETS = 16


def write_assessments(assessments: DataFrame, path: str, run: str) -> None:
    """One JSON record for each repository (repo_id, ...), one a line; what the same run had goes, other runs stay."""
    rows = assessments.withColumns({"run": F.lit(run), "bucket": F.pmod(F.xxhash64("repo_id"), F.lit(BUCKETS))})
    rows.repartition(BUCKETS, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "bucket").json(path)


def read_assessments(spark: SparkSession, path: str, schema: str, run: str) -> DataFrame:
    """The records of a run; folders of other runs are not read."""
    return spark.read.schema(schema + ", run string, bucket long").json(path).where(F.col("run") == run).drop("run", "bucket")


def expectations(spark: SparkSession, path: str) -> DataFrame:
    """file, id, origin_url, local_path, min_findings and error: the repositories of expectation files, or why a file has none."""
    files = spark.read.option("multiLine", True).schema(EXPECTATIONS).json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return checked_expectations(files)


def checked_expectations(files: DataFrame) -> DataFrame:
    """The same of parsed files (file, version, repositories)."""
    error = F.when(~F.col("version").eqNullSafe(VERSION), F.concat(F.lit("unsupported version "), F.coalesce(F.col("version").cast("string"), F.lit("none")))).when(F.col("repositories").isNull(), "repositories is not a list")
    rows = files.withColumn("error", error)
    good = rows.where("error IS NULL").select("file", F.explode("repositories").alias("r"), "error")
    good = good.select("file", "r.id", F.col("r.match.originUrl").alias("origin_url"), F.col("r.match.localPathSuffix").alias("local_path"), F.col("r.minFindings").alias("min_findings"), "error")
    none = F.lit(None).cast("string")
    return good.unionByName(rows.where("error IS NOT NULL").select("file", none.alias("id"), none.alias("origin_url"), none.alias("local_path"), F.lit(None).cast("long").alias("min_findings"), "error"))


def challenges(texts: DataFrame) -> DataFrame:
    """file, nth, key, name, category, complete of texts (file, text): blocks that begin with a line of one dash."""
    block = F.posexplode(F.split(F.regexp_replace("text", r"^-[ \t]*\n", ""), r"\n-[ \t]*\n"))
    rows = texts.select("file", block.alias("nth", "block"))
    field = lambda name: F.nullif(F.regexp_replace(F.regexp_extract("block", rf"(?m)^\s*{name}\s*:\s*(.+?)\s*$", 1), "^[\"']|[\"']$", ""), F.lit(""))
    out = rows.where(F.trim("block") != "").select("file", "nth", field("key").alias("key"), field("name").alias("name"), field("category").alias("category"))
    return out.withColumn("complete", F.col("key").isNotNull() & F.col("name").isNotNull() & F.col("category").isNotNull())


def write_ordered(rows: DataFrame, path: str, *order) -> None:
    """Parquet files that hold rows in one order: within each file, and over the files by their names.

    order: columns or names. Rows are cut into ranges by samples, so no task sorts more than its range.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    rows.repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(path)


def graph_order(name: str) -> list:
    """How a graph's table is read by people and compared: by id, coverage by `area:producer`."""
    return ["graph_id", F.concat("area", F.lit(":"), "producer")] if name == "coverage" else ["graph_id", {"nodes": "node_id", "edges": "edge_id", "flows": "flow_id"}[name]]


def group_order() -> list:
    """Action groups: the highest score first, then those led by a finding, then by remediation key and id."""
    return ["graph_id", F.desc("score"), F.desc(F.col("lead") == "direct_finding"), "remediation_key", "group_id"]
