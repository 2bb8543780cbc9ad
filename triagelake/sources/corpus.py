"""The corpus as files of repositories, the limits of a snapshot, and its hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

#: Directories that are never scanned.
IGNORED = (".git", "node_modules", "dist", "build", ".next", "out", "target", "vendor", ".venv", "venv", "__pycache__", ".cache", "coverage", "logs")
#: Bytes of a file, files of a repository and bytes of a repository at most.
FILE_BYTES, FILES, REPO_BYTES = 5 << 20, 50_000, 500 << 20
EXTENSIONS = ("py", "ts", "java", "md", "sol", "json", "yml")
#: Limits for documents taken as files, which are small: with these some repositories overflow.
MAX_FILE, MAX_REPO = 20_000, 200_000


def path_of(doc_id: Column, lang: Column) -> Column:
    """Documents as files: a directory for the language, one in eleven under vendor, the extension by id."""
    extension = F.element_at(F.array(*(F.lit(e) for e in EXTENSIONS)), (doc_id % len(EXTENSIONS) + 1).cast("int"))
    top = F.when(doc_id % 11 == 3, F.concat(F.lit("vendor/"), lang)).otherwise(lang)
    return F.concat(top, F.lit("/file"), doc_id.cast("string"), F.lit("."), extension)


def files(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """repo_id, path, size, sha256 (and named columns of documents): one row a file, no driver-side walk."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("source").alias("repo_id"), path_of(F.col("doc_id"), F.col("lang")).alias("path"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"), *extra)


def snapshot_hash(corpus: DataFrame) -> DataFrame:
    """repo_id, n_files, source_hash over path, hash and size in path order.

    The hash reads its lines one after another, so a repository's are one row: FILES lines at most where
    corpus is what limits left, which is how it should be called.
    """
    line = F.concat("path", F.lit("\0"), "sha256", F.lit("\0"), F.col("size").cast("string"), F.lit("\n"))
    lines = F.array_sort(F.collect_list(F.struct("path", line.alias("line"))))
    return corpus.groupBy("repo_id").agg(F.count("*").alias("n_files"), F.sha2(F.array_join(F.transform(lines, lambda x: x["line"]), ""), 256).alias("source_hash"))


def running(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """rows with total (of value, up to the row) and nth (its place), for each group in the order of a column.

    Rows are range-partitioned by (group, order), so that a group of any size spans partitions; each part adds
    up alone, and what parts hand on is one row for each part and group.
    """
    ranged = written(rows.repartitionByRange(group, order).withColumn("part", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy("part", group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy("part", group).agg(F.sum(value).alias("sum"), F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", group, F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("sum_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"))
    local = ranged.withColumns({"total": F.sum(value).over(inside), "nth": F.count("*").over(inside)})
    joined = local.join(sums, ["part", group])
    return joined.select(*rows.columns, (F.col("total") + F.col("sum_before")).alias("total"), (F.col("nth") + F.col("n_before")).alias("nth"))


def numbered(rows: DataFrame, group: str, order: str) -> DataFrame:
    """rows without group and order, two columns, and with nth, their place in their group in the order of the other.

    Rows are written once, in ranges of (group, order) and sorted, and read back with their places in the files: they
    are shuffled once. What is added up are the groups of each file, one row for each.
    """
    kept = [c for c in rows.columns if c != order]
    sorted_ = written(rows.repartitionByRange(group, order).sortWithinPartitions(group, order).select(*kept, F.spark_partition_id().alias("part")), "numbered")
    placed = sorted_.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    starts = placed.groupBy("part", "file", group).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    # written, so that a join sees how small they are
    starts = written(starts.select("part", "file", group, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before")), "starts")
    return placed.join(starts, ["part", "file", group]).select(*(c for c in kept if c != group), (F.col("at") - F.col("first") + F.col("n_before") + 1).alias("nth"))


def limited(corpus: DataFrame, file_bytes: int = FILE_BYTES, files: int = FILES, repo_bytes: int = REPO_BYTES) -> DataFrame:
    """repo_id, path, reason of what a snapshot leaves out: builtin-ignore, too_large, truncated.

    Files fill the budget in path order; one that does not fit leaves its room to later, smaller ones. All
    files before the first that does not fit are settled by running totals; of what comes after it, only
    files that fit into the room that is left are looked at again, by running totals once more.
    """
    directories = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    ignored = F.arrays_overlap(directories, F.array(*(F.lit(x) for x in IGNORED)))
    rows = corpus.select("repo_id", "path", "size").withColumn("reason", F.when(ignored, "builtin-ignore").when(F.col("size") > file_bytes, "too_large"))
    inside = written(rows.where("reason IS NULL").drop("reason"), "inside")
    room = inside.groupBy("repo_id").agg(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("had"))
    cut, left = [], inside
    while True:
        ordered = written(running(left, "repo_id", "path", "size").join(room, "repo_id"), "ordered")
        over = (F.col("used") + F.col("total") > repo_bytes) | (F.col("had") + F.col("nth") > files)
        first = ordered.where(over).groupBy("repo_id").agg(F.min("path").alias("first"))
        first = written(first, "first-cut")
        if first.isEmpty():
            break
        behind = ordered.join(first, "repo_id").where("path >= first")
        kept = ordered.join(first, "repo_id").where("path < first").groupBy("repo_id").agg(F.max("total").alias("more"), F.max("nth").alias("nths"))
        room = room.join(first.select("repo_id"), "repo_id").join(kept, "repo_id", "left")
        room = written(room.select("repo_id", (F.col("used") + F.coalesce("more", F.lit(0))).alias("used"), (F.col("had") + F.coalesce("nths", F.lit(0))).alias("had")), "room")
        judged = behind.select("repo_id", "path", "size", "first").join(room, "repo_id")
        fits = (F.col("used") + F.col("size") <= repo_bytes) & (F.col("had") < files) & (F.col("path") > F.col("first"))
        judged = written(judged.withColumn("fits", fits), "judged")
        cut.append(judged.where("NOT fits"))
        left = judged.where("fits").select("repo_id", "path", "size")
    out = rows.where("reason IS NOT NULL").select("repo_id", "path", "reason")
    for more in cut:
        out = out.unionByName(more.select("repo_id", "path", F.lit("truncated").alias("reason")))
    return out


def exclusions(corpus: DataFrame) -> DataFrame:
    """The same with the limits for documents as files."""
    return limited(corpus, MAX_FILE, FILES, MAX_REPO).replace("builtin-ignore", "ignored_directory", "reason")


def kept(corpus: DataFrame, **limits: int) -> DataFrame:
    """The files that a snapshot holds."""
    return corpus.join(limited(corpus, **limits), ["repo_id", "path"], "left_anti")


def manifest_summary(corpus: DataFrame, **limits: int) -> DataFrame:
    """repo_id, n_files and bytes of the files kept, n_exclusions."""
    flagged = corpus.join(limited(corpus, **limits), ["repo_id", "path"], "left")
    out = F.col("reason").isNotNull()
    return flagged.groupBy("repo_id").agg(F.count_if(~out).alias("n_files"), F.coalesce(F.sum(F.when(~out, F.col("size"))), F.lit(0)).alias("bytes"), F.count_if(out).alias("n_exclusions"))


def running_total(corpus: DataFrame) -> DataFrame:
    """repo_id, path, used: bytes up to each file in path order."""
    return running(corpus.select("repo_id", "path", "size"), "repo_id", "path", "size").select("repo_id", "path", F.col("total").alias("used"))
