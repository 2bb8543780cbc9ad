"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode a folder in /tmp where that is unset."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if known is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        known = "/tmp/triagelake-checkpoints"
    return known


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Where a session's shared tables lie: of each name and folder the latest, with the files that it was built from.
_KEPT: dict[tuple[str, str, str], tuple[str, str, object]] = {}


def state(spark: SparkSession, sf_dir: str) -> str:
    """A hash of the names, lengths and times of a folder's Parquet files; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(sf_dir)
    row = F.concat_ws("|", "path", "length", F.unix_micros("modificationTime"))
    # an exact set hash: sums of independent 64-bit hashes do not depend on the order of files
    seen = files.select(F.xxhash64(row).alias("a"), F.xxhash64(row, F.lit(1)).alias("b")).agg(F.count("*"), F.sum(F.col("a").cast("decimal(20,0)")), F.sum(F.col("b").cast("decimal(20,0)"))).first()
    return "|".join(map(str, seen))


def once(spark: SparkSession, name: str, sf_dir: str, build) -> DataFrame:
    """What build() gives for a folder of tables, written by the first query of an application that asks and read by the others.

    It is built again where the folder's files have changed since or the written table is gone.
    """
    key, now = (spark.sparkContext.applicationId, name, sf_dir), state(spark, sf_dir)
    if key in _KEPT:
        then, path, schema = _KEPT[key]
        try:
            if then == now:
                spark.read.parquet(path)
                return spark.read.schema(schema).parquet(path)
        except AnalysisException:
            pass
        del _KEPT[key]
    df = build()
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _KEPT[key] = (now, path, df.schema)
    return spark.read.schema(df.schema).parquet(path)
