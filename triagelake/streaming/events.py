"""Counts of events for each window and type, over a stream of files; late events count until the watermark passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """since, event_type, n, total of events (ts, event_type, value), a stream or a table. State is one row for each open window and type."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return counts.select(F.col("window.start").alias("since"), "event_type", "n", "cents")


def arrived(spark: SparkSession, path: str, out: str) -> DataFrame:
    """What all files under path hold now: the stream runs until it has read them, and leaves its counts under out.

    Run again with the same folder it goes on where it stopped.
    """
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may name one file or a folder of them
    counts = windowed(stream)
    query = counts.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{out}/checkpoint").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{out}/counts")).start()
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{out}/counts")
