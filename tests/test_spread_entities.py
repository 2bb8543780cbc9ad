"""Entities are spread over tasks, however few row groups their tables have."""

from pyspark.sql import functions as F

from triagelake.sources import programs

DATA = "/root/testdata/sf0.01"


def test_entities_of_one_row_group_are_in_all_parts(spark):
    rows = programs.entities(spark, DATA)
    sizes = [r["n"] for r in rows.groupBy(F.col("_metadata.file_path")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 2 * min(sizes)
    assert sum(sizes) == spark.read.parquet(f"{DATA}/customer.parquet").count()
