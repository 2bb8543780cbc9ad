"""Exact dense ranking of rows by a key, over all partitions, with no hot or single task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, written


def _same_as_before(column: pa.Array) -> np.ndarray:
    """For each row but the first: whether it equals the row before (nulls are equal)."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    same = pc.fill_null(pc.equal(a, b), False)
    nulls = pc.and_(pc.is_null(a), pc.is_null(b))
    return np.asarray(pc.or_(same, nulls))


def with_names(df: DataFrame, keys: list[str], tie: str, label: str, short: list[str] | None = None) -> DataFrame:
    """df without `keys`, with `name`: the dense rank, from 0, of its key tuple in sorted order.

    The rows are range-partitioned and sorted by (keys, tie): a key that holds many rows spans as many
    partitions as it needs, for `tie` splits it. Range partitioning samples keys on the driver, so long keys
    have `short` columns, digests of theirs, for it; rows are sorted by those, then by the keys themselves. Each sorted partition numbers its keys in one streaming
    pass; the last key of one partition and the first of the next are compared, so a key that spans
    partitions keeps one name. What is compared is one row per partition.
    """
    short = short or []
    rest = [f for f in df.schema.fields if f.name not in (*keys, *short)]
    edge = [T.StructField(f"{side}_{k}", df.schema[k].dataType) for side in ("first", "last") for k in keys]
    schema = T.StructType([*rest, T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType()), T.StructField("names", T.LongType()), *edge])
    names = [f.name for f in rest]

    def number(batches):
        part, count, last, first, arrow = TaskContext.get().partitionId(), 0, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            arrow = batch.schema
            columns = [batch.column(arrow.get_field_index(k)) for k in keys]
            new = np.ones(batch.num_rows, bool)
            new[1:] = ~np.logical_and.reduce([_same_as_before(c) for c in columns])
            head = [c[0].as_py() for c in columns]
            new[0] = head != last
            first = head if first is None else first
            local = count + np.cumsum(new) - 1
            count, last = int(local[-1]) + 1, [c[-1].as_py() for c in columns]
            blank = [pa.nulls(batch.num_rows, arrow.field(k).type) for _ in (0, 1) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(arrow.get_field_index(n)) for n in names), pa.array(np.full(batch.num_rows, part), pa.int32()), pa.array(local, pa.int64()), pa.nulls(batch.num_rows, pa.int64()), *blank],
                names=schema.names,
            )
        if arrow is not None:  # the row that describes the partition
            values = dict(zip([f.name for f in edge], [*first, *last], strict=True))
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(1, arrow.field(n).type) for n in names), pa.array([part], pa.int32()), pa.nulls(1, pa.int64()), pa.array([count], pa.int64()), *(pa.array([values[f.name]], arrow.field(f.name.split("_", 1)[1]).type) for f in edge)],
                names=schema.names,
            )

    ranged = df.repartitionByRange(*(short or keys), tie).sortWithinPartitions(*short, *keys, tie)
    numbered = written(in_batches(ranged.drop(*short), number, schema), label)
    order = Window.orderBy("part")
    joins_on = F.lit(True)
    for k in keys:
        joins_on = joins_on & F.lag(f"last_{k}").over(order).eqNullSafe(F.col(f"first_{k}"))
    offsets = (
        numbered.where("local IS NULL")
        .withColumn("shared", F.when(F.lag("part").over(order).isNotNull() & joins_on, 1).otherwise(0))
        .withColumn("offset", F.sum(F.col("names") - F.col("shared")).over(order) - F.col("names"))
        .select("part", "offset")
    )
    return numbered.where("local IS NOT NULL").join(F.broadcast(offsets), "part").select(*names, (F.col("local") + F.col("offset")).alias("name"))
