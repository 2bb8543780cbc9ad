"""What several operators share: the shared scratch folder, Arrow text access, word hashes."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII characters; bytes.split() cuts at the same ones.
SPACES = r"[\x20\x09-\x0D]+"
#: A word-hash cache is emptied when it holds this many words.
CACHE_WORDS = 200_000
#: A writer holds a row group in memory; texts need no larger ones than this.
ROW_GROUP_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; set here only where it is unset."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    known = spark.sparkContext.getCheckpointDir()
    if known is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("/tmp/triagelake-checkpoints")
        known = spark.sparkContext.getCheckpointDir()
    return known


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read back.

    This cuts the lineage, fixes values that a second run might give otherwise (row ids, partition
    numbers) and outlives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows handed to a Python worker at once: a table of long texts is cut into smaller batches.
BATCH_BYTES = "8m"


def in_batches(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow over batches bounded by bytes as well as by rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(function, schema)


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def each_text(column: pa.Array, rows: int = 256):
    """The same, one by one; the bytes of so many rows are held at a time."""
    for at in range(0, len(column), rows):
        yield from texts(column.slice(at, rows))


def lower_ascii(text: bytes) -> bytes:
    return text.lower()  # bytes.lower() changes A-Z alone


class WordHashes(dict):
    """xxh64 of each word, kept for words seen before."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finalizer (splitmix64), elementwise."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Windows:
    """Polynomial hashes of every run of `width` consecutive word hashes."""

    def __init__(self, width: int, base: int = 0x2545F4914F6CDD1D):
        self.width, self.base = width, base | 1
        self.inverse = pow(self.base, -1, 2**64)
        self._grow(4096)

    def _grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(n, self.base, np.uint64))
            self.back = np.cumprod(np.full(n, self.inverse, np.uint64))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Empty if there are fewer words than the width."""
        n = len(hashes)
        if n < self.width:
            return np.empty(0, np.uint64)
        if n > len(self.power):
            self._grow(2 * n)
        with np.errstate(over="ignore"):
            total = np.cumsum(hashes * self.power[:n], dtype=np.uint64)
            part = total[self.width - 1 :].copy()
            part[1:] -= total[: n - self.width]
            return mix(part * self.back[: n - self.width + 1])


def longs(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as Spark's longs."""
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def own(id_col: Column, modulus: int = 3) -> Column:
    """crc32 of an id's decimal text, modulo."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def held_out(id_col: Column) -> Column:
    """The fold no learner sees: crc32(id as text) mod 3 is 1. A null id is not held out."""
    return F.coalesce(own(id_col) == 1, F.lit(False))


#: Ids are broadcast up to so many (8 bytes each) and joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000


def bounded(rows: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A written table of ids or other short rows, marked for broadcast if it has `most` rows at most."""
    return F.broadcast(rows) if rows.count() <= most else rows
