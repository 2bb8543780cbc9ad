"""Exact de-duplication by deterministic block naming.

A text is cut into fixed-size blocks. All blocks are sorted and each distinct one is named by its integer
rank; then neighbouring names are paired, the pairs are sorted and named in turn, until one name is left
for each document. Two documents that end in the same round with the same name have the same text: ranks
are given to contents, not to hashes, so nothing can collide.

Only the first round moves text (once, partitioned by digests of its blocks and sorted by the blocks). A round moves two integers for each pair, half as many as before.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, each_text, in_batches, written
from .dense_names import with_names

BLOCK_BYTES = 1024
#: Groups of equal texts (five integers each) are broadcast up to so many and joined by a shuffle beyond.
BROADCAST_GROUPS = 200_000
_SPACE = frozenset(b" \t\n\r\x0b\x0c")


def normalised(text: bytes) -> bytes:
    """Each run of ASCII white space becomes one space; a run at either end stays as one space."""
    words = text.split()
    if not words:
        return b" " if text else b""
    return (b" " if text[0] in _SPACE else b"") + b" ".join(words) + (b" " if text[-1] in _SPACE else b"")


def _blocks(size: int):
    def cut(batches):
        for batch in batches:
            rows, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [], [])
            held = 0
            for row, doc, text in zip(rows, ids, each_text(batch.column(2)), strict=True):
                text = normalised(text)
                n = max(1, -(-len(text) // size))
                digest = hashlib.sha256(text).hexdigest()
                for k in range(n):
                    for column, value in zip(out, (row, doc if k == 0 else None, digest if k == 0 else None, n, k, text[k * size : (k + 1) * size]), strict=True):
                        column.append(value)
                held += len(text)
                if held > 4_000_000:
                    yield _batch(out)
                    out, held = ([], [], [], [], [], []), 0
            yield _batch(out)

    return cut


def _batch(columns) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["row", "doc_id", "sha", "n", "pos", "block"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Of equal texts the row with the smallest id stays. Null texts count as empty, and empty texts equal
    each other. A row without an id is a row like others but loses to any row that has one; of rows that
    repeat the smallest id exactly one is kept. Other columns, whatever their names, are not looked at. An
    empty table gives an empty result.
    """
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = in_batches(source, _blocks(block_bytes), "row long, doc_id long, sha string, n long, pos long, block binary")
    blocks = written(blocks.withColumns({"one": F.xxhash64("block"), "two": F.xxhash64(F.lit(1), "block")}), "blocks")
    first = with_names(blocks, ["block"], "row", "block-names", short=["one", "two"])
    heads = first.where("pos = 0").select("row", "doc_id", "sha")
    longest = first.agg(F.max("n")).first()[0] or 1
    done, names, turn = [], first.select("row", "n", "pos", "name"), 0
    while True:
        done.append(names.where("n = 1").select("row", F.lit(turn).alias("turn"), "name"))
        if longest == 1:
            break
        pairs = (
            names.where("n > 1")
            .groupBy("row", F.expr("pos div 2").alias("pos"))
            .agg(F.max(F.expr("CASE WHEN pos % 2 = 0 THEN name END")).alias("a"), F.max(F.expr("CASE WHEN pos % 2 = 1 THEN name END")).alias("b"), F.expr("(first(n) + 1) div 2").alias("n"))
        )
        names, turn, longest = with_names(pairs, ["a", "b"], "row", f"pair-names-{turn}"), turn + 1, (longest + 1) // 2
    identity = done[0]
    for more in done[1:]:
        identity = identity.unionByName(more)
    rows = heads.join(identity, "row")
    rows = written(rows, "identities")
    best = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    groups = rows.groupBy("turn", "name").agg(F.min(best).alias("best"), F.count("*").alias("size")).where("size > 1")
    groups = groups.select("turn", "name", F.col("best.doc_id").alias("keep"), F.col("best.row").alias("keep_row"), "size")
    joined = rows.join(bounded(written(groups, "groups"), BROADCAST_GROUPS), ["turn", "name"], "left")
    alone = F.col("size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns whatever their names, one row of each group of equal texts. Rows without an id stay.

    Null texts count as empty. Rows that repeat an id are told apart by their texts alone, so those with
    equal texts become one. An empty table stays empty.
    """
    groups = exact_groups(docs, id_col, text_col).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    groups = written(groups.where("rows > 1 OR NOT kept"), "copies")
    gone = bounded(groups.where("NOT kept").select("doc_id"))
    left = docs.join(gone, docs[id_col].cast("long") == gone["doc_id"], "left_anti")
    repeated = groups.where("kept").select("doc_id")
    if repeated.isEmpty():
        return left
    among = docs[id_col].cast("long") == repeated["doc_id"]
    once = left.join(repeated, among, "left_semi").dropDuplicates([id_col, text_col])
    return left.join(repeated, among, "left_anti").unionByName(once)


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, body FROM t WINDOW w AS (PARTITION BY body))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""
