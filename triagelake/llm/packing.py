"""Harmonic packing of token sequences.

A document's ids (and the id that ends it) are cut into full sequences and a rest. A piece of length l is of
class k = capacity // l, and a bin of class k takes exactly k pieces. A rest that would leave its bin with
more than 2 % of padding is cut at capacity // (k + 1), the longest length that fills the next class, and
what is left is classed in turn; pieces of 64 ids or less are never cut. A piece's place follows from its
rank in its class alone, so partitions fill bins independently: only the counts by (partition, class) are
brought together, one small row for each. What does not fill a last bin (under 5,000 pieces, whatever the
input) is packed by best fit.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, written

CAPACITY, UNCUT, PADDING = 1024, 64, 0.02
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
#: Encoded words held by a worker at most.
CACHE_WORDS = 600_000
#: Byte-level vocabularies spell each byte as one character: printable ones as themselves, the rest from U+0100 on.
_PRINTABLE = frozenset([*range(33, 127), *range(161, 173), *range(174, 256)])
_SPELLED = {b: b if b in _PRINTABLE else 256 + sum(x not in _PRINTABLE for x in range(b)) for b in range(256)}


class Encoder(dict):
    """Ids (as little-endian 32-bit words) of pre-tokens; the model of the tokenizers library merges each one once.

    Texts are cut at the tokenizer's added tokens first, as the library does: the leftmost, of these the longest.
    With `encode_special_tokens` (the library's name for it) special ones among them are text like any other.
    """

    def __init__(self, path: str, encode_special_tokens: bool = False):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.merge = tokenizer.model.tokenize
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        added = {t.content: (k, t) for k, t in tokenizer.get_added_tokens_decoder().items() if not (t.special and encode_special_tokens)}
        if any(t.lstrip or t.rstrip or t.single_word for _, t in added.values()):
            raise ValueError("added tokens that strip or match single words are not supported")
        self.added = {content: struct.pack("<I", k) for content, (k, _) in added.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        pieces = self.merge(word.encode().decode("latin-1").translate(_SPELLED))
        out = self[word] = struct.pack(f"<{len(pieces)}I", *[x.id for x in pieces])
        return out

    def ids(self, text: str) -> bytes:
        if self.cut is None or not any(x in text for x in self.added):
            return b"".join(map(self.__getitem__, self.split(text)))
        return b"".join(self.added[x] if k % 2 else b"".join(map(self.__getitem__, self.split(x))) for k, x in enumerate(self.cut(text)))


@functools.lru_cache(2)
def encoder(path: str, encode_special_tokens: bool = False) -> Encoder:
    return Encoder(path, encode_special_tokens)


def cuts(total: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces, in order."""
    out, rest = [capacity] * (total // capacity), total % capacity
    while rest:
        k = capacity // rest
        if rest <= UNCUT or capacity - k * rest <= PADDING * capacity:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


def _pieces(path: str, capacity: int, encode_special_tokens: bool):
    def cut(batches):
        part, ranks, words = TaskContext.get().partitionId(), {}, encoder(path, encode_special_tokens)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = words.ids(text or "") + END_ID.to_bytes(4, "little")
                total, start = len(ids) // 4, 0
                for length in cuts(total, capacity):
                    k = capacity // length
                    rank = ranks[k] = ranks.get(k, -1) + 1
                    out.append((part, doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, k, rank))
                    start += length
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["part", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "rank"])

    return cut


def _best_fit(pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Longest first, each into the fullest bin that has room; ties by document and start."""
    pieces = pieces.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    room: list[int] = []
    bins, at = [], []
    for length in pieces["length"]:
        fits = [b for b, left in enumerate(room) if left >= length]
        b = min(fits, key=room.__getitem__) if fits else len(room)
        if not fits:
            room.append(capacity)
        bins.append(b)
        at.append(capacity - room[b])
        room[b] -= length
    return pieces.assign(sequence_id=bins, offset=at)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]].astype({"sequence_id": "int64", "offset": "int64"})


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, encode_special_tokens: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one piece, the id that ends a document. Rows that repeat an id are packed as
    documents of their own; a null id is carried along. Sequence ids are unique, not dense; those of class
    k lie from k * 2**40. An empty table gives no pieces. Other columns are not looked at. The queries set
    `encode_special_tokens` to False, the default of the tokenizers library, so that the literal of an added
    token is its one id; here the default is to take it as text.
    """
    path = tokenizer or public_tokenizers.path(VOCABULARY)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "part long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class long, rank long"
    pieces = written(in_batches(source, _pieces(path, capacity, encode_special_tokens), schema), "pieces")
    counts = pieces.groupBy("class", "part").agg(F.count("*").alias("n"))
    w = Window.partitionBy("class").orderBy("part")
    counts = counts.select("class", "part", (F.sum("n").over(w) - F.col("n")).alias("before"), (F.sum("n").over(Window.partitionBy("class"))).alias("all"))
    placed = pieces.join(counts, ["class", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    whole = F.col("rank") < F.expr("(all div class) * class")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = placed.where(whole).withColumn("sequence_id", F.expr("class * 1099511627776 + rank div class"))
    in_bin = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    full = full.select(*columns, "sequence_id", F.coalesce(F.sum("length").over(in_bin), F.lit(0)).alias("offset"))
    rest = placed.where(~whole).select(*columns, F.lit(0).alias("one"))
    rest = rest.groupBy("one").applyInPandas(lambda pieces: _best_fit(pieces, capacity), full.schema)
    return full.unionByName(rest)


def sequences(pieces: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, encode_special_tokens: bool = True) -> DataFrame:
    """The packed ids: sequence_id, ids (array of the pieces' ids in order, not padded). Ids of docs must be unique; `encode_special_tokens` is that of pack."""
    path = tokenizer or public_tokenizers.path(VOCABULARY)
    wanted = pieces.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("cuts"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def slices(batches):
        words = encoder(path, encode_special_tokens)
        for batch in batches:
            out = []
            for text, spots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(words.ids(text or "") + END_ID.to_bytes(4, "little"), "<u4").astype(np.int64)
                out += [{"sequence_id": c["sequence_id"], "offset": c["offset"], "ids": ids[c["start"] : c["start"] + c["length"]]} for c in spots]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    cut = in_batches(texts.join(wanted, "doc_id").select("text", "cuts"), slices, "sequence_id long, offset long, ids array<long>")
    return cut.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), encode_special_tokens=False)
