"""Byte-level BPE by merge replay.

A worker gathers the distinct pre-tokens of its documents that it has not met, lays their bytes out in one
symbol sequence and builds an inverted index from merged token to the positions of the pairs that make it.
Merges are then applied in rank order over all those words at once; each merge looks only at the two
neighbours of the place it touched. A word is encoded once and then looked up, so the cost of merging
follows the vocabulary of the corpus, not its length. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import functools
import heapq

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Encoded words held by a worker at most; a batch's own new words come on top.
CACHE_WORDS = 500_000


@functools.lru_cache(2)
def vocabulary(path: str) -> tuple[dict[bytes, int], dict[int, bytes]]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return ranks, {rank: token for token, rank in ranks.items()}


def replay(words: list[bytes], ranks: dict[bytes, int], tokens: dict[int, bytes]) -> list[list[int]]:
    """Ids of each word. Among equal ranks the leftmost pair merges first, as if each word were alone."""
    out: list[list[int]] = [[] for _ in words]
    symbols: list[int] = []
    first: list[int] = []
    for k, word in enumerate(words):
        if word in ranks:  # a word that is a token takes no merges
            out[k] = [ranks[word]]
            first.append(-1)
            continue
        first.append(len(symbols))
        symbols += [ranks[word[i : i + 1]] for i in range(len(word))]
        symbols.append(-1)  # the end of a word
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    known: dict[int, int] = {}

    def made(a: int, b: int) -> int:
        """The token that two symbols make, or -1."""
        found = known[a << 32 | b] = ranks.get(tokens[a] + tokens[b], -1)
        return found

    pair = [-1] * n  # what the pair at each position makes
    places: dict[int, list[int]] = {}
    for at in range(n - 1):
        a, b = symbols[at], symbols[at + 1]
        if a >= 0 and b >= 0:
            rank = known.get(a << 32 | b)
            if rank is None:
                rank = made(a, b)
            if rank >= 0:
                pair[at] = rank
                if rank in places:
                    places[rank].append(at)
                else:
                    places[rank] = [at]
    queue = list(places)
    heapq.heapify(queue)
    while queue:
        rank = heapq.heappop(queue)
        todo = sorted(places.pop(rank))
        for k, at in enumerate(todo):
            if pair[at] != rank:
                continue  # a neighbour's merge took this pair
            gone = after[at]
            symbols[at], symbols[gone], pair[gone] = rank, -2, -1
            right = after[at] = after[gone]
            before[right] = at
            left, sooner = before[at], False
            for near, a, b in ((at, rank, symbols[right]), (left, symbols[left] if left >= 0 else -1, rank)):
                if a < 0 or b < 0:
                    if near == at:
                        pair[at] = -1
                    continue
                new = known.get(a << 32 | b)
                if new is None:
                    new = made(a, b)
                pair[near] = new
                if new >= 0:
                    if new in places:
                        places[new].append(near)
                    else:
                        places[new] = [near]
                        heapq.heappush(queue, new)
                    sooner |= new <= rank
            if sooner and k + 1 < len(todo):  # that merge may come before the rest of these
                if rank in places:
                    places[rank] += todo[k + 1 :]
                else:
                    places[rank] = todo[k + 1 :]
                    heapq.heappush(queue, rank)
                break
    for k, at in enumerate(first):
        if at >= 0:
            ids = out[k]
            while symbols[at] != -1:
                ids.append(symbols[at])
                at = after[at]
    return out


@functools.lru_cache(2)
def _known(path: str, pattern: str) -> dict[str, bytes]:
    """Words that this worker has encoded, in whichever task."""
    return {}


def _encode(path: str, pattern: str):
    def encode(batches):
        ranks, tokens = vocabulary(path)
        split, cache = regex.compile(pattern).findall, _known(path, pattern)
        for batch in batches:
            rows = batch.column(1).to_pylist()
            at, size = 0, 0
            for end in range(1, len(rows) + 1):
                size += len(rows[end - 1] or "")
                if size < 4_000_000 and end < len(rows):
                    continue
                pieces = [split(text or "") for text in rows[at:end]]
                new = list({word for words in pieces for word in words} - cache.keys())
                if len(cache) + len(new) > CACHE_WORDS:
                    cache.clear()
                    new = list({word for words in pieces for word in words})
                for word, ids in zip(new, replay([w.encode() for w in new], ranks, tokens), strict=True):
                    cache[word] = np.asarray(ids, np.int32).tobytes()
                ids = [b"".join(map(cache.__getitem__, words)) for words in pieces]
                offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "ids"])
                at, size = end, 0

    return encode


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids (array of int) for each row. Null texts count as empty and have no ids; an id, null or
    repeated, is carried along; other columns are not looked at; an empty table gives an empty result."""
    path = tokenizer or public_tokenizers.path(VOCABULARY)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_encode(path, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """encoded (doc_id, ids) with `bytes`: the ids' bytes in order. A null list has no bytes; ids outside the vocabulary fail."""
    path = tokenizer or public_tokenizers.path(VOCABULARY)

    def back(batches):
        tokens = vocabulary(path)[1]
        for batch in batches:
            ids = batch.column(1)
            ends = np.cumsum([0, *ids.value_lengths().fill_null(0).to_pylist()])
            flat = ids.flatten().to_numpy(zero_copy_only=False)  # null lists have no values
            lists = [b"".join(map(tokens.__getitem__, flat[a:b].tolist())) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(lists, pa.binary())], names=["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(back, "doc_id long, ids array<int>, bytes binary")


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    both = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
