"""Removal of passages of 50 words or more that a document with a smaller id has too.

Pass one fills a count-min sketch with each document's distinct windows. A window's cell is chosen by the
smallest hash among its 20-word grams, so windows that overlap share cells and a document adds about one
entry for each 16 words; equal windows always share a cell, hence estimates are never too low. Partition
sketches are merged by a shuffle on cell segments and only "two or more" is kept of a count: one bit for a
cell, two rows of cells. The broadcast bitmaps are at most 2 * MAX_CELLS / 8 bytes; beyond that size the
estimates grow coarser and more windows pass to the exact stage, none is lost.

Pass two sends windows estimated to repeat (as two independent 64-bit hashes with document and position) to their groups
and compares ids exactly. What a batch of documents already proves (a smaller id in the same batch) is
settled before the shuffle, so a passage that every document has reaches its group once for each batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, WordHashes, Windows, each_text, in_batches, longs, mix

WINDOW, GRAM = 50, 20
SEGMENT_BITS = 20
#: Cells in each of the two rows at most: 2 * 128 MB of bitmaps.
MAX_CELLS = 1 << 30
_FLUSH = 1_000_000


def _smallest(grams: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    have, out = 1, grams
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


class _Hasher:
    def __init__(self, window: int, gram: int):
        self.words, self.others, self.grams, self.span = WordHashes(), WordHashes(1), Windows(gram, 0x9E3779B97F4A7C15), window - gram + 1
        self.one, self.two = Windows(window, 0x2545F4914F6CDD1D), Windows(window, 0xD1342543DE82EF95)

    def least(self, hashes: np.ndarray) -> np.ndarray:
        """For each window the smallest hash of its grams."""
        grams = self.grams.of(hashes)
        return _smallest(grams, self.span) if len(grams) >= self.span else grams[:0]


def _cells(least: np.ndarray, row: int, mask: int) -> np.ndarray:
    return mix(least, 11 + row) & np.uint64(mask)


def _packed(cells: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.diff(cells, prepend=0).astype(np.uint32).tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint32), dtype=np.int64)


def _sketch(mask: int, window: int, gram: int):
    low = (1 << SEGMENT_BITS) - 1

    def pieces(held: list[np.ndarray]):
        for row in (0, 1):
            cells, counts = np.unique(np.concatenate([_cells(x, row, mask) for x in held]) if held else np.empty(0, np.uint64), return_counts=True)
            segments = (cells >> np.uint64(SEGMENT_BITS)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(segments, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(cells)], strict=True):
                inner = (cells[a:b] & np.uint64(low)).astype(np.int64)
                yield row, int(segments[a]), _packed(inner), _packed(inner[counts[a:b] > 1])

    def fill(batches):
        hasher, held, size = _Hasher(window, gram), [], 0
        for batch in batches:
            for text in each_text(batch.column(0)):
                least = np.unique(hasher.least(hasher.words.of(text.split())))
                if len(least):
                    held.append(least)
                    size += len(least)
                if size >= _FLUSH:
                    yield _pieces_batch(list(pieces(held)))
                    held, size = [], 0
        if held:
            yield _pieces_batch(list(pieces(held)))

    return fill


def _pieces_batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(("line", "segment", "once", "twice"), r, strict=True)) for r in rows], pa.schema([("line", pa.int32()), ("segment", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())]))


def _merge(batches):
    """Rows come sorted by (line, segment); counts above two are not told apart."""
    at, counts = None, np.zeros(1 << SEGMENT_BITS, np.uint8)

    def out():
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int64()), pa.array([np.packbits(counts > 1, bitorder="little").tobytes()], pa.binary())], names=["line", "segment", "bits"])

    for batch in batches:
        for r in batch.to_pylist():
            if (r["line"], r["segment"]) != at:
                if at:
                    yield out()
                at = (r["line"], r["segment"])
                counts[:] = 0
            once = _unpacked(r["once"])
            counts[once] = np.minimum(counts[once] + 1, 2)
            counts[_unpacked(r["twice"])] = 2
    if at:
        yield out()


def repeated_cells(docs: DataFrame, text_col: str, window: int, gram: int, max_cells: int):
    """The merged sketch: (mask, two bitmaps as bytes) of cells that two documents or more fall into."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    cells = min(max_cells, max(1 << SEGMENT_BITS, 1 << (int(size) // 20).bit_length()))
    parts = in_batches(docs.select(F.col(text_col).cast("string").alias("text")), _sketch(cells - 1, window, gram), "line int, segment long, once binary, twice binary")
    merged = in_batches(parts.repartition("line", "segment").sortWithinPartitions("line", "segment"), _merge, "line int, segment long, bits binary")
    maps = np.zeros((2, cells // 8), np.uint8)
    step = (1 << SEGMENT_BITS) // 8
    for r in merged.toLocalIterator():
        maps[r["line"], r["segment"] * step : (r["segment"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return cells - 1, spark.sparkContext.broadcast(maps)


def _suspects(mask: int, maps, window: int, gram: int):
    def bit(row, cells):
        return (maps.value[row][(cells >> np.uint64(3)).astype(np.int64)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1

    def settle(found):
        one, two, doc, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((doc, two, one))
        one, two, doc, place = one[order], two[order], doc[order], place[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        sure = doc > doc[new][np.cumsum(new) - 1]  # a smaller id in this batch has the same window
        key = np.where(sure, mix(place.view(np.uint64) ^ doc.view(np.uint64)), one)
        return pa.RecordBatch.from_arrays([pa.array(sure), longs(key), longs(np.where(sure, np.uint64(0), two)), longs(doc), longs(place)], names=["sure", "one", "two", "doc_id", "place"])

    def find(batches):
        hasher = _Hasher(window, gram)
        for batch in batches:
            found, held = [], 0
            for doc, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), each_text(batch.column(2)), strict=True):
                words = text.split()
                hashes = hasher.words.of(words)
                least = hasher.least(hashes)
                if not len(least):
                    continue
                hit = np.flatnonzero(bit(0, _cells(least, 0, mask)) & bit(1, _cells(least, 1, mask)))
                if len(hit):
                    found.append((hasher.one.of(hashes)[hit], hasher.two.of(hasher.others.of(words))[hit], np.full(len(hit), doc, np.int64), hit.astype(np.int64) | (mark << 32)))
                    held += len(hit)
                if held >= _FLUSH:
                    yield settle(found)
                    found, held = [], 0
            if found:
                yield settle(found)

    return find


def _later(batches):
    """Of rows sorted by (sure, one, two, doc_id), those whose group begins with a smaller id."""
    last, least = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        sure, one, two, doc, place = (np.asarray(c) for c in batch.columns)
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (sure[1:] != sure[:-1])
        new[0] = (sure[0], one[0], two[0]) != last
        starts = np.where(new, np.arange(len(one)), -1)
        starts = np.maximum.accumulate(starts)
        first = np.where(starts >= 0, doc[np.maximum(starts, 0)], least if least is not None else 0)
        last, least = (sure[-1], one[-1], two[-1]), first[-1]
        keep = sure | (doc > first)
        yield pa.RecordBatch.from_arrays([pa.array(doc[keep], pa.int64()), pa.array(place[keep], pa.int64())], names=["doc_id", "place"])


def _kept(text: bytes, places, window: int) -> tuple[int, list[bytes]]:
    """How many words the text has, and those that no listed window covers."""
    words = text.split()
    if not places:
        return len(words), words
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.asarray(places, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return len(words), [words[k] for k in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]


def _cut(window: int):
    def cut(batches):
        for batch in batches:
            rows = [_kept(text, places, window) for text, places in zip(each_text(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
            counts, gone = [n for n, _ in rows], [n - len(words) for n, words in rows]
            kept = [b" ".join(words).decode() for _, words in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return cut


def _repeats(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int, max_cells: int) -> DataFrame:
    """doc_id, mark, places: where windows start that a smaller id has too. mark tells texts under one id apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _mark(text_col).alias("mark"), F.col(text_col).cast("string").alias("text"))
    mask, maps = repeated_cells(rows, "text", window, gram, max_cells)
    suspects = in_batches(rows.where("doc_id IS NOT NULL AND text IS NOT NULL"), _suspects(mask, maps, window, gram), "sure boolean, one long, two long, doc_id long, place long")
    later = in_batches(suspects.repartition("one").sortWithinPartitions("sure", "one", "two", "doc_id"), _later, "doc_id long, place long")
    return later.groupBy("doc_id", F.expr("shiftright(place, 32)").alias("mark")).agg(F.collect_list(F.col("place").bitwiseAND(0xFFFFFFFF).cast("int")).alias("places"))


def _mark(text_col: str, docs: DataFrame | None = None):
    """Tells texts under one id apart; of the column of docs, where that is given."""
    text = F.col(text_col) if docs is None else docs[text_col]
    return F.xxhash64(text.cast("string")).bitwiseAND(0x7FFFFFFF)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, max_cells: int = MAX_CELLS) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_text (kept words joined by one space).

    A word goes if a window of `window` words that covers it also starts in a document with a smaller id;
    windows are judged on the input. Null texts have no words; texts shorter than a window stay whole. A
    row without an id is neither before nor after any other, so it stays whole and removes nothing. Rows
    that repeat an id do not remove each other's windows; different texts under one id are told apart by
    a hash. Other columns are not looked at; an empty table gives an empty result.
    """
    places = _repeats(docs, id_col, text_col, window, gram, max_cells)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _mark(text_col).alias("mark"), F.col(text_col).cast("string").alias("text"))
    return in_batches(rows.join(places, ["doc_id", "mark"], "left").select("doc_id", "text", "places"), _cut(window), "doc_id long, n_words long, n_removed long, kept_text string")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", window: int = WINDOW) -> DataFrame:
    """docs, all columns whatever their names, with the kept words as the text of rows that lose some; other rows stay as they are.

    length_col, where docs have it, becomes the new text's length in those rows. Cases as in without_repeats.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    places = _repeats(docs, id_col, text_col, window, GRAM, MAX_CELLS)
    joined = docs.join(places, (docs[id_col].cast("long") == places["doc_id"]) & (_mark(text_col, docs) == places["mark"]), "left")
    cut, text = places["places"].isNotNull(), docs[text_col]
    spare = "_".join(["cut", *(c.lower() for c in docs.columns)])  # longer than any name that docs have

    @F.arrow_udf("string")
    def kept(text: pa.Array, places: pa.Array) -> pa.Array:
        rows = zip(each_text(text), (p.as_py() for p in places), strict=True)
        return pa.array([None if p is None else b" ".join(_kept(t, p, window)[1]).decode() for t, p in rows], pa.string())

    # only texts that lose words go to Python workers
    new = kept(F.when(cut, text.cast("string")), places["places"])
    joined = joined.select(*(docs[c] for c in docs.columns), F.struct(cut.alias("cut"), new.alias("text")).alias(spare))
    at = F.col(f"`{spare}`")
    changed = {text_col: at["text"], length_col: F.length(at["text"])}
    of = lambda c: F.when(at["cut"], changed[c].cast(docs.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c) if c in changed else F.col(f"`{c}`")
    return joined.select(*(of(c) for c in docs.columns))


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, pos, md5(array_to_string(words[pos : pos + 49], ' ')) AS h FROM w, unnest(range(1, len(words) - 48)) AS u(pos) WHERE len(words) >= 50),
m AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY h) AS lowest FROM s),
r AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(pos, pos + 50)) AS p FROM m WHERE lowest < doc_id) GROUP BY doc_id),
k AS (SELECT w.doc_id, words, coalesce(r.gone, []) AS gone FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, len(words)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN len(gone) = 0 THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM k
"""
