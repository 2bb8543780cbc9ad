"""Phrases of two to five words that occur together more often than their parts would by chance.

Prefix-free parsing: each piece of text is cut into chunks at words whose last `longest - 1` words hash to
a trigger, and every chunk begins with the words that triggered the one before. A phrase of up to `longest`
words that starts before the closing trigger lies whole in exactly one chunk, so it is counted there and
nowhere else. Spark gathers the distinct chunks with their frequencies; that dictionary is written once and
phrases are counted inside its chunks, weighted. A text that many documents share costs its chunks once.

Counting goes up by length: a phrase can be frequent only if both phrases one word shorter are. Frequent
phrases are marked in a bitmap of hashes of at most MAX_BITS bits, which workers use as a filter: it may let
more through, never less, and what passes is counted by its text, so counts are exact at any size.
"""

from __future__ import annotations

import itertools
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, Windows, each_text, in_batches, longs, mix, shared_dir, written

#: A trigger is one window of words in so many.
TRIGGER = 16
#: Pieces of so many words or fewer are one chunk.
SHORT = 24
#: Bits of the bitmap of frequent phrases at most: 32 MB. Beyond 1/16 of them in use it filters less.
MAX_BITS = 1 << 28
#: A worker hands its chunks on at so many bytes, and counts phrases over so many words at a time.
CHUNK_BYTES, BLOCK_WORDS = 24 << 20, 1_600_000
_CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" ")
_TIMES = np.uint64(0x9E3779B97F4A7C15)


def pieces(text: bytes) -> list[list[bytes]]:
    """A-Z lower-cased, cut at `[.,;:!?\\x0A-\\x0D]`, words at blanks and tabs. Pieces without words are left out."""
    return [w for w in map(bytes.split, text.translate(_CLEAN).split(b"\n")) if w]


def chunks(words: list[bytes], overlap: int, hashes: WordHashes, windows: Windows) -> list[list[bytes]]:
    """The overlapping chunks of a piece; the first words of each are the last `overlap` of the one before."""
    if len(words) <= SHORT:
        return [words]
    ends = np.flatnonzero(windows.of(hashes.of(words)) % np.uint64(TRIGGER) == 0) + overlap  # behind each trigger
    ends = ends[(ends > overlap) & (ends < len(words))]
    starts = [0, *(ends - overlap)]
    return [words[a:b] for a, b in zip(starts, [*ends, len(words)], strict=True)]


def _parsed(overlap: int):
    def out(held):
        rows = [(lang, chunk, last, n) for (lang, last), found in held.items() for chunk, n in found.items()]
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()).cast(pa.string()), pa.array(columns[2], pa.bool_()), pa.array(columns[3], pa.int64())], names=["lang", "chunk", "last", "n"])

    def parse(batches):
        hashes, windows, held, size = WordHashes(), Windows(overlap), {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), each_text(batch.column(1)), strict=True):
                whole, opened = held.setdefault((lang, True), Counter()), held.setdefault((lang, False), Counter())
                ended = []
                for words in pieces(text):
                    if len(words) > SHORT:
                        *before, words = chunks(words, overlap, hashes, windows)
                        opened.update(map(b" ".join, before))
                        size += sum(map(len, before)) * 40
                    ended.append(b" ".join(words))
                whole.update(ended)
                size += len(text) + 60 * len(ended)  # at most what is held
                if size >= CHUNK_BYTES * 4:
                    size = sum(len(c) + 120 for found in held.values() for c in found)
                    if size >= CHUNK_BYTES:
                        yield out(held)
                        held, size = {}, 0
                        hashes.clear()
        if any(held.values()):
            yield out(held)

    return parse


def dictionary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5) -> DataFrame:
    """The distinct chunks of all texts, written: lang, chunk, last (it ends its piece), n (how often it occurs)."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    found = in_batches(rows, _parsed(longest - 1), "lang string, chunk string, last boolean, n long")
    return written(found.groupBy("lang", "chunk", "last").agg(F.sum("n").alias("n")), "chunks")


class _Bitmap:
    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 64 - 1)

    def __getitem__(self, hashes: np.ndarray) -> np.ndarray:
        at = mix(hashes, 3) & self.mask
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _joined(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of all its words but the last, and of the last."""
    with np.errstate(over="ignore"):
        return mix(first * _TIMES + then)


def _block(lang: str, tokens: list[bytes], limits: np.ndarray, lengths: np.ndarray, weights: np.ndarray, wanted: list[tuple[int, int]], bitmap: _Bitmap | None):
    """For each (size, tested) of wanted: (size, places, hashes, counts) of a language's distinct phrases of `size` words, those whose parts of `tested` words all pass the bitmap.

    tokens: the words of all chunks, one separator behind each chunk. limits: starts counted in each chunk.
    """
    vocabulary: dict[bytes, int] = defaultdict(itertools.count().__next__)
    ids = np.fromiter(map(vocabulary.__getitem__, tokens), np.int64, len(tokens))
    seed = xxhash.xxh64_intdigest(lang.encode())
    of_word = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in vocabulary), np.uint64, len(vocabulary))
    single = of_word[ids]
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths + 1) - (lengths + 1), lengths + 1)
    left = np.repeat(lengths, lengths + 1) - place  # words from here to the end of the chunk
    counted = place < np.repeat(limits, lengths + 1)
    weight = np.repeat(weights, lengths + 1)
    passed: dict[int, np.ndarray] = {}

    def hashed(at: np.ndarray, size: int) -> np.ndarray:
        out = single[at]
        for n in range(1, size):
            out = _joined(out, single[at + n])
        return out

    for size, tested in wanted:
        if tested and tested not in passed:
            passed[tested] = np.zeros(len(tokens), bool)
            at = np.flatnonzero(left >= tested)
            passed[tested][at] = bitmap[hashed(at, tested)]
        at = np.flatnonzero((left >= size) & counted)
        for n in range(size - tested + 1 if tested else 0):
            at = at[passed[tested][at + n]]
        key = ids[at]
        for n in range(1, size):  # exact: a phrase is named by its first words' name and its last word
            if n > 1:
                _, key = np.unique(key, return_inverse=True)
            key = key * len(of_word) + ids[at + n]
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        counts = np.zeros(len(first), np.int64)
        np.add.at(counts, inverse, weight[at])
        yield size, at[first], hashed(at[first], size), counts


def _by_language(batch):
    """The rows of a batch, language by language: (language, chunks, last, n)."""
    coded = pa.array(batch.column(0)).dictionary_encode()
    at = np.asarray(coded.indices)
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(len(coded.dictionary) + 1))
    for k, lang in enumerate(coded.dictionary.to_pylist()):
        yield lang, *(batch.column(c).take(pa.array(order[cuts[k] : cuts[k + 1]])) for c in (1, 2, 3))


def _counter(wanted: list[tuple[int, int]], named: bool, bits, longest: int):
    def flush(held, bitmap):
        for lang, parts in held.items():
            chunks_, last, n = (pa.chunked_array([p[k] for p in parts]).combine_chunks() for k in range(3))
            lengths = np.asarray(pc.count_substring(chunks_, " ")).astype(np.int64) + 1
            limits = np.where(np.asarray(last), lengths, lengths - (longest - 1))
            tokens = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chunks_)], pa.int32()), chunks_), " \n ")[0].as_buffer().to_pybytes().split(b" ")
            tokens.append(b"\n")
            for size, at, hashes, counts in _block(lang, tokens, limits, lengths, np.asarray(n), wanted, bitmap):
                if len(at) and named:
                    phrases = pa.array([b" ".join(tokens[k : k + size]) for k in at], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), size, np.int32)), phrases, longs(hashes), pa.array(counts)], names=["lang", "size", "phrase", "hash", "n"])
                elif len(at):
                    yield pa.RecordBatch.from_arrays([longs(hashes), pa.array(counts)], names=["hash", "n"])

    def count(batches):
        bitmap = _Bitmap(bits.value) if bits is not None else None
        held, words = {}, 0
        for batch in batches:
            for lang, chunks_, last, n in _by_language(batch):
                held.setdefault(lang, []).append((chunks_, last, n))
                words += chunks_.nbytes // 6
            if words >= BLOCK_WORDS:
                yield from flush(held, bitmap)
                held, words = {}, 0
        yield from flush(held, bitmap)

    return count


def _marked(frequent: DataFrame, rows: int):
    """A broadcast bitmap of the hashes of frequent phrases; its size is set by their number and bounded."""
    bits = 1 << 16
    while bits < min(MAX_BITS, 16 * rows):
        bits *= 2

    def cells(batches):
        for batch in batches:
            at = mix(np.asarray(batch.column(0)).view(np.uint64), 3) & np.uint64(bits - 1)
            yield pa.RecordBatch.from_arrays([longs(at >> np.uint64(6)), longs(np.uint64(1) << (at & np.uint64(63)))], names=["cell", "bit"])

    out = np.zeros(bits // 64, np.uint64)
    set_cells = in_batches(frequent.select("hash"), cells, "cell long, bit long").groupBy("cell").agg(F.bit_or("bit").alias("bit"))
    for batch in set_cells.toArrow().to_batches():
        out[np.asarray(batch.column(0))] = np.asarray(batch.column(1)).view(np.uint64)
    return frequent.sparkSession.sparkContext.broadcast(out)


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """Two written tables: every phrase of 1 to `longest` words that occurs min_count times or more (lang, size, phrase, f), and all words (lang, n).

    Pairs of words are by far the most candidates, so they are first counted by hash alone; the next pass
    counts by text those whose hash is frequent, and with them the candidates of three words.
    """
    chunks_ = dictionary(docs, text_col, lang_col, longest)
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/phrases-{uuid.uuid4().hex}"
    schema = "lang string, size int, phrase string, hash long, f long"

    def texts_of(wanted, bits):
        found = in_batches(chunks_, _counter(wanted, True, bits, longest), "lang string, size int, phrase string, hash long, n long")
        return found.groupBy("lang", "size", "phrase", "hash").agg(F.sum("n").alias("f"))

    def kept(found: DataFrame, name: str) -> DataFrame:
        found.where(F.col("f") >= min_count).write.parquet(f"{path}/pass={name}")
        return spark.read.schema(schema).parquet(f"{path}/pass={name}")

    words = written(texts_of([(1, 0)], None), "words")
    total = written(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    frequent = kept(words, "1")
    if rows := frequent.count():
        pairs = in_batches(chunks_, _counter([(2, 1)], False, _marked(frequent, rows), longest), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
        pairs = written(pairs.where(F.col("n") >= min_count).select("hash"), "pairs")
        rows, bits = pairs.count(), None
        if rows:
            bits = _marked(pairs, rows)
            frequent = kept(texts_of([(2, 2), (3, 2)] if longest > 2 else [(2, 2)], bits), "2")
        for size in range(4, longest + 1):
            last = frequent.where(F.col("size") == size - 1)
            rows = rows and last.count()
            if not rows:
                break
            frequent = kept(texts_of([(size, size - 1)], _marked(last, rows)), str(size - 1))
    return spark.read.schema(schema + ", pass string").option("basePath", path).parquet(path).select("lang", "size", "phrase", "f"), total


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    n: word occurrences of the language; a, l, r: occurrences of the phrase and of the two parts of its
    weakest cut; score: floor(1000 * a * n / (l * r)) there. Order: score and a descending, phrase by UTF-8
    bytes. Phrases that lie in a longer one as frequent as they are go. Arithmetic is in decimals of 38
    digits. Null texts are empty, a null language is `und` (and counts with rows that say `und`); repeated
    rows count each time; texts may be of any length and hold one word only; an empty table gives an empty
    result; other columns, whatever their names, are not looked at.
    """
    found, total = counted(docs, text_col, lang_col, min_count, longest)
    phrases = found.where("size > 1")
    words = F.split("phrase", " ", -1)
    part = lambda a, n: F.array_join(F.slice(F.col("w"), a, n), " ")
    # f never grows with length, so a longer phrase as frequent as this one has one between that is one word longer
    shorter = phrases.where("size > 2").withColumn("w", words).select("lang", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase"), F.col("f").alias("longer"))
    shorter = shorter.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = phrases.join(shorter, ["lang", "phrase"], "left").where("longer IS NULL OR longer < f").select("lang", "phrase", "size", F.col("f").alias("a"))
    cuts = kept.withColumn("w", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    cuts = cuts.join(found.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(found.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.join(F.broadcast(total) if total.count() <= 100_000 else total, "lang")
    score = F.expr("cast(1000 * cast(a as decimal(17,0)) * cast(n as decimal(17,0)) as decimal(38,0)) div cast(cast(l as decimal(19,0)) * cast(r as decimal(19,0)) as decimal(38,0))")
    least = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("c.a"), "phrase"))
    return least.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "c.a", "c.l", "c.r", "c.n", "c.score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_PHRASES = " UNION ALL ".join(f"SELECT lang, {n} AS size, array_to_string(w[i:i+{n - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM p WHERE len(w) >= {n})" for n in range(1, 6))
OP12_SQL = rf"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
f AS (SELECT lang, size, phrase, count(*) AS f FROM ({_PHRASES}) GROUP BY lang, size, phrase HAVING count(*) >= 100),
inner_ AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, f, array_to_string(string_split(phrase, ' ')[s:size - 2 + s], ' ') AS phrase FROM f, (VALUES (1), (2)) v(s) WHERE size > 2)
  GROUP BY lang, phrase),
c AS (SELECT f.lang, f.size, f.phrase, f.f AS a FROM f LEFT JOIN inner_ i ON i.lang = f.lang AND i.phrase = f.phrase WHERE f.size > 1 AND (i.longer IS NULL OR 100 * i.longer < 100 * f.f)),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS lp, array_to_string(string_split(phrase, ' ')[k+1:size], ' ') AS rp
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, cuts.k, l.f AS l, r.f AS r, t.n, ((1000::HUGEINT * cuts.a * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = cuts.lp JOIN f r ON r.lang = cuts.lang AND r.phrase = cuts.rp JOIN total t ON t.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000"""
