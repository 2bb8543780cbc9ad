"""Language identification by compression with zstandard raw-content dictionaries.

Texts are reduced to lower-case letters and single spaces. Each language has a dictionary, the reduced text
of a bounded sample of labelled documents. A text is cut into blocks of BLOCK_BYTES, each block is compressed with each dictionary, and the language whose blocks are
smallest in all is chosen. A narrow margin between the two smallest is a rejection (`accepted` is false).
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import each_text, held_out, in_batches

#: A dictionary holds so many bytes of so many documents at most. Of a document longer than all its pieces
#: together, so many pieces of so many characters are taken, one from each part of the text, at hashed places.
DICTIONARY_BYTES, DICTIONARY_DOCS, PIECES, PIECE_CHARS = 400_000, 400, 3, 500
BLOCK_BYTES, LEVEL, MARGIN = 4096, 6, 0.02
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_OTHER = bytes(c for c in range(128) if not chr(c).isalpha())
_TO_LETTERS = bytes.maketrans(_OTHER + string.ascii_uppercase.encode(), b" " * len(_OTHER) + string.ascii_lowercase.encode())


def letters(text: bytes) -> bytes:
    """Lower-case ASCII letters, bytes of other scripts, and single spaces for the rest."""
    return b" ".join(text.translate(_TO_LETTERS).split())


def _pieces():
    """Characters of a document that a dictionary takes: the whole text, or pieces spread over it."""
    part = F.floor(F.length("text") / PIECES).cast("int")
    at = [part * k + F.pmod(F.xxhash64("id", F.lit(k)), (part - PIECE_CHARS + 1).cast("long")).cast("int") for k in range(PIECES)]
    spread = F.concat_ws(" ", *(F.substring(F.col("text"), place + 1, F.lit(PIECE_CHARS)) for place in at))
    return F.when(F.length("text") <= PIECES * PIECE_CHARS, F.col("text")).otherwise(spread).alias("text")


def dictionaries(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Raw content for each language, from the documents whose hashed ids are smallest.

    The sample is drawn by hash before anything is ranked, so no language's documents meet in one task.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    place = (F.xxhash64("id").bitwiseAND(0x7FFFFFFF)) / float(1 << 31)
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, 2 * DICTIONARY_DOCS / n)).otherwise(share)
    sample = rows.withColumn("place", place).where(F.col("place") <= share)
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place", "id", "text"))
    sample = sample.select("lang", "place", "id", _pieces()).withColumn("n", first).where(F.col("n") <= DICTIONARY_DOCS)
    out: dict[str, list[bytes]] = {}
    for r in sample.orderBy("lang", F.desc("n")).select("lang", "text").collect():
        out.setdefault(r["lang"], []).append(letters(r["text"].encode()))
    return {lang: b"\n".join(parts)[-DICTIONARY_BYTES:] for lang, parts in out.items()}


def _classify(contents: dict[str, bytes]):
    def classify(batches):
        langs = sorted(contents)
        coders = []
        for lang in langs:
            held = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_dict_id=False).compress)
        for batch in batches:
            found, scores, sure = [], [], []
            for text in each_text(batch.column(2)):
                if not langs or not _LETTER.search(text.decode()):
                    found.append(UNKNOWN), scores.append(0.0), sure.append(False)
                    continue
                text = letters(text)
                blocks = [text[k : k + BLOCK_BYTES] for k in range(0, len(text), BLOCK_BYTES)]
                sizes = np.array([sum(len(code(b)) for b in blocks) for code in coders], float)
                best = int(np.argmin(sizes))
                # 1 if one dictionary is far better, 1 / languages if none is
                weight = np.exp(-(sizes - sizes[best]) / max(1.0, MARGIN * sizes[best]))
                margin = 1.0 if len(sizes) == 1 else (np.partition(sizes, 1)[1] - sizes[best]) / sizes[best]
                found.append(langs[best]), scores.append(float(1 / weight.sum())), sure.append(bool(margin >= MARGIN))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array(scores, pa.float64()), pa.array(sure)], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return classify


def predicted(docs: DataFrame, contents: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for each row of docs.

    Ties go to the language that sorts first. A null text, or one without a letter, is `und` with score 0,
    as is every text if nothing was learned. A text of any length is read whole. Rows are judged alone, so repeated rows get equal answers; a
    null id is carried along and is not held out; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return in_batches(rows, _classify(contents), "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predicted(docs, dictionaries(docs.where(~held_out(F.col("doc_id")))))
