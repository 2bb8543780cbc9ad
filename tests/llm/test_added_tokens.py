"""Packed ids are those of the tokenizers library at its default setting, added tokens included."""

import tempfile
import zlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from triagelake.llm import packing
from triagelake.llm.queries import QUERIES


def test_added_tokens_are_one_id(spark):
    from tokenizers import Tokenizer

    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}x", f"x  {end}\n\n  y", f"<|endoftext|{end}|>", "<|endoftext", "", None, f"naïve 日本 {end}😀 " * 300]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {k: [*t.encode(x or "", add_special_tokens=False).ids, 0] for k, x in enumerate(texts)}
    assert ids[0] == [64, 220, 50256, 275, 0]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = tempfile.mkdtemp(prefix="spark-tests-")
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    for pieces in (QUERIES["op9_packing"](spark, folder), corpus_pipeline.packed(spark, docs, folder)):
        got = pieces.collect()
        assert sum(p["length"] for p in got) == sum(map(len, ids.values()))
        for p in got:
            want = ids[p["doc_id"]]
            assert p["doc_tokens"] == len(want) and p["ids_crc32"] == zlib.crc32(np.array(want[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
    placed = packing.pack(docs, encode_special_tokens=False)
    packed = [k for r in packing.sequences(placed, docs, encode_special_tokens=False).collect() for k in r["ids"]]
    assert sorted(packed) == sorted(k for x in ids.values() for k in x)
