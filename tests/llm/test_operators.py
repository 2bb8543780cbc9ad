"""The operators against plain Python, the libraries they stand beside, and SQL."""

import base64
import hashlib
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest

from tests.test_registry import rows, sql
from triagelake.llm import byte_bpe, exact_dedup, jaccard_join, language_id, license_scan, packing, quality_pu, substring_dedup, url_filter, vp_search
from triagelake.llm.components import components
from triagelake.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(sql(ORACLE_SQL[name]))


def test_exact_dedup_cases(odd, empty):
    got = exact_dedup.exact_groups(odd, block_bytes=16).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(got) == 14 and by[2][0]["keep_id"] == 1 and by[1][0]["group_size"] == 3 and by[None][0]["keep_id"] == 1
    assert by[4][0]["keep_id"] == 4 and by[5][0]["keep_id"] == 4 and by[6][0]["kept"]
    assert sorted(r["kept"] for r in by[7]) == [False, True]
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 6, 7, 8, 9, 10, 11, 12]


def test_block_names_tell_every_text_apart(spark):
    texts = ["".join(x) for n in range(1, 6) for x in itertools.product("ab", repeat=n)] * 2
    got = exact_dedup.exact_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block_bytes=1).collect()
    assert all(r["keep_id"] == texts.index(texts[r["doc_id"]]) and r["group_size"] == 2 for r in got)


def test_jaccard_cases(odd, empty):
    got = {r["doc_id"]: r for r in jaccard_join.similar_groups(odd).collect()}
    assert [got[k]["component_id"] for k in (1, 2, 3, 7, 8, 9, None)] == [1, 1, 1, 7, 7, 9, None]
    assert got[4]["n_shingles"] == got[6]["n_shingles"] == 0 and got[6]["component_id"] == 6 and got[7]["n_shingles"] == 1 and got[1]["n_shingles"] == 116
    assert jaccard_join.similar_groups(empty).count() == 0


def test_jaccard_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    docs = []
    for _ in range(40):
        base = [f"t{x}" for x in rng.integers(0, 50_000, rng.integers(6, 260))]
        for _ in range(5):
            copy = list(base)
            for at in rng.integers(0, len(copy), rng.integers(0, 1 + len(copy) // 60 + 1)):
                copy[at] = f"z{rng.integers(0, 99_999)}"
            docs.append(" ".join(copy))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in map(str.split, docs)]
    root = list(range(len(docs)))
    for a, b in itertools.combinations(range(len(docs)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_groups(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(docs))] == root


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 51), (7, 7)], "a long, b long")
    assert {r["node"]: r["root"] for r in components(links).collect()} == {**{k: 0 for k in range(31)}, 50: 50, 51: 50}


def test_substring_cases(odd, empty):
    got = {r["doc_id"]: r for r in substring_dedup.without_repeats(odd).collect()}
    assert (got[1]["n_removed"], got[2]["n_removed"], got[3]["n_removed"], got[None]["n_removed"]) == (0, 120, 0, 0)
    assert got[10]["n_removed"] == 70 and got[10]["kept_text"] == "start here" and got[9]["n_removed"] == 0 and got[11]["n_removed"] == 0
    assert substring_dedup.without_repeats(empty).count() == 0
    tight = substring_dedup.without_repeats(odd, max_cells=1 << 20)
    assert {r["doc_id"]: r["n_removed"] for r in tight.collect()} == {k: r["n_removed"] for k, r in got.items()}
    assert substring_dedup.cleaned(odd).schema == odd.schema


def plain_ids():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_bpe_as_the_library(spark, odd, empty):
    encode = plain_ids()
    extra = ["aaaaaaaaaaaaaaaaa", "  \n\n  x", "''''s 't", "zzzzqqqq" * 50, "\u0000\u200b"]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(extra)], "doc_id long, text string"))
    asked = sorted((r["doc_id"] or 0, r["text"] or "") for r in docs.collect())
    got = sorted(((r["doc_id"] or 0), r["bytes"].decode(), list(r["ids"])) for r in byte_bpe.decode(byte_bpe.encode(docs)).collect())
    assert got == sorted((d, t, encode(t)) for d, t in asked)
    assert byte_bpe.encode(empty).count() == 0


def test_packing(spark, odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = odd.dropDuplicates(["doc_id"])
    ids = {r["doc_id"]: [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    pieces = packing.pack(docs).toPandas().sort_values("start")
    for doc, want in ids.items():
        mine = pieces[pieces["doc_id"].isna()] if doc is None else pieces[pieces["doc_id"] == doc]
        at = 0
        for p in mine.itertuples():
            assert p.start == at and p.doc_tokens == len(want) and p.ids_crc32 == zlib.crc32(np.array(want[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(want)
    for _, bin_ in pieces.groupby("sequence_id"):
        bin_ = bin_.sort_values("offset")
        assert list(bin_["offset"]) == [0, *np.cumsum(bin_["length"])[:-1]] and bin_["length"].sum() <= 1024
    assert packing.pack(empty).count() == 0
    named = docs.where("doc_id IS NOT NULL")
    placed = packing.pack(named)
    assert sum(len(r["ids"]) for r in packing.sequences(placed, named).collect()) == sum(len(x) for d, x in ids.items() if d is not None)


@pytest.mark.parametrize("length", [1, 63, 341, 500, 700, 1023, 1024, 5000])
def test_cuts(length):
    assert sum(packing.cuts(length)) == length and max(packing.cuts(length)) <= 1024


def test_search(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 12)) * rng.uniform(0.2, 3, (900, 1))
    x[5] = x[6] = x[7]
    rows_ = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(900, None), (901, [0.0] * 12), (902, [float("nan")] * 12), (903, [None] * 12), (904, [1.0, 2.0])]
    v = spark.createDataFrame(rows_, "vec_id long, embedding array<double>")
    got = {}
    for r in vp_search.nearest(v, v.where("vec_id % 20 = 0"), k=7, shard_rows=300).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q in range(0, 900, 20):
        score = x @ x[q]
        want = sorted((k for k in range(900) if k != q), key=lambda k: (-score[k], k))[:7]
        assert [k for _, k in sorted(got[q])] == want
    assert len(got) == 45
    _, names, _, visited = vp_search.search(np.arange(900), x, np.arange(900), x, 7, 3.0, float(np.sqrt((x**2).sum(1)).max()), leaf=16)
    assert visited < 1 and len(names) == 6300


def test_search_recall(spark):
    got = {(r["query_id"], r["vec_id"]) for r in QUERIES["op3_vp_search"](spark, DATA).collect()}
    rows_ = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows_]), np.array([r["embedding"] for r in rows_], float)
    want = {(ids[q], ids[k]) for q in np.flatnonzero(ids % 20 == 0) for k in sorted((k for k in range(len(ids)) if k != q), key=lambda k: -(x[k] @ x[q]))[:20]}
    assert len(got & want) / len(want) >= 0.9


def test_urls(spark):
    urls = [None, "no scheme", "http://A.Example.com/en/1?x=/", "https://www.example.com/en/2", "ftp://x.net/es/3#a", "http://net/de/", "http://y.org/p/1", "http://example.com", "a://b://c/d"]
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    assert got == [("", "", None, "allow"), ("", "", None, "allow"), ("a.example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/2", "www.example.com/en/", "allow"), ("x.net", "/es/3", "net/es/", "block"), ("net", "/de/", None, "allow"), ("y.org", "/p/1", None, "allow"), ("example.com", "", None, "allow"), ("b:", "//c/d", None, "allow")]
    many = [f"http://h.net/es/{k}" for k in range(20)]
    out = url_filter.judged(spark.createDataFrame(list(enumerate(many)), "page_id long, url string")).collect()
    assert all(r["purity"] > 0.9 and r["template"] == "/es/*" for r in out)
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_language_held_out(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97
    contents = language_id.dictionaries(docs)
    by = {r["doc_id"]: r for r in language_id.predicted(odd, contents).collect()}
    assert by[4]["lang_pred"] == by[5]["lang_pred"] == by[6]["lang_pred"] == "und" and by[4]["score"] == 0
    assert language_id.predicted(empty, contents).count() == 0 and {r["lang_pred"] for r in language_id.predicted(odd, {}).collect()} == {"und"}


def test_quality_held_out(spark, odd, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = QUERIES["op10_quality_pu"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").toPandas()
    assert (got["quality"] == got["predicted"]).mean() > 0.95 and got["score"].between(0, 1).all()
    assert quality_pu.learned(empty, labels.limit(0)) is None
    assert quality_pu.scored(odd, None).where("score = 0.5 AND predicted = 1").count() == 14 and quality_pu.accepted(odd, None).columns == odd.columns


def test_license_inheritance(spark):
    rows_ = [("LICENSE", "Released under the MIT License."), ("a/LICENSE.txt", "Licensed under the Apache License, Version 2.0."), ("a/b/x.py", "print()"), ("c/y.py", None), ("a/z.py", "# Licensed under CC BY-NC 4.0.\nx"), (None, "")]
    found = license_scan.detected(spark.createDataFrame(rows_, "path string, text string"), "path", "text")
    got = {r["path"]: (r["effective"], r["origin"]) for r in license_scan.inherited(found).collect()}
    assert got == {"LICENSE": ("MIT", "own"), "a/LICENSE.txt": ("Apache-2.0", "own"), "a/b/x.py": ("Apache-2.0", "inherited"), "c/y.py": ("MIT", "inherited"), "a/z.py": ("CC-BY-NC-4.0", "own"), None: (None, "none")}


def test_pipeline_against_plain_steps(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = corpus_pipeline.quality_classifier(spark, docs, DATA)
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    once = {}
    for d in sorted(kept):
        once.setdefault(hashlib.sha256(exact_dedup.normalised(kept[d].encode())).digest(), d)
    exact = corpus_pipeline.exact_copies(spark, good, DATA)
    assert {r["doc_id"] for r in exact.collect()} == set(once.values()) and exact.columns == docs.columns
    near = corpus_pipeline.near_copies(spark, exact, DATA)
    left = corpus_pipeline.repeated_passages(spark, near, DATA)
    assert left.columns == docs.columns and left.count() == near.count()
    pieces = corpus_pipeline.run(spark, DATA).toPandas()
    assert set(pieces["doc_id"]) == {r["doc_id"] for r in left.collect()}
