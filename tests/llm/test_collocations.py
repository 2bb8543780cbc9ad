"""Phrases against a plain count, and against SQL on whole tables."""

import random
import re
from collections import Counter

import numpy as np

from tests.test_registry import rows, sql
from triagelake.llm import collocations
from triagelake.llm.common import WordHashes, Windows
from triagelake.llm.queries import ORACLE_SQL, QUERIES


def plain(docs, least, longest=5, top=2000):
    counts, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            counts.update((lang, *words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1))
    frequent = {p: a for p, a in counts.items() if a >= least}
    found = []
    for (lang, *w), a in frequent.items():
        if len(w) == 1:
            continue
        if any(q[0] == lang and len(q) > len(w) + 1 and b >= a and any(list(q[i : i + len(w)]) == w for i in range(1, len(q))) for q, b in frequent.items()):
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = counts[(lang, *w[:k])], counts[(lang, *w[k:])]
            cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.append((lang, -score, -a, " ".join(w).encode(), left, right, total[lang]))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right, n in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def got(spark, docs, **options):
    frame = spark.createDataFrame(docs, "lang string, text string")
    return sorted(tuple(r) for r in collocations.collocations(frame, **options).collect())


def test_against_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "TRIGGER", 3)
    monkeypatch.setattr(collocations, "SHORT", 6)
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 300)
    rng = random.Random(5)
    vocabulary = ["a", "B", "c", "dé", "É", "x\x1cy", "naïve", "日本", "of", "the", "NEW", "york", "0"]
    docs = []
    for k in range(160):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 90))]
        text = "".join(w + rng.choice([" ", "  ", "\t", " ", " ", ". ", "\r\n", ", "]) for w in words)
        docs += [(rng.choice(["en", "de", None, "und"]), text)] * rng.choice([1, 1, 1, 6])
    docs += [("en", None), ("en", ""), (None, None), ("fr", "one two " * 400), ("fr", "aa " * 1000), ("es", "w " * 3)]
    for least in (2, 9):
        assert got(spark, docs, min_count=least) == plain(docs, least)
    assert got(spark, docs, min_count=5, longest=3, top=4) == plain(docs, 5, 3, 4)


def test_counts_do_not_depend_on_the_bitmap(spark, monkeypatch):
    docs = [("en", " ".join(f"w{(k * j) % 17}" for j in range(200))) for k in range(20)]
    want = got(spark, docs, min_count=3)
    monkeypatch.setattr(collocations, "MAX_BITS", 1 << 6)
    monkeypatch.setattr(collocations, "_marked", lambda frequent, rows: frequent.sparkSession.sparkContext.broadcast(np.full(1, ~np.uint64(0))))
    assert got(spark, docs, min_count=3) == want == plain(docs, 3)


def test_each_phrase_lies_in_one_chunk():
    rng = random.Random(1)
    for n in (1, 4, 5, 23, 24, 25, 26, 400):
        words = [str(rng.randrange(9)).encode() for _ in range(n)]
        parts = collocations.chunks(words, 4, WordHashes(), Windows(4))
        starts = [len(p) - 4 for p in parts[:-1]] + [len(parts[-1])]
        assert sum(starts) == n and all(s > 0 for s in starts)
        joined = [w for p, s in zip(parts, starts, strict=True) for w in p[:s]]
        assert joined == words


def test_scores_beyond_64_bits(spark):
    found = spark.createDataFrame([("en", 1, "x", 10**13), ("en", 1, "y", 10**13 + 7), ("en", 2, "x y", 10**13 - 3)], "lang string, size int, phrase string, f long")
    total = spark.createDataFrame([("en", 3 * 10**14)], "lang string, n long")
    collocations_counted, collocations.counted = collocations.counted, lambda *a: (found, total)
    try:
        (r,) = collocations.collocations(found).collect()
    finally:
        collocations.counted = collocations_counted
    assert r["score"] == 1000 * (10**13 - 3) * (3 * 10**14) // (10**13 * (10**13 + 7))


def test_odd_rows(spark, odd, empty):
    docs = [(r["lang"], r["text"]) for r in odd.collect()]
    assert sorted(tuple(r) for r in collocations.collocations(odd, min_count=2).collect()) == plain(docs, 2)
    assert collocations.collocations(empty).count() == 0


def test_whole_tables(spark):
    data = "/root/testdata/sf0.01"
    assert rows(QUERIES["op12_collocations"](spark, data).toPandas()) == rows(sql(ORACLE_SQL["op12_collocations"], data))
