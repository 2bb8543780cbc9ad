"""Toxicity from confirmed toxic examples and unlabelled text (non-negative PU learning).

Toxic vocabulary is learned first: words, and beginnings of words, that confirmed examples hold far more
often than unlabelled documents do. A text is then described by how many of its distinct words fall into
each band of that evidence, and a small numpy network on these numbers minimises the class-prior-corrected
non-negative risk of `quality_pu.fit`. The vocabulary of one learning fold describes the documents of the
other while the network learns, so that words which merely happen to be in a positive are not trusted;
scores use the vocabulary of both.

Copies and near copies of a document would pass off its words as evidence, so texts that share their
smallest hash of five-word runs count once in the learning sample. That sample is bounded (SAMPLE) and so
is the vocabulary (LEXICON); scoring covers every document and needs no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, Windows, each_text, held_out, in_batches, own, written
from .quality_pu import Model, fit

#: Labelled, and unlabelled, documents in the learning sample at most (drawn by hashed id).
SAMPLE = 24_000
#: Entries of the vocabulary at most, the best by evidence.
LEXICON = 20_000
#: Beginnings of so many characters stand for a word beside the word itself.
PREFIXES = (3, 4, 5, 6)
#: Standard deviations above what unlabelled text leads one to expect, at which a band begins.
BANDS = (2.5, 4.0, 6.0, 9.0, 13.0)
#: A vocabulary entry makes its document toxic with this probability at least, as the learning sample shows it.
LEAST = 0.7
#: A beginning is no evidence of its own if one longer entry is in this share of its confirmed examples.
ONE_WORD = 0.8
#: A worker's counts are handed on, and its cache of words emptied, at so many entries.
_HELD = 300_000
_WORD = re.compile(r"\w+")


def words(text: bytes) -> set[str]:
    """Distinct words in lower case: letters, digits and underscores of any script."""
    return set(_WORD.findall(text.decode("utf-8", "replace").lower()))


def entries(word: str) -> list[str]:
    """What a word counts for: its beginnings, then itself with an end mark."""
    return [*(word[:n] for n in PREFIXES if n <= len(word)), word + "$"]


class _Evidence(dict):
    """The best band of a word's entries, 0 if none is known; kept for words seen before."""

    def __init__(self, bands: dict[str, int]):
        super().__init__()
        self.bands = bands

    def __missing__(self, word: str) -> int:
        if len(self) >= _HELD:
            self.clear()
        out = self[word] = max(self.bands.get(e, 0) for e in entries(word))
        return out


WIDTH = 2 * len(BANDS) + 2


def features(text: bytes, evidence: _Evidence) -> list[float]:
    found = words(text)
    hits = np.bincount([b for b in map(evidence.__getitem__, found) if b], minlength=len(BANDS) + 1)[1:]
    upward = hits[::-1].cumsum()[::-1]  # words in this band or a higher one
    n = max(1, len(found))
    return [*np.minimum(upward, 4) ** 0.5, *np.sqrt(np.minimum(upward / n, 1.0)), np.log1p(n) / 10, float(upward[0] > 0)]


def _keyed(batches):
    """Adds the smallest hash of a text's runs of five words (of all its words, where they are fewer)."""
    hashes, runs = WordHashes(), Windows(5)
    for batch in batches:
        keys = []
        for text in each_text(batch.column(3)):
            h = hashes.of(text.lower().split())
            found = runs.of(h)
            keys.append(int((found.min() if len(found) else np.bitwise_xor.reduce(h) if len(h) else np.uint64(0)).view(np.int64)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=["doc_id", "fold", "roles", "text", "key"])


def _counted(batches):
    """Documents of each role and fold that hold an entry, summed over the worker's rows as far as memory allows."""
    counts: list[Counter] = [Counter() for _ in range(4)]

    def out():
        names = list(set().union(*counts))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in counts)], names=["entry", "p0", "p1", "u0", "u1"])

    for batch in batches:
        for role, fold, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), each_text(batch.column(2)), strict=True):
            counts[2 * (role == "u") + fold].update({e for w in words(text) for e in entries(w)})
            if sum(map(len, counts)) >= _HELD:
                yield out()
                for c in counts:
                    c.clear()
    if any(counts):
        yield out()


def _sampled(rows: DataFrame, n: int, salt: int):
    share = min(1.0, SAMPLE / max(1, n))
    return F.xxhash64("doc_id", F.lit(salt)).bitwiseAND(0x7FFFFFFF) < share * (1 << 31)


def _vocabulary(counts: DataFrame, p: str, u: str, positives: int, unlabelled: int, prior: float) -> dict[str, int]:
    """The bands of the entries that confirmed examples hold more often than chance and the prior explain."""
    if not positives or not unlabelled:
        return {}
    chance = F.expr(f"({u}) * {positives / unlabelled}D")
    known = counts.select("entry", F.expr(p).alias("p"), chance.alias("chance")).where("p >= 2")
    known = known.withColumn("z", (F.col("p") - F.col("chance")) / F.sqrt(F.col("chance") + 0.5))
    known = known.where((F.col("z") >= BANDS[0]) & (F.col("p") * prior >= LEAST * F.col("chance"))).orderBy(F.desc("z"), "entry").limit(LEXICON)
    found = {r["entry"]: (r["p"], r["z"]) for r in known.collect()}
    explained = set()  # a beginning says no more than the one longer entry that most of its examples hold
    for e, (held, _) in found.items():
        shorter = e[:-1][: PREFIXES[-1]] if e.endswith("$") else e[:-1]
        if held >= ONE_WORD * found.get(shorter, (np.inf, 0))[0]:
            explained.add(shorter)
    return {e: int(np.searchsorted(BANDS, z, side="right")) for e, (_, z) in found.items() if e not in explained}


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[Model, dict[str, int]] | None:
    """The network and the vocabulary of the learning folds; None if they hold no confirmed example.

    A document is a confirmed example if one of its labels is 1. Rows without an id teach nothing; null
    labels count as none; a null text is empty. Labels of 0 serve the class prior alone.
    """
    folded = (own(F.col("doc_id")) == 2).cast("int").alias("fold")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max((F.col("y") == 1).cast("int")).alias("y"))
    labelled, positives = known.agg(F.count("*"), F.sum("y")).first()
    if not positives:
        return None
    # the ids drawn are bounded: SAMPLE, give or take its root, of the confirmed and of the others
    drawn = known.where(F.when(F.col("y") == 1, _sampled(known, positives, 1)).otherwise(_sampled(known, labelled, 1)))
    taken = rows.join(F.broadcast(drawn), "doc_id", "left").withColumn("u", _sampled(rows, rows.count(), 2)).where("u OR y IS NOT NULL")
    roles = F.filter(F.array(F.when(F.col("y") == 1, "p"), F.when(F.col("y") == 0, "n"), F.when(F.col("u"), "u")), lambda r: r.isNotNull())
    keyed = in_batches(taken.select("doc_id", folded, roles.alias("roles"), "text"), _keyed, "doc_id long, fold int, roles array<string>, text string, key long")
    one = keyed.select("doc_id", "fold", F.explode("roles").alias("role"), "key", "text").groupBy("role", "key").agg(F.min_by(F.struct("fold", F.when(F.col("role") != "n", F.col("text")).alias("text")), F.struct("doc_id", F.xxhash64("text"))).alias("d"))
    one = written(one.select("role", "d.fold", "d.text"), "toxicity-sample")
    sizes = {(r["role"], r["fold"]): r["count"] for r in one.groupBy("role", "fold").count().collect()}
    of = lambda role, *folds: sum(sizes.get((role, f), 0) for f in folds)
    good, bad = of("p", 0, 1) * max(1.0, positives / SAMPLE), of("n", 0, 1) * max(1.0, labelled / SAMPLE)
    prior = min(0.9, good / max(1.0, good + bad))
    if not of("u", 0, 1):
        return None
    counts = written(in_batches(one.where("role != 'n'").select("role", "fold", "text"), _counted, "entry string, p0 long, p1 long, u0 long, u1 long").groupBy("entry").agg(*(F.sum(c).alias(c) for c in ("p0", "p1", "u0", "u1"))).where("p0 + p1 >= 2"), "toxicity-counts")
    half = [_vocabulary(counts, f"p{f}", f"u{f}", of("p", f), of("u", f), prior) for f in (0, 1)]
    whole = _vocabulary(counts, "p0 + p1", "u0 + u1", of("p", 0, 1), of("u", 0, 1), prior)

    def described(batches):
        other = [_Evidence(half[1]), _Evidence(half[0])]
        for batch in batches:
            x = [features(t, other[f]) for f, t in zip(batch.column(1).to_pylist(), each_text(batch.column(2)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["role", "x"])

    found = in_batches(one.where("role != 'n'").select("role", "fold", "text"), described, "role string, x array<double>").collect()
    p, u = (np.array(sorted(r["x"] for r in found if r["role"] == role)).reshape(-1, WIDTH) for role in "pu")
    return (fit(p, u, prior), whole) if len(p) and len(u) else None


def scored(docs: DataFrame, model: tuple[Model, dict[str, int]] | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted (score at or above the threshold) for each row of docs.

    Null texts count as empty and get a score as others do. Without a model every score is 0. Rows are
    judged alone and whole, however long: repeated rows get equal scores, a null id is carried along and
    not held out; an empty table gives an empty result; other columns, whatever their names, are not
    looked at.
    """

    def score(batches):
        network, evidence = (model[0], _Evidence(model[1])) if model else (None, None)
        for batch in batches:
            x = [features(t, evidence) for t in each_text(batch.column(2))] if network else []
            s = network.score(np.array(x)) if x else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return in_batches(rows, score, "doc_id long, held_out boolean, score double, predicted int")


def op11_toxicity_pu(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scored(docs, learned(docs, labels))
