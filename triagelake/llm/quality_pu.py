"""Quality classification from trusted positives and unlabelled text (non-negative PU learning).

With class prior p, the risk p * E_P[l(g)] + max(0, E_U[l(-g)] - p * E_P[l(-g)]) of a small network g is
minimised over a bounded sample of positive and of unlabelled documents, with the sigmoid loss l. The prior
is the share of positives among the labelled documents of the learning folds. Features are shares of
characters and words of the whole text; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import dataclasses
import operator
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, each_text, held_out, in_batches

#: Positives, and unlabelled documents, in the learning sample at most (drawn by hashed id).
SAMPLE = 12_000
HIDDEN, STEPS, BATCH, RATE, DECAY, SEED = 24, 900, 1000, 0.01, 1e-4, 7
_PUNCTUATION = [ord(c) for c in string.punctuation]


def features(text: bytes) -> np.ndarray:
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(float)
    total = max(1.0, count.sum())
    words = text.split()
    n = max(1, len(words))
    letters, upper = count[65:91].sum() + count[97:123].sum(), count[65:91].sum()
    lines = text.split(b"\n")
    shares = [
        *(count[_PUNCTUATION] / n),
        count[48:58].sum() / n, upper / max(1.0, letters), count[128:].sum() / total, letters / total, count[10] / n,
        sum(map(operator.eq, words, words[1:])) / n, len(set(words)) / n, len(set(lines)) / len(lines),
    ]
    return np.array([*np.sqrt(np.minimum(shares, 4.0)), np.log1p(n) / 10, min(2.0, total / n / 10)])


WIDTH = len(features(b""))


@dataclasses.dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; 0.5 and more is positive."""
        a, b, c, d = self.layers
        g = np.tanh(((x - self.mean) / self.scale).clip(-8, 8) @ a + b) @ c + d
        return 1 / (1 + np.exp(-g.clip(-30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = SEED) -> Model:
    """Adam on the non-negative risk; where its second term is negative, the step lowers that term's excess instead."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    p, u = (((x - mean) / scale).clip(-8, 8) for x in (positive, unlabelled))
    layers = [rng.normal(0, p.shape[1] ** -0.5, (p.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    first, second = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers]
    for step in range(1, STEPS + 1):
        xp, xu = p[rng.integers(0, len(p), BATCH)], u[rng.integers(0, len(u), BATCH)]
        x = np.concatenate([xp, xu])
        h = np.tanh(x @ layers[0] + layers[1])
        s = 1 / (1 + np.exp(-(h @ layers[2] + layers[3]).clip(-30, 30)))  # l(-g) = s, l(g) = 1 - s
        slope, sp, su = s * (1 - s) / BATCH, s[:BATCH], s[BATCH:]
        negative = su.mean() - prior * sp.mean()
        if negative >= 0:
            d = np.concatenate([-2 * prior * slope[:BATCH], slope[BATCH:]])
        else:
            d = np.concatenate([prior * slope[:BATCH], -slope[BATCH:]])
        back = np.outer(d, layers[2]) * (1 - h * h)
        for k, grad in enumerate((x.T @ back, back.sum(axis=0), h.T @ d, d.sum())):
            grad = grad + DECAY * layers[k]
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad * grad
            layers[k] = layers[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, tuple(layers), prior)


def _featured(batches):
    for batch in batches:
        rows = [features(t) for t in each_text(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])


def _sampled(rows: DataFrame, n: int, salt: int) -> DataFrame:
    share = min(1.0, SAMPLE / max(1, n))
    return rows.where((F.xxhash64("doc_id", F.lit(salt)).bitwiseAND(0x7FFFFFFF)) < share * (1 << 31))


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """The model of the learning folds; None if they hold no positive.

    A document is positive if its labels, nulls aside, are all 1. Rows without an id teach nothing.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    labelled, positives = known.agg(F.count("*"), F.count_if(F.col("y") == 1)).first()
    if not positives:
        return None
    ids = _sampled(known.where("y = 1"), positives, 1).select("doc_id")  # SAMPLE ids, give or take its root

    def matrix(sample: DataFrame) -> np.ndarray:
        found = sorted(in_batches(sample.select("doc_id", "text"), _featured, "doc_id long, x array<double>").collect(), key=lambda r: (r["doc_id"], r["x"]))
        return np.array([r["x"] for r in found]).reshape(-1, WIDTH)

    positive = matrix(rows.join(F.broadcast(ids), "doc_id", "left_semi"))
    unlabelled = matrix(_sampled(rows, rows.count(), 2))
    return fit(positive, unlabelled, positives / labelled) if len(positive) and len(unlabelled) else None


def _score_of(model: Model | None, column) -> np.ndarray:
    rows = [features(t) for t in each_text(column)]
    return model.score(np.array(rows)) if model is not None and rows else np.full(len(rows), 0.5)


def scored(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Null texts count as empty and get a score as others do. Without a model every score is 0.5. Rows are
    judged alone and whole, however long: repeated rows get equal scores, a null id is carried along and not held out; an empty
    table gives an empty result; other columns are not looked at.
    """

    def score(batches):
        for batch in batches:
            s = _score_of(model, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return in_batches(rows, score, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns whatever their names, that the model does not reject.

    Only texts go to Python workers, and a truth value comes back. Null texts count as empty; without a
    model every row stays; rows without an id and repeated rows are judged as others; an empty table stays
    empty.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        return pa.array(_score_of(model, text) >= 0.5)

    return docs.where(good(F.col(text_col).cast("string")))


def op10_quality_pu(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scored(docs, learned(docs, labels))
