"""Nearest neighbours by inner product with one vantage-point tree for each shard.

With M the largest norm, a candidate x gets the coordinate sqrt(M^2 - |x|^2) and a query the coordinate 0;
the Euclidean distance then falls as the inner product grows, so the triangle inequality holds. A node of a
tree is a vantage point and the range of distances from it to each half; a query's lower bound for a leaf
is the largest bound on its way down. A query visits leaves by rising bound and stops where the bound times
`factor` exceeds the distance of its k-th neighbour so far. Factor 1 is exact; above 1 a search visits fewer
leaves and may miss some neighbours.

Candidates are dealt to shards of bounded size and queries to blocks of bounded size; a task holds one shard
and one block. Its k best for each query are merged by a window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEIGHBOURS, QUERY_EVERY, FACTOR = 20, 20, 1.0
SHARD_ROWS, BLOCK_QUERIES, LEAF = 4096, 4096, 128
#: What rounding may do to a distance, relative to the vectors' norms: bounds let this much more through.
SLACK = 1e-7


def _tree(points: np.ndarray, leaf: int):
    """Leaves (row numbers), vantage rows, and for each leaf its way: (node, nearest, farthest) per level."""
    leaves, vantages, ways = [], [], []
    stack = [(np.arange(len(points)), [])]
    while stack:
        rows, way = stack.pop()
        if len(rows) <= leaf:
            leaves.append(rows)
            ways.append(way)
            continue
        center = points[rows].mean(axis=0)
        at = rows[np.argmax(((points[rows] - center) ** 2).sum(axis=1))]  # far from the middle: it splits well
        apart = np.sqrt(((points[rows] - points[at]) ** 2).sum(axis=1))
        order = np.argsort(apart, kind="stable")
        half = len(rows) // 2
        node = len(vantages)
        vantages.append(at)
        for side in (order[half:], order[:half]):
            stack.append((rows[side], [*way, (node, apart[side].min(), apart[side].max())]))
    return leaves, vantages, ways


def search(ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float, largest: float, leaf: int = LEAF):
    """(query row, id, score) of the k best of each query among ids, and the share of leaves visited."""
    lifted = np.sqrt(np.maximum(0.0, largest**2 - (points**2).sum(axis=1)))
    leaves, vantages, ways = _tree(np.column_stack([points, lifted]), leaf)
    base = (queries**2).sum(axis=1) + largest**2
    scale = np.sqrt(base)
    away = lambda scores, rows: np.sqrt(np.maximum(0.0, base[rows, None] - 2 * scores))
    every = np.arange(len(queries))
    bound = np.zeros((len(queries), len(leaves)))
    if vantages:
        to = away(queries @ points[vantages].T, every)
        for n, way in enumerate(ways):
            for node, low, high in way:
                np.maximum(bound[:, n], np.maximum(low - to[:, node], to[:, node] - high), out=bound[:, n])
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full((len(queries), k), -np.inf)
    names = np.full((len(queries), k), np.iinfo(np.int64).max)
    rows, visited = every, 0
    for turn in range(len(leaves)):
        at = order[rows, turn]
        limit = np.where(np.isneginf(best[rows, -1]), np.inf, away(np.maximum(best[rows, -1:], -1e300), rows)[:, 0])
        go = bound[rows, at] * factor <= limit + SLACK * scale[rows]
        rows, at = rows[go], at[go]
        if not len(rows):
            break
        visited += len(rows)
        by = np.argsort(at, kind="stable")
        for some in np.split(by, np.flatnonzero(np.diff(at[by])) + 1):
            asked, members = rows[some], leaves[at[some[0]]]
            scores = _products(queries[asked], points[members])
            scores[query_ids[asked][:, None] == ids[members][None, :]] = -np.inf
            better = scores.max(axis=1) >= best[asked, -1]
            asked, scores = asked[better], scores[better]
            if len(asked):
                both = np.concatenate([best[asked], scores], axis=1)
                named = np.concatenate([names[asked], np.broadcast_to(ids[members], scores.shape)], axis=1)
                top = np.lexsort((named, -both), axis=1)[:, :k]
                best[asked], names[asked] = np.take_along_axis(both, top, 1), np.take_along_axis(named, top, 1)
    found = ~np.isneginf(best)
    return np.repeat(every, found.sum(axis=1)), names[found], best[found], visited / max(1, len(queries) * len(leaves))


def _products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products of all pairs, summed from the first component to the last, so that no blocking of the work changes a bit."""
    out = np.zeros((len(queries), len(points)))
    for d in range(points.shape[1]):
        out += queries[:, d, None] * points[None, :, d]
    return out


def _exact(ids, points, names, queries) -> np.ndarray:
    """Inner products summed from the first component to the last, the same wherever they are computed."""
    order = np.argsort(ids)
    rows = order[np.searchsorted(ids[order], names)]
    out = np.zeros(len(names))
    for d in range(points.shape[1]):
        out += queries[:, d] * points[rows, d]
    return out


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vector (array of double) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    usable = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL").where(usable)


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates with the largest inner product, nearest first.

    Scores are chosen unrounded, in double precision, however small or large the components are. Ties go to
    the smaller id; a query's own id is no candidate. Vectors that are null, empty, all zero or
    hold a null or a non-finite component, and rows without an id, take no part; only vectors of the same
    length are compared. Rows that repeat an id are answered once, by the first in sorted order. Empty
    tables give an empty result; other columns are not looked at.
    """
    points = valid(vectors, id_col, vector_col).groupBy("id").agg(F.min("vector").alias("vector"))
    asked = valid(queries, id_col, vector_col).groupBy("id").agg(F.min("vector").alias("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    n, largest = points.agg(F.count("*"), F.max(norm)).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked.count() // block_queries))
    largest = (largest or 0.0) * (1 + 1e-12)
    left = points.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.size("vector").alias("size"), "id", "vector")
    right = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.size("vector").alias("size"), "id", "vector")

    def one(candidates: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if candidates.empty or wanted.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        ids, x = candidates["id"].to_numpy(), np.stack(candidates["vector"].to_numpy())
        query_ids, q = wanted["id"].to_numpy(), np.stack(wanted["vector"].to_numpy())
        rows, names, _, _ = search(ids, x, query_ids, q, k, factor, largest)
        return pd.DataFrame({"query_id": query_ids[rows], "vec_id": names, "score": _exact(ids, x, names, q[rows])})

    by = ["shard", "block", "size"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(one, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_vp_search(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))
