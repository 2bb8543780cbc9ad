"""Product quantisation codes of vectors by Lloyd's rounds over cover trees, in integers.

Vectors become integers, floor(4096 * x), and are cut into equal parts. Spark deals them into shards, and
each shard builds one cover tree for each part position, once: the points are laid in tree order, so that a
node is a range of them, its sum a difference of two cumulative sums, and its radius is measured. The trees
are written. A round reads them, settles a whole node where the triangle inequality shows that one codebook
entry is strictly nearest to all of it, lets only ambiguous nodes descend, and compares the points of
ambiguous leaves exactly. Per shard, part and entry one row of counts and sums leaves the worker; Spark adds
them, and what reaches the driver is one row for each part, entry and position.
"""

from __future__ import annotations

import dataclasses
import hashlib
import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, in_batches, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a shard at most; its trees are one row of the written table.
SHARD_ROWS = 4096
#: Points of a leaf at most, where they are not all equal; cover radii shrink by BASE from level to level.
LEAF, BASE = 16, 0.6
#: Bounds by distances hold with this relative slack; what is nearer to a tie is compared exactly.
SLACK = 1e-9
#: Shares that a label's total is joined over, where labels are too many to broadcast.
SALTS = 32


@dataclasses.dataclass
class Tree:
    order: np.ndarray  # row of the shard at each place
    points: np.ndarray  # the parts in that order
    sums: np.ndarray  # cumulative, one row more than points
    centre: np.ndarray  # of each node: place of its centre,
    start: np.ndarray  # the range of its points,
    end: np.ndarray
    radius: np.ndarray  # the largest distance from the centre to one of them,
    first: np.ndarray  # the range of its children; none for a leaf
    last: np.ndarray


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared, exact in 64 bits: components are bounded (see integers)."""
    out = np.zeros((len(points), len(to)), np.int64)
    for k in range(points.shape[1]):
        out += (points[:, k, None] - to[None, :, k]) ** 2
    return out


def grown(points: np.ndarray) -> Tree:
    """The cover tree of these points: children of a node are centres further apart than the cover radius of their level, and every point is within it of its own."""
    order = np.arange(len(points))
    nodes: list[list] = []  # centre, start, end, radius, first, last

    def node(start: int, end: int, d: np.ndarray) -> int:
        """d: squared distances of the range's points to its first, which is the centre."""
        nodes.append([start, start, end, math.sqrt(int(d.max())), 0, 0])
        return len(nodes) - 1

    d = _distances(points, points[:1])[:, 0]
    queue = [(node(0, len(points), d), d)] if len(points) else []
    while queue:
        here, d = queue.pop()
        centre, start, end, radius, _, _ = nodes[here]
        if radius == 0 or end - start <= LEAF:
            continue
        limit = int((radius * BASE) ** 2)
        rest, groups = order[start:end], []
        while len(rest):  # the node's centre first, then the next point that no centre covers
            near = d <= limit
            groups.append((rest[near], d[near]))
            rest = rest[~near]
            if len(rest):
                d = _distances(points[rest], points[rest[:1]])[:, 0]
        at = start
        nodes[here][4] = len(nodes)
        for group, own in groups:
            order[at : at + len(group)] = group
            queue.append((node(at, at + len(group), own), own))
            at += len(group)
        nodes[here][5] = len(nodes)
    laid = points[order]
    table = np.array(nodes, float).reshape(-1, 6)
    whole = table[:, [0, 1, 2, 4, 5]].astype(np.int64)
    return Tree(order, laid, np.concatenate([np.zeros((1, points.shape[1]), np.int64), laid.cumsum(axis=0)]), whole[:, 0], whole[:, 1], whole[:, 2], table[:, 3] * (1 + SLACK), whole[:, 3], whole[:, 4])


def assigned(tree: Tree, codebook: np.ndarray):
    """(ranges, points): node ranges with their one nearest entry as (start, end, entry), and places decided alone as (place, entry).

    Also counts the points that were compared alone, last.
    """
    settled, alone, compared = [np.empty((0, 3), np.int64)], [np.empty((0, 2), np.int64)], 0
    front = np.arange(min(1, len(tree.centre)))
    while len(front):
        d = np.sqrt(_distances(tree.points[tree.centre[front]], codebook).astype(float))
        best = d.argmin(axis=1)
        one = d[np.arange(len(front)), best]
        d[np.arange(len(front)), best] = np.inf
        two = d.min(axis=1)
        radius = tree.radius[front]
        sure = one + 2 * radius + SLACK * (one + radius) < two  # strictly nearest for every point of the node
        settled.append(np.stack([tree.start[front][sure], tree.end[front][sure], best[sure]], axis=1))
        rest = front[~sure]
        leaf = tree.first[rest] == tree.last[rest]
        places = _ranges(tree.start[rest[leaf]], tree.end[rest[leaf]])
        if len(places):
            compared += len(places)
            alone.append(np.stack([places, _distances(tree.points[places], codebook).argmin(axis=1)], axis=1))  # ties to the lower index
        front = _ranges(tree.first[rest[~leaf]], tree.last[rest[~leaf]])
    return np.concatenate(settled), np.concatenate(alone), compared


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    lengths = ends - starts
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(4096 * x). A long holds the error of a vector whose components stay below a bound; larger ones are set to it."""
    most = math.isqrt((1 << 61) // max(1, vectors.shape[1]))
    return np.floor(SCALE * vectors).clip(-most, most).astype(np.int64)


def _packed(arrays: list[np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, *arrays)
    return out.getvalue()


def _unpacked(blob: bytes) -> list[np.ndarray]:
    with np.load(io.BytesIO(blob)) as z:
        return [z[f"arr_{k}"] for k in range(len(z.files))]


def _planted(width: int, parts: int):
    def plant(batches):
        held, size = [], 0

        def out():
            rows = pa.Table.from_batches(held)
            q = integers(np.array(rows.column(2).to_pylist(), float).reshape(-1, width))
            step = width // parts
            arrays = []
            for p in range(parts):
                t = grown(np.ascontiguousarray(q[:, p * step : (p + 1) * step]))
                arrays += [t.order, t.points, t.centre, t.start, t.end, t.radius, t.first, t.last]
            ids, labels = (pa.array([rows.column(k).to_pylist()], pa.list_(kind)) for k, kind in ((0, pa.int64()), (1, pa.string())))
            return pa.RecordBatch.from_arrays([ids, labels, pa.array([_packed(arrays)], pa.large_binary()).cast(pa.binary())], names=["ids", "labels", "trees"])

        for batch in batches:
            for at in range(0, batch.num_rows, SHARD_ROWS):
                part = batch.slice(at, SHARD_ROWS)
                if size + part.num_rows > SHARD_ROWS:
                    yield out()
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if size:
            yield out()

    return plant


def _trees(blob: bytes) -> list[Tree]:
    arrays = _unpacked(blob)
    trees = []
    for k in range(0, len(arrays), 8):
        order, points, centre, start, end, radius, first, last = arrays[k : k + 8]
        trees.append(Tree(order, points, np.concatenate([np.zeros((1, points.shape[1]), np.int64), points.cumsum(axis=0)]), centre, start, end, radius, first, last))
    return trees


def _added(codebooks: np.ndarray):
    """Counts and sums of a shard for each part and entry."""

    def add(batches):
        for batch in batches:
            for blob in batch.column(0):
                counts = np.zeros(codebooks.shape[:2], np.int64)
                sums = np.zeros(codebooks.shape, np.int64)
                for p, tree in enumerate(_trees(blob.as_py())):
                    nodes, alone, _ = assigned(tree, codebooks[p])
                    np.add.at(counts[p], nodes[:, 2], nodes[:, 1] - nodes[:, 0])
                    np.add.at(sums[p], nodes[:, 2], tree.sums[nodes[:, 1]] - tree.sums[nodes[:, 0]])
                    np.add.at(counts[p], alone[:, 1], 1)
                    np.add.at(sums[p], alone[:, 1], tree.points[alone[:, 0]])
                part, entry = np.nonzero(counts)
                step = codebooks.shape[2]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part, step).astype(np.int32)), pa.array(np.repeat(entry, step).astype(np.int32)), pa.array(np.tile(np.arange(step, dtype=np.int32), len(part))), pa.array(np.repeat(counts[part, entry], step)), pa.array(sums[part, entry].reshape(-1))],
                    names=["part", "entry", "at", "n", "total"],
                )

    return add


def _coded(codebooks: np.ndarray):
    def code(batches):
        for batch in batches:
            for ids, labels, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes, errors = np.zeros((len(ids), len(codebooks)), np.uint8), np.zeros(len(ids), np.int64)
                for p, tree in enumerate(_trees(blob)):
                    nodes, alone, _ = assigned(tree, codebooks[p])
                    entry = np.zeros(len(ids), np.int64)
                    entry[_ranges(nodes[:, 0], nodes[:, 1])] = np.repeat(nodes[:, 2], nodes[:, 1] - nodes[:, 0])
                    entry[alone[:, 0]] = alone[:, 1]
                    codes[tree.order, p] = entry
                    errors[tree.order] += ((tree.points - codebooks[p][entry]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors)], names=["vec_id", "label", "code", "error"])

    return code


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label (as text), v of the rows whose vector is not null and holds neither null nor a non-finite component."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    return rows.where("v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")


def codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row for each usable vector.

    A vector that is null, empty or holds null or non-finite components is dropped, and so is one whose
    length is not that of the vector with the smallest id; if that length is no multiple of `parts`, there
    are no rows. Codebooks start from the `entries` smallest ids (fewer, if there are fewer rows; of rows that
    repeat an id, smaller vectors first; rows without an id last). Distances that tie go to the lower entry.
    Components beyond what a long can hold errors for are set to that bound (integers), and sums of errors end at the largest
    long. Repeated rows count each time; null labels are one label; other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col, label_col)
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    ordered = [F.col("vec_id").asc_nulls_last(), "v"]
    least = rows.orderBy(*ordered).select(F.size("v").alias("width")).first()
    if least is None or least["width"] % parts:
        return spark.createDataFrame([], schema)
    width = least["width"]
    rows = rows.where(F.size("v") == width)
    seeds = np.array([r["v"] for r in rows.orderBy(*ordered).limit(entries).select("v").collect()], float)
    codebooks = np.ascontiguousarray(integers(seeds).reshape(len(seeds), parts, width // parts).swapaxes(0, 1))
    shards = max(spark.sparkContext.defaultParallelism, -(-rows.count() // SHARD_ROWS))
    trees = written(in_batches(rows.repartition(shards), _planted(width, parts), "ids array<long>, labels array<string>, trees binary"), "cover-trees")
    for _ in range(rounds):
        added = in_batches(trees.select("trees"), _added(codebooks), "part int, entry int, at int, n long, total long")
        added = added.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(19,0)")).alias("total"))
        codebooks = codebooks.copy()
        for r in added.collect():  # parts * entries * positions rows at most
            codebooks[r["part"], r["entry"], r["at"]] = int(r["total"]) // r["n"]
    sha = hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()
    coded = written(in_batches(trees, _coded(codebooks), "vec_id long, label string, code string, error long"), "codes")
    return _labelled(coded).select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _labelled(coded: DataFrame) -> DataFrame:
    """Adds label_error. Where labels are too many to broadcast, each total is dealt to SALTS keys, for one label may hold a third of the rows."""
    totals = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(19,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias("label_error"))
    totals = written(totals, "label-errors")
    few = bounded(totals)
    if few is not totals:
        return coded.join(few.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of")))
    totals = totals.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("at"))
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
    return coded.withColumn("salt", salt).join(totals, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("at")))


def op13_product_codes(spark, sf_dir: str) -> DataFrame:
    return codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """Six rounds written out one after another; integers are wide enough for the given vectors."""
    steps = [
        """
q AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS v FROM q, range(8) r(p)),
b0 AS MATERIALIZED (SELECT p, k, parts.v FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM q QUALIFY k < 16) s JOIN parts USING (vec_id))"""
    ]
    for n in range(7):
        steps.append(f"""
a{n} AS MATERIALIZED (SELECT * FROM (
  SELECT vec_id, label, parts.p, parts.v, k, list_sum(list_transform(range(1, len(parts.v) + 1), lambda i: (parts.v[i] - b.v[i]) * (parts.v[i] - b.v[i])))::BIGINT AS d FROM parts JOIN b{n} b ON b.p = parts.p)
  QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, k) = 1)""")
        if n < 6:
            steps.append(f"""
m{n} AS (SELECT p, k, list(m ORDER BY i) AS v FROM (
  SELECT p, k, i, (CASE WHEN s >= 0 THEN s // c ELSE -((c - 1 - s) // c) END)::BIGINT AS m FROM (SELECT p, k, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS c FROM (SELECT p, k, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{n}) GROUP BY p, k, i)) GROUP BY p, k),
b{n + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.v, b.v) AS v FROM b{n} b LEFT JOIN m{n} m ON m.p = b.p AND m.k = b.k)""")
    return (
        "WITH "
        + ",".join(steps)
        + """,
e AS (SELECT vec_id, label, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) FROM b6) AS codebooks_sha256 FROM e"""
    )


OP13_SQL = _sql()
