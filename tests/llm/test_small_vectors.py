"""Nearest neighbours at any scale, of odd tables, and the registered query's ranks, scores and ties."""

import numpy as np
import pytest

from triagelake.llm import vp_search
from triagelake.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, rank int, score string"


def score(a, b):
    out = 0.0
    for x, y in zip(a, b, strict=True):
        out += x * y
    return out


def plain(rows, queries, k):
    kept = {}
    for i, v in sorted(rows, key=lambda r: (r[0], r[1])):
        kept.setdefault(i, v)
    out = []
    for q in sorted(set(queries)):
        found = sorted(((score(kept[q], v), i) for i, v in kept.items() if i != q), key=lambda r: (-r[0], r[1]))[:k]
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(found)]
    return out


def got(spark, rows, every, k, **options):
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in vp_search.nearest(frame, frame.where(f"vec_id % {every} = 0"), k=k, **options).collect())


@pytest.mark.parametrize("scale", [1e-150, 1e-8, 1.0, 1e8, 1e120])
def test_any_scale(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) * scale for x in v]) for k, v in enumerate(rng.normal(size=(150, 6)))]
    rows += [(200 + k, [scale, 0.0, 0.0, 0.0, 0.0, 0.0]) for k in range(9)]
    assert got(spark, rows, 10, 5, shard_rows=64) == plain(rows, [i for i, _ in rows if i % 10 == 0], 5)


def test_small_steps(spark):
    rows = [(k, [1e-8 * (k + 1), 1e-9]) for k in range(60)]
    assert [r[2] for r in got(spark, rows, 60, 5)] == [59, 58, 57, 56, 55]


def test_odd_tables(spark):
    assert got(spark, [], 1, 3) == [] and got(spark, [(0, [1.0, 2.0])], 1, 3) == []
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [2.0, 1.0]), (1, [0.5, 9.0]), (2, [1.0, 2.0])]
    assert got(spark, rows, 1, 3) == plain(rows, [0, 1, 2], 3)


def test_relaxed_factor_keeps_its_recall():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 8))[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 8)) * 0.3
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    ids, largest = np.arange(3000), float(np.sqrt((x**2).sum(axis=1)).max()) * (1 + 1e-12)
    asked = ids[::50]
    want = vp_search.search(ids, x, asked, x[asked], 10, 1.0, largest, leaf=32)
    loose = vp_search.search(ids, x, asked, x[asked], 10, 1.5, largest, leaf=32)
    pairs = lambda r: set(zip(r[0].tolist(), r[1].tolist(), strict=True))
    assert len(pairs(want) & pairs(loose)) / len(pairs(want)) >= 0.9 and loose[3] < want[3] < 0.3


def test_registered_query(spark):
    data = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op3_vp_search"](spark, data).collect()) == plain(rows, [i for i, _ in rows if i % 20 == 0], 20)
