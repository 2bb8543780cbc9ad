"""Codes against plain integer Lloyd rounds and SQL; trees against comparing all points."""

import hashlib

import numpy as np
import pytest

from tests.test_registry import rows, sql
from triagelake.llm import product_codes
from triagelake.llm.queries import ORACLE_SQL, QUERIES


def plain(vectors, parts=8, entries=16, rounds=6):
    """vectors: (id, components, label), usable and of one length."""
    q = {}
    for at, (i, v, _) in enumerate(sorted(vectors, key=lambda r: (r[0] is None, r[0] or 0, r[1]))):
        q[at] = [int(np.floor(4096 * float(x))) for x in v]
    labels = [r[2] for r in sorted(vectors, key=lambda r: (r[0] is None, r[0] or 0, r[1]))]
    ids = [r[0] for r in sorted(vectors, key=lambda r: (r[0] is None, r[0] or 0, r[1]))]
    step = len(q[0]) // parts
    code, error, books = [""] * len(q), [0] * len(q), []
    for p in range(parts):
        mine = [q[k][p * step : (p + 1) * step] for k in range(len(q))]
        book = [list(x) for x in mine[:entries]]
        near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))  # noqa: B023, E731
        for _ in range(rounds):
            at = [near(x)[1] for x in mine]
            for k in range(len(book)):
                held = [x for x, a in zip(mine, at, strict=True) if a == k]
                if held:
                    book[k] = [sum(c) // len(held) for c in zip(*held, strict=True)]
        for k, x in enumerate(mine):
            d, entry = near(x)
            code[k] += f"{entry:02x}"
            error[k] += d
        books += [str(c) for e in book for c in e]
    sha = hashlib.sha256(",".join(books).encode()).hexdigest()
    return sorted(((i, c, e, sum(b for b, m in zip(error, labels, strict=True) if m == lab), sha) for i, c, e, lab in zip(ids, code, error, labels, strict=True)), key=str)


def got(spark, vectors, **options):
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label string, error long, code string")
    return sorted((tuple(r) for r in product_codes.codes(frame, **options).collect()), key=str)


def padded(vectors):
    return [(*r, 7, "clash") for r in vectors]


@pytest.mark.parametrize("salted", [False, True])
def test_against_plain_rounds(spark, monkeypatch, salted):
    monkeypatch.setattr(product_codes, "SHARD_ROWS", 100)
    if salted:
        monkeypatch.setattr(product_codes, "bounded", lambda rows: rows)
    rng = np.random.default_rng(2)
    vectors = [(k, [float(x) for x in rng.normal(size=16).round(3) * rng.choice([0.01, 1, 30])], str(k % 3) if k % 7 else None) for k in range(240)]
    vectors += [(1000 + k, [0.25] * 16, "0") for k in range(150)] + [(3, [0.5] * 16, None), (3, [0.5] * 16, None), (None, [-0.5] * 16, "x"), (-4, [0.25] * 8 + [-0.25] * 8, "1")]
    dropped = [(1, None, "0"), (2, [None] * 16, "0"), (4, [float("nan")] + [0.0] * 15, "0"), (5, [float("inf")] * 16, "0"), (6, [], "0"), (7, [1.0] * 8, "0")]
    assert got(spark, padded(vectors + dropped)) == plain(vectors)


def test_few_rows_and_odd_sizes(spark):
    few = [(5, [0.1 * k for k in range(8)], "a"), (2, [0.0] * 8, None)]
    assert got(spark, padded(few)) == plain(few)
    assert got(spark, []) == [] and got(spark, padded([(1, [1.0] * 7, "a")])) == [] and got(spark, padded([(1, None, "a")])) == []
    huge = got(spark, padded([(1, [1e300] * 8, "a"), (2, [-1e300] * 8, "a"), (3, [0.0] * 8, "b")]))
    assert len(huge) == 3 and all(0 <= r[2] <= r[3] for r in huge)


@pytest.mark.parametrize("spread", [1, 50, 4000])
def test_trees_cover_and_decide_as_all_comparisons(spread):
    rng = np.random.default_rng(spread)
    centres = rng.integers(-4000, 4000, (40, 6))
    points = centres[rng.integers(0, 40, 3000)] + rng.integers(-spread, spread + 1, (3000, 6))
    tree = product_codes.grown(points)
    assert sorted(tree.order) == list(range(3000)) and (tree.points == points[tree.order]).all()
    for c, s, e, r, a, b in zip(tree.centre, tree.start, tree.end, tree.radius, tree.first, tree.last, strict=True):
        inside = np.sqrt(product_codes._distances(tree.points[s:e], tree.points[c : c + 1]).astype(float))
        assert (inside <= r).all() and s <= c < e
        if a < b:
            assert tree.start[a] == s and tree.end[b - 1] == e and (tree.start[a + 1 : b] == tree.end[a : b - 1]).all()
    book = centres[:16].copy()
    book[7] = book[3]  # a tie that only the order of entries settles
    nodes, alone, compared = product_codes.assigned(tree, book)
    entry = np.full(3000, -1)
    entry[product_codes._ranges(nodes[:, 0], nodes[:, 1])] = np.repeat(nodes[:, 2], nodes[:, 1] - nodes[:, 0])
    entry[alone[:, 0]] = alone[:, 1]
    assert (entry == product_codes._distances(tree.points, book).argmin(axis=1)).all()
    if spread == 50:
        assert compared < 1500


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_whole_tables(spark, sf):
    data = f"/root/testdata/{sf}"
    assert rows(QUERIES["op13_product_codes"](spark, data).toPandas()) == rows(sql(ORACLE_SQL["op13_product_codes"], data))
