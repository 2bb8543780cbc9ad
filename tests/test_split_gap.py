"""The gap between the splits of scored repositories, with and without denominators."""

from triagelake.operators import truth

SCHEMA = "repo_id string, split string, tp long, fp long, fn long, supported_tp long, false_support long, candidate_tp long, candidate_fn long"


def gap(spark, *rows):
    return tuple(truth.split_gap(spark.createDataFrame([(str(n), *r) for n, r in enumerate(rows)], SCHEMA)).first())


def test_gap(spark):
    even = (8, 2, 2, 8, 2, 8, 2)
    assert gap(spark, ("tuning", *even), ("held-out", *even), ("canary", 0, 9, 9, 0, 9, 0, 9)) == (0.0, True)
    assert gap(spark, ("tuning", *even), ("held-out", 4, 1, 1, 4, 1, 2, 3), ("held-out", 4, 1, 1, 4, 1, 6, 3)) == (0.8 - 8 / 14, False)
    assert gap(spark, ("tuning", *even), ("held-out", 8, 2, 2, 0, 0, 8, 2)) == (None, False)
    assert gap(spark, ("tuning", *even)) == (None, False) and gap(spark) == (None, False)
