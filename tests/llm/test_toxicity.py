"""The toxicity classifier on planted vocabulary, odd rows, and held-out labels."""

from triagelake.llm import toxicity_pu
from triagelake.llm.queries import QUERIES


def test_held_out_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = QUERIES["op11_toxicity_pu"](spark, "/root/testdata/sf0.1")
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 10_000
    seen = got.join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").toPandas()
    toxic = seen["toxic"] == 1
    assert seen["score"].between(0, 1).all() and ((seen["score"] >= 0.7) == (seen["predicted"] == 1)).all()
    assert seen[toxic]["predicted"].mean() > 0.88 and seen[~toxic]["predicted"].mean() < 0.02


def planted(spark, copies=1):
    """A clean language, a toxic stem with changing endings, and one long toxic text that is copied."""
    docs, labels = [], []
    for k in range(900):
        words = [f"w{(k * 7 + j * j * 13) % 311}" for j in range(40)]
        toxic = k % 9 == 0
        if toxic:
            words[k % 40] = "vilest" + "abcdefgh"[k % 8] + "xyz"[k % 3]
        docs.append((k, " ".join(words)))
        labels += [(k, int(toxic))] if k % 2 else []
    hot = " ".join(f"only{j}" for j in range(60)) + " vilestax"
    docs += [(10_000 + k, hot) for k in range(copies)]
    labels += [(10_000 + k, 1) for k in range(copies)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_stems_are_learned_and_copies_count_once(spark):
    docs, labels = planted(spark, copies=400)
    model = toxicity_pu.learned(docs, labels)
    asked = spark.createDataFrame([(1, "w1 w2 w3 vilestqq w5"), (2, "w1 w2 w3 w4 w5"), (3, "only3 only4 only5 w1 w2 w7"), (4, None)], "doc_id long, text string")
    assert [r["predicted"] for r in toxicity_pu.scored(asked, model).orderBy("doc_id").collect()] == [1, 0, 0, 0]


def test_a_beginning_is_not_blamed_for_one_word(spark):
    docs = spark.createDataFrame([(k, ("worthless " if k % 9 == 0 else "") + " ".join(f"w{(k + j) % 90}" for j in range(30))) for k in range(900)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 9 == 0)) for k in range(0, 900)], "doc_id long, toxic int")
    _, bands = toxicity_pu.learned(docs, labels)
    assert "worthless$" in bands and not {"wor", "wort", "worth", "worthl"} & set(bands)


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (5, 0), (1, 1)], "doc_id long, toxic int")
    assert toxicity_pu.learned(empty, labels.limit(0)) is None and toxicity_pu.learned(odd, labels.where("toxic = 0")) is None
    for model in (None, toxicity_pu.learned(*planted(spark)), toxicity_pu.learned(odd, labels)):
        got = toxicity_pu.scored(odd, model).collect()
        assert len(got) == 14 and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] == 7}) == 1 and not [r for r in got if r["doc_id"] is None and r["held_out"]]
        assert toxicity_pu.scored(empty, model).count() == 0
