"""Stages of the pipeline on odd rows, clashing column names and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from triagelake.llm import quality_pu

DATA = "/root/testdata/sf0.001"
NAMES = ("gone_id", "repeated_id", "repeat_id", "repeat_mark", "repeat_places", "mark", "places", "kept", "rows", "cut", "component_id", "__cut")


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[1:4]])
def test_stages_keep_clashing_columns_and_empty_tables(spark, odd, empty, stage):
    wide = odd.withColumns({name: F.lit(7) for name in NAMES})
    out = stage(spark, wide, DATA)
    assert out.columns == wide.columns and all(r["gone_id"] == r["kept"] == 7 for r in out.collect())
    assert sum(r["doc_id"] is None for r in out.collect()) == 1
    assert stage(spark, empty, DATA).count() == 0


def test_classifier_without_a_model_keeps_every_row(odd, empty):
    wide = odd.withColumns({name: F.lit(7) for name in NAMES})
    assert quality_pu.accepted(wide, None).count() == 14 and quality_pu.accepted(empty, None).count() == 0
