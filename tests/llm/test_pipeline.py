"""The pipeline's stages one after the other on the smallest tables, and on rows that are hard."""

import os

import pytest

import corpus_pipeline
from bodygrid.llm.common import stored, table

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF))
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert before >= counts[0] >= counts[1] >= counts[2] > 0
    got = corpus_pipeline.packing_stage(spark, docs, SF)
    assert got.filter("piece = 0").count() == counts[3]
    assert corpus_pipeline.run(spark, SF).count() == got.count()


def test_copies_without_ids_leave_one_row(spark):
    rows = [(1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (None, "c", None, None, None), (None, "c", None, None, None), (2, "a  b", "en", "t", 4), (1, "other", "en", "s", 5)]
    docs = stored(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    got = corpus_pipeline.exact_stage(spark, docs, "")
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "c"), (1, "a b"), (1, "other")]
    assert corpus_pipeline.near_stage(spark, docs, "").count() >= 3


def test_stages_keep_empty_tables_and_columns_with_their_own_names(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, quality string, text_sha256 string, copies int, row string, kept boolean"
    empty = stored(spark.createDataFrame([], schema))
    long = "a house by the river where many people " * 4000
    rows = [(1, long, "en", "s", 1, "q", "x", 2, "r", False), (2, long + " end", "en", "s", 1, "p", "x", 2, "r", True), (3, None, "en", None, 0, "o", "x", 2, "r", True)]
    docs = stored(spark.createDataFrame(rows, schema))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, SF).columns == empty.columns and stage(spark, empty, SF).count() == 0, name
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        assert all(r.quality in "qpo" and r.text_sha256 == "x" and r.copies == 2 and r.row == "r" for r in got.collect()), name
    assert corpus_pipeline.packing_stage(spark, empty, SF).count() == 0
    assert corpus_pipeline.near_stage(spark, docs, SF).count() == 2
