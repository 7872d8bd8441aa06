"""Documents whose own columns have the names that operators use, letters, and ids with a long common start."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexspark.llm import imatch, lid, neardup

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
OWN = ("score", "accepted", "rejected", "margin", "lang_pred", "text_score", "_tid", "_best", "_leaks", "root")


@needs_tables
@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:4], ids=lambda s: s[0])
def test_stages_keep_columns_of_any_name(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    named = docs.withColumns({c: F.lit(-7.0) for c in OWN})
    out = stage[1](spark, named, SF)
    assert out.columns == named.columns
    rows = out.collect()
    assert {tuple(r[c] for c in OWN) for r in rows} == {(-7.0,) * len(OWN)}
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in stage[1](spark, docs, SF).collect())


def test_one_of_each_class_beside_clashing_columns(spark):
    words = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(3, words, "x"), (1, words + " end", "y"), (2, None, "z"), (4, "other text", "w")], "doc_id bigint, text string, _tid string")
    assert sorted((r.doc_id, r._tid) for r in neardup.keep_one(docs).collect()) == [(1, "y"), (2, "z"), (4, "w")]


def test_fingerprints_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"alpha beta{i % 3} gamma{i % 4}", "own", "mine") for i in range(20)], "doc_id bigint, text string, _lex string, _kept string")
    rows = imatch.fingerprint(docs, imatch.lexicon(docs, low=0, high=1)).collect()
    assert {(r._lex, r._kept) for r in rows} == {("own", "mine")} and len({r.fingerprint for r in rows}) >= 3


def test_ids_with_a_long_common_start_are_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 50)
    docs = spark.range(1000).select(F.format_string("document-%08d;,\"", "id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    sizes = [r["count"] for r in docs.groupBy(imatch._range_of(docs, "doc_id").alias("r")).count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 150
    rows = sorted(imatch.with_next(docs, "doc_id", "text", lambda d: d).collect())
    assert [r.next_text for r in rows] == [f"t{(i + 1) % 1000}" for i in range(1000)]


def test_signs_that_are_no_letters(spark):
    model = lid.LanguageModel(("de", "en"), (b"der die das und nicht " * 9, b"the and of that with " * 9))
    assert [lid.classify(model, x)[0] for x in ("² ½", "①②", "Ⅷ", "12 %", "", None)] == ["und"] * 6
    assert lid.classify(model, "12 % of that")[0] in ("de", "en")
