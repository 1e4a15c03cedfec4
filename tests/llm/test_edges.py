"""Clashing columns, very long texts, ties and empty tables, over several operators and the stages."""

import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from eluent.llm import common, decontam, mixing, rollups, substring

CLASHES = ["_words", "_copies", "_doc_id", "_id", "_id_", "language", "_of", "_source", "_n", "_copy", "component_id", "item_id", "h", "size", "copies"]


@pytest.fixture(scope="module")
def clashing(spark):
    text = lambda k: " ".join(f"{a}{b}" for a in ("the", "water", "house", "river") for b in f"{k}abcdefghij")
    rows = [(k, text(k), "en", "s") for k in range(8)] + [(1, text(1), "en", "s"), (9, text(3), "en", None), (None, "no id at all here", "en", "s"), (10, None, None, None), (11, "", "en", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id"), F.lit(-1))) for c in CLASHES})


def whole(docs, rows):
    assert rows and set(rows) <= {tuple(r) for r in docs.collect()}


def test_columns_that_clash_stay_as_they_are(spark, clashing, tmp_path):
    out = mixing.mix(clashing)
    assert out.columns == clashing.columns
    whole(clashing, [tuple(r) for r in out.collect()])
    items = spark.createDataFrame([(0, clashing.where("doc_id = 2").first()["text"], "x")], "item_id long, text string, _id string")
    out = decontam.clean(clashing, items)
    assert out.columns == clashing.columns and out.where("doc_id = 2").isEmpty() and out.where("doc_id is null").count() == 1
    whole(clashing, [tuple(r) for r in out.collect()])
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = clashing
    for _, stage in cp.STAGES[:4]:
        docs = common.saved(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == clashing.columns
        whole(clashing, [tuple(r) for r in docs.collect()])
    assert docs.where("doc_id in (2, 9)").isEmpty()


def test_texts_of_a_million_characters(spark, docs_of):
    long = "some words, that go on. " * 42_000
    docs = docs_of([(1, long), (2, "x" * 1_000_000), (3, long + "end"), (4, "short text of a few words only and some more of them here")]).withColumn("lang", F.lit("en"))
    item = spark.createDataFrame([(1, " ".join(long.split()[:60]))], "item_id long, text string")
    labels = spark.createDataFrame([(3, 0, 1)], "doc_id long, quality int, toxic int")
    for run in (lambda: mixing.decisions(docs), lambda: decontam.leaks(docs, item), lambda: substring.dedup(docs), lambda: rollups.history(docs, labels)):
        began = time.time()
        assert run().count() > 0
        assert time.time() - began < 60


def test_empty_tables_and_repeated_labels(spark, docs_of):
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (None, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    assert rollups.history(docs_of([]), labels).count() == 0
    docs = docs_of([(1, "a b."), (2, "c , d"), (2, "c , d"), (3, None), (None, "x")])
    got = {(r["tokenizer"]): (r["docs"], r["tokens"]) for r in rollups.history(docs, labels).collect()}
    assert got == {"words-1": (4, 7), "words-2": (5, 7)}  # the first is labelled toxic once
    assert rollups.history(docs, labels.limit(0)).where("tokenizer = 'words-1'").first()["docs"] == 5
