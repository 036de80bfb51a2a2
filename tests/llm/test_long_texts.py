"""Very long texts go through every document operator whole."""

import pytest
from pyspark.sql import functions as F

from tallyguard.llm import jaccard, langid, mixing, packing, pii, quality, syncmers, toxicity


@pytest.fixture(scope="module")
def long_docs(spark):
    words = " ".join(f"word{i % 5003} of a very long text." for i in range(60_000))
    rows = [(1, words, "en", "a", len(words)), (2, "x" * 1_500_000, "en", None, 1_500_000), (3, "the cat and the dog " * 20, None, "b", 400), (4, words + " end", "en", "a", len(words) + 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def test_packing(long_docs):
    out = packing.pack(long_docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert len(out) == 4 and all(r.n == r["all"] for r in out) and max(r.n for r in out) > 300_000


def test_pii_quality_and_mixing(long_docs):
    assert pii.find_pii(long_docs).where("spans <> ''").count() == 0
    rows = {r.doc_id: r for r in quality.judge_quality(long_docs).drop("cleaned").collect()}
    assert rows[1].n_words == 360_000 and rows[2].n_words == 1 and rows[2].word_chars == 1_500_000
    assert {r.doc_id: r.size for r in mixing.mix(long_docs).collect()}[1] == 360_000


def test_near_duplicates(long_docs):
    got = {r.doc_id: r.class_id for r in jaccard.near_duplicates(long_docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 1}


def test_fingerprints_language_and_toxicity(spark, long_docs):
    near = {r.doc_id: r.near_edited for r in syncmers.fingerprints(long_docs, 2).select("doc_id", "near_edited").collect()}
    assert len(near) == 4 and near[1] > 0.3
    assert langid.predict_language(long_docs).where("lang_pred = 'en'").count() == 4
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(long_docs, labels).where("predicted = 0").count() == 4
