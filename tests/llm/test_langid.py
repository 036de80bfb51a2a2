"""Code lengths by the definition, and held-out accuracy."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyguard.llm import langid

DATA = "/root/testdata/sf0.01/documents.parquet"


def brute(counts, context, symbol):
    """Probability by the escape method, one order after the other."""
    n = counts.shape[0]

    def p(context):
        if context is None:
            return np.full(n, 1 / n)
        c = counts[(slice(None),) * (counts.ndim - 1 - len(context)) + tuple(context)]
        c = c.reshape(-1, n).sum(0) if c.ndim > 1 else c
        lower = p(context[1:] if context else None)
        if not c.sum():
            return lower
        seen, q = c > 0, (c > 0).sum()
        if seen.all():
            return c / c.sum()
        return np.where(seen, c / (c.sum() + q), q / (c.sum() + q) * lower / lower[~seen].sum())

    return p(list(context))[symbol]


def test_code_lengths():
    rng = np.random.default_rng(5)
    n = 4
    counts = rng.integers(0, 3, (n,) * 4) * (rng.random((n,) * 4) < 0.3)
    bits = langid.code_lengths(counts.astype(np.float32))
    assert np.allclose((2.0**-bits).sum(-1), 1)
    for at in np.ndindex(*counts.shape):
        assert bits[at] == pytest.approx(-np.log2(brute(counts, at[:-1], at[-1])))


def test_sparse_trees_over_all_bytes():
    rng = np.random.default_rng(6)
    data = rng.choice(np.array([32, 97, 98, 195, 224, 255], np.uint8), 300)
    grams, counts = np.unique(langid.packed(data), return_counts=True)
    orders = langid.tree(grams.astype(np.int64), counts.astype(float))

    def p(context):
        """Of all 256 bytes after a context, by the definition."""
        c = np.zeros(256)
        for g, n in zip(grams.tolist(), counts, strict=True):
            if g.to_bytes(4, "big")[3 - len(context) : 3] == context:
                c[g % 256] += n
        lower = p(context[1:]) if context else np.full(256, 1 / 256)
        if not c.sum():
            return lower
        q = (c > 0).sum()
        return np.where(c > 0, c / (c.sum() + q), q / (c.sum() + q) * lower / lower[c == 0].sum())

    for context in (b"ab ", b"a\xc3b", b"\xff\xe0a", b"zzz", b"z\xc3\xff"):
        wanted = np.arange(256, dtype=np.uint32) | np.uint32(int.from_bytes(context, "big") << 8)
        assert np.allclose(2.0 ** -langid.bits_of(orders, wanted), p(context), rtol=1e-4)
    assert np.allclose(langid.bits_of(langid.tree(grams[:0].astype(np.int64), np.zeros(0)), grams), 8)


def test_scripts_beside_many_languages(spark):
    rng = np.random.default_rng(7)

    def text(letters):
        return " ".join("".join(rng.choice(list(letters), 5)) for _ in range(12))

    rows = [(f"l{k:02}", text("abcdefghijklmnopqrstuvwxyz")) for k in range(40) for _ in range(6)]
    rows += [(lang, text(letters)) for lang, letters in (("x1", "กขฃคฅฆ"), ("x2", "งจฉชซฌ")) for _ in range(12)]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict_language(df).collect()}
    assert all(got[i] == lang for i, (lang, _) in enumerate(rows) if lang.startswith("x"))


def test_edge_cases(spark):
    rows = [(i, "the cat and the dog " * 3, "en") for i in range(8)] + [(i, "der hund und die katze " * 3, "de") for i in range(8, 16)]
    rows += [(20, None, "en"), (21, "", None), (22, "123 ... 456", "de"), (None, "the dog", None), (23, "die katze", None), (23, "die katze", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    got = [(r.doc_id, r.lang_pred) for r in langid.predict_language(df).collect()]
    assert len(got) == len(rows)
    assert {x for x in got if x[0] is None or x[0] >= 20} == {(20, "und"), (21, "und"), (22, "und"), (None, "en"), (23, "de")}
    assert langid.predict_language(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    pred = langid.predict_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = pred.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    print("held-out accuracy", right, n)
    assert right > 0.97
