"""Checks and lookups on small rows: nulls, empty texts, ties."""

import pytest
from pyspark.sql import functions as F

from tallyguard.functions import checks as C
from tallyguard.functions.ids import us_phone
from tallyguard.operators import lookups as L


def values(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    return [r[0] for r in rows.select(column(F.col("x")).alias("v"), "i").orderBy("i").select("v").collect()]


def test_amounts(spark):
    texts = ["(1,234.50)", "$ 12", " 1 000.5 ", "-7", "1-2", "(-)", "", None]
    assert values(spark, texts, C.signed_amount) == [-1234.5, 12.0, 1000.5, -7.0, None, None, None, None]
    assert values(spark, ["Due 1,200.50 of 99", ",", "none", None], C.largest_amount) == [1200.5, None, None, None]


def test_letters_set_apart(spark):
    texts = ["A m o u n t", "A m o u n t due x y z", "Amount due", "A b", "", None]
    assert values(spark, texts, C.unspaced) == ["Amount", "Amount due xyz", "Amount due", "A b", "", None]


def test_confidences(spark):
    texts = ["HIGH", " 70% ", "85", "0.4", "-1", "many", "", None]
    assert values(spark, texts, lambda x: C.confidence(x, 0.2)) == pytest.approx([0.9, 0.7, 0.85, 0.4, 0.0, 0.2, 0.2, 0.2])
    assert values(spark, ["250%", "70%", "70", "x", None], C.rule_score) == pytest.approx([0.025, 0.7, 0.7, 0.5, 0.5])


def test_lines_and_dates(spark):
    texts = ["a  b\nc\td\n \t \nplain", "a  b", "", None]
    assert values(spark, texts, lambda x: C.wide_lines(x)["score"]) == [0.2, 0.0, 0.0, 0.0]
    assert values(spark, texts, lambda x: C.wide_lines(x)["evidence"]) == ["a  b|c\td", None, None, None]
    dates = ["25/03/2024", "03/25/2024", "2024-25-03", None]
    assert values(spark, dates, lambda x: C.day_first_dates(F.array(x, x, x))["score"]) == [0.2, 0.0, 0.0, 0.0]


def test_us_phones(spark):
    texts = ["+1 (212) 555-0134", "112-555-0134", "2125550", "2222255555", "", None]
    assert values(spark, texts, lambda x: us_phone(x)["confidence"]) == pytest.approx([1.0, 0.6, 0.5, 0.5, 0.0, 0.0])


def test_lookups(spark):
    rows = spark.createDataFrame([(1, "XXX"), (2, "EUR"), (3, None)], "id int, currency string")
    more = [("XXX", "B", False, 2.0), ("XXX", "C", False, 3.0), ("XXX", "A", True, 0.1)]
    found = {r["id"]: r["countries"] for r in L.countries_of(rows, L.currency_countries(spark, more)).collect()}
    assert found[1] == ["A", "C", "B"] and found[2][0] == "AT" and found[3] is None
    log = spark.createDataFrame([("p", 2, "fake", 0.9), ("p", 1, "real", None), ("q", 3, None, 0.1), (None, 1, "real", 0.5)], "file_path string, position int, label string, score double")
    asked = spark.createDataFrame([("p",), ("q",), ("none",), (None,)], "analysis_id string")
    got = {r["analysis_id"]: (r["engine_label"], r["engine_score"]) for r in L.first_decision(asked, log).collect()}
    assert got == {"p": ("real", 0.0), "q": (None, 0.1), "none": (None, None), None: (None, None)}
    assert L.first_decision(asked.limit(0), log).count() == 0
