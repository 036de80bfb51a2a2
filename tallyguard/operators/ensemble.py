"""Several extraction engines reconciled into one record and one verdict.

An engine's output is a column of its own, null where it gave none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Engines in order of trust with their weights (hundredths) by field, and the fields' weights.
PRIORITY = {
    "merchant": (("layoutlm", 40), ("donut", 35), ("donut_receipt", 25)),
    "total": (("layoutlm", 40), ("donut", 35), ("donut_receipt", 25)),
    "date": (("layoutlm", 40), ("donut_receipt", 30), ("donut", 30)),
}
FIELD_WEIGHTS = {"merchant": 40, "total": 40, "date": 20}
AGREEMENT_BOOST, MOST, DEFAULT = 20, 95, 70


def _values(field: str) -> list[Column]:
    return [F.col(f"{engine}_{field}") for engine, _ in PRIORITY[field]]


def converge(results: DataFrame) -> DataFrame:
    """The best engine's value of every field, its source and confidence, and the record's confidence."""
    out: dict[str, Column] = {}
    num, den = F.lit(0), F.lit(0)
    for field, engines in PRIORITY.items():
        values = _values(field)
        confidence = F.coalesce(*(F.when(v.isNotNull(), w) for v, (_, w) in zip(values, engines, strict=True)))
        if field == "total":
            known = F.filter(F.array(*values), lambda x: x.isNotNull())
            agree = (F.size(known) >= 2) & (F.size(F.array_distinct(known)) == 1)
            confidence = F.when(agree, F.least(F.lit(MOST), confidence + AGREEMENT_BOOST)).otherwise(confidence)
        out[field] = F.coalesce(*values)
        out[f"{field}_source"] = F.coalesce(*(F.when(v.isNotNull(), e) for v, (e, _) in zip(values, engines, strict=True)))
        out[f"{field}_confidence"] = confidence / 100.0
        num = num + F.coalesce(confidence, F.lit(0)) * F.when(confidence.isNotNull(), FIELD_WEIGHTS[field]).otherwise(0)
        den = den + F.when(confidence.isNotNull(), FIELD_WEIGHTS[field]).otherwise(0)
    score = F.coalesce(F.try_divide(num, den), F.lit(float(DEFAULT))) / 100.0
    return results.select("id", *(c.alias(k) for k, c in out.items()), score.alias("confidence"))


def _text_agreement(values: list[Column]) -> tuple[Column, Column]:
    """Points in tenths and whether the field counts: two equal 10, one 5."""
    known = F.filter(F.array(*(F.nullif(F.regexp_replace(F.lower(F.trim(v)), r"\s+", " "), F.lit("")) for v in values)), lambda x: x.isNotNull())
    n, distinct = F.size(known), F.size(F.array_distinct(known))
    return F.when(n == 0, 0).when(distinct < n, 10).when(n == 1, 5).otherwise(0), n > 0


def _amount_agreement(values: list[Column]) -> tuple[Column, Column]:
    known = F.filter(F.array(*values), lambda x: x.isNotNull())
    spread, most = F.array_max(known) - F.array_min(known), F.array_max(known)
    return F.when(F.size(known) == 0, 0).when(F.size(known) < 2, 5).when(spread == 0, 10).when(spread <= F.greatest(F.lit(0.5), most * 0.01), 8).otherwise(3), F.size(known) > 0


def _date_agreement(values: list[Column]) -> tuple[Column, Column]:
    known = F.filter(F.array(*values), lambda x: x.isNotNull())
    n, distinct = F.size(known), F.size(F.array_distinct(known))
    return F.when(n == 0, 0).when((n >= 2) & (distinct == 1), 10).when(n == 1, 5).otherwise(3), n > 0


def agreement(results: DataFrame) -> DataFrame:
    """How much the engines agree, 0 to 1: the mean over the fields that any engine gave."""
    fields = [_text_agreement(_values("merchant")), _amount_agreement(_values("total")), _date_agreement([F.col("layoutlm_date"), F.col("donut_receipt_date")])]
    points, n = sum((p for p, _ in fields), F.lit(0)), sum((F.when(k, 1).otherwise(0) for _, k in fields), F.lit(0))
    return results.select("id", F.coalesce(F.try_divide(points, n * 10), F.lit(0.0)).alias("agreement"))


def verdict(scored: DataFrame) -> DataFrame:
    """The final label, confidence and action of a scored record: hard failures, then strong rules, then the rules' label."""
    score, label, critical = F.col("score"), F.col("label"), F.col("n_critical")
    strong = (label == "fake") & ((score >= 0.85) | (critical >= 1))
    t = F.round(score * 2000).cast("int")  # whole half thousandths, so that both products are exact
    confidence = (
        F.when(F.col("hard_fail"), 186_000).when(strong, 170_000).when(label == "fake", F.least(F.lit(190_000), 120_000 + t * 35))
        .when(label == "real", F.least(F.lit(190_000), 100_000 + (2000 - t) * 45)).otherwise(130_000)
    )
    final = F.when(F.col("hard_fail") | strong, "fake").otherwise(label)
    action = F.when(final == "fake", "reject").when(final == "real", "approve").otherwise("human_review")
    return scored.select("id", final.alias("final_label"), (confidence / 200_000.0).alias("confidence"), action.alias("action"))
