"""Rules over a receipt record: an ordered registry, events, score and label.

A rule is a condition, a severity and a weight, each a column. All rules are
evaluated in one projection; their events keep the registry's order. Weights
are hundredths or their halves, so that a score is an exact sum of half
thousandths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Factor of every event but a hard failure, in tenths, and the labels' limits, in thousandths.
SOFT_TENTHS, FAKE, SUSPICIOUS = 7, 700, 350

# Producers by risk, expected rates by country, subtypes, slabs.
HIGH_RISK = ("canva", "photoshop", "illustrator", "sketch", "figma", "affinity", "gimp", "inkscape", "coreldraw", "pixlr", "fotor", "befunky", "snappa", "crello", "desygner")
MEDIUM_RISK = ("wps", "ilovepdf", "smallpdf", "pdfcandy", "sejda")
TAX_RANGES = {"US": (0.0, 12.0), "IN": (4.5, 30.0), "GB": (0.0, 22.0), "CA": (4.5, 16.0), "AU": (9.0, 11.0), "AE": (4.5, 6.0), "SA": (14.0, 16.0), "DE": (0.0, 21.0), "FR": (0.0, 22.0)}
ROUND_BY_HUNDREDS = ("IN", "JP", "KR", "ID")
ROUND_EXEMPT = ("PARKING", "TOLL", "SUBSCRIPTION", "MEMBERSHIP", "DONATION", "RENT", "UTILITY", "INSURANCE")
ROUND_SUSPICIOUS = ("FUEL", "POS_RESTAURANT", "POS_RETAIL", "GROCERY", "PHARMACY")
GST_SLABS = (0.0, 5.0, 12.0, 18.0, 28.0)
TO_USD = {
    "IN": 0.012, "JP": 0.0067, "KR": 0.00075, "ID": 0.000063, "TH": 0.028, "MY": 0.22, "PH": 0.018, "VN": 0.000041, "PK": 0.0036, "BD": 0.0091, "LK": 0.0031, "NP": 0.0075,
    "MX": 0.058, "BR": 0.20, "ZA": 0.055, "NG": 0.00065, "EG": 0.032, "TR": 0.031, "AE": 0.27, "SA": 0.27, "GB": 1.27, "EU": 1.08, "AU": 0.65, "CA": 0.74, "SG": 0.74, "HK": 0.13, "CN": 0.14, "US": 1.0,
}
MERCHANT_MAX = (
    ("coffee", 200), ("cafe", 200), ("starbucks", 200), ("dunkin", 200), ("bakery", 300), ("fast food", 300), ("mcdonald", 300), ("burger", 300), ("kfc", 300), ("subway", 200), ("pizza", 500),
    ("restaurant", 2000), ("diner", 500), ("bar", 1000), ("pub", 1000), ("gas station", 500), ("fuel", 500), ("petrol", 500), ("parking", 200), ("taxi", 500), ("uber", 500), ("lyft", 500), ("ola", 500),
    ("grocery", 1000), ("supermarket", 2000), ("pharmacy", 1000), ("convenience", 500),
)
SUBTYPE_MAX = {"POS_RESTAURANT": 3000, "FUEL": 500, "PARKING": 200, "TRANSPORT": 1000}
GRAVE_GSTIN = ("invalid_pan_format", "invalid_state_code", "state_pin_mismatch")


@dataclass(frozen=True)
class RuleSpec:
    rule_id: str
    condition: Column
    severity: Column | str
    hundredths: Column | int | float


def _c(name: str) -> Column:
    return F.col(name)


def _within(share: float, of: Column, least: float) -> Column:
    """The larger of an absolute and a relative tolerance."""
    return F.greatest(F.lit(least), of * share)


def missing_enabled() -> Column:
    """Whether missing fields may count: the profile is known well enough."""
    unknown_geo = (_c("geo_country") == "UNKNOWN") & (_c("geo_conf") < 0.30)
    odd_type = _c("doc_subtype").isin("MISC", "UNKNOWN") & (_c("profile_conf") < 0.55)
    return (_c("profile_conf") >= 0.55) & ~unknown_geo & ~odd_type


def registry(as_of: str, gap_days: int = 540) -> list[RuleSpec]:
    today, receipt, creation, changed = F.lit(as_of).cast("date"), _c("receipt_date"), _c("creation_date"), _c("mod_date")
    total, subtotal, tax, items = _c("total"), _c("subtotal"), _c("tax"), _c("items_sum")
    producer = F.lower("producer")
    enabled, pos = missing_enabled(), _c("doc_subtype").startswith("POS_")
    ratio = F.try_divide(F.abs(total - items), total)
    mild = pos & (_c("ocr_conf") < 0.5) & (ratio > 0) & (ratio <= 0.05)
    expected = subtotal + tax + F.coalesce(_c("shipping"), F.lit(0.0)) - F.coalesce(_c("discount"), F.lit(0.0))
    off = F.when(total > 0, F.try_divide(F.abs(total - expected), total)).otherwise(0.0)
    tolerance = F.when(_c("ocr_conf") < 0.5, 0.10).when(_c("ocr_conf") < 0.7, 0.05).otherwise(0.02) * F.when(_c("doc_subtype") == "TAX_INVOICE", 0.5).otherwise(1.0)
    reconciles = (_c("profile_conf") >= 0.75) & (expected > 0) & (F.abs(total - expected) >= 1.0) & (off > tolerance)
    rate = F.try_divide(tax, subtotal) * 100
    odd_rate = F.lit(False)
    for country, (low, high) in TAX_RANGES.items():
        odd_rate = odd_rate | ((_c("geo_country") == country) & ((rate < low - 1.0) | (rate > high + 2.0)))
    unit = F.when(_c("geo_country").isin(*ROUND_BY_HUNDREDS), 100.0).otherwise(10.0)
    very_round = (total % (unit * 10) == 0) & (total >= unit * 10)
    india = _c("geo_country") == "IN"
    parts = F.coalesce(_c("cgst"), F.lit(0.0)) + F.coalesce(_c("sgst"), F.lit(0.0)) + F.coalesce(_c("igst"), F.lit(0.0))
    slab = F.least(*(F.abs(F.try_divide(parts, subtotal) * 100 - s) for s in GST_SLABS))
    name = F.lower(F.coalesce("merchant", F.lit("")))
    most = F.coalesce(*(F.when(name.contains(word), n) for word, n in MERCHANT_MAX), *(F.when((_c("doc_subtype") == s) & (_c("profile_conf") >= 0.7), n) for s, n in SUBTYPE_MAX.items()))
    usd = total * F.coalesce(*(F.when(_c("geo_country") == c, x) for c, x in TO_USD.items()), F.lit(1.0))
    sure_pos = (_c("profile_conf") >= 0.8) & pos
    unclear = _c("doc_type_hint").isin("ambiguous", "unknown") & (pos | (_c("doc_subtype") == "FUEL"))
    loose = (_c("doc_family") == "TRANSACTIONAL") & (_c("profile_conf") < 0.4) | (_c("n_structural") >= 3)
    invoice = _c("doc_family").isin("INVOICE", "COMMERCIAL") | _c("doc_subtype").contains("INVOICE")
    no_address = F.coalesce("address_class", F.lit("")).isin("NOT_AN_ADDRESS", "")
    gstin = india & (_c("geo_conf") >= 0.5) & _c("gstin_issue").isNotNull()
    label_like = _c("merchant_issue").isin("looks_like_label", "looks_like_identifier")
    ahead, gap, touched = F.datediff(receipt, today), F.datediff(creation, receipt), F.datediff(changed, creation)
    return [
        RuleSpec("R_DUPLICATE_RECEIPT", _c("duplicate") == "exact", "HARD_FAIL", 60),
        RuleSpec("R_DUPLICATE_RECEIPT", _c("duplicate") == "fuzzy", "CRITICAL", 40),
        RuleSpec("R1_SUSPICIOUS_SOFTWARE", producer.rlike("|".join(HIGH_RISK)), "HARD_FAIL", 50),
        RuleSpec("R1_SUSPICIOUS_SOFTWARE", producer.rlike("|".join(MEDIUM_RISK)) & ~producer.rlike("|".join(HIGH_RISK)), "WARNING", 10),
        RuleSpec("R1B_METADATA_TIMESTAMP_ANOMALY", touched > 1, F.when(touched > 30, "CRITICAL").otherwise("WARNING"), F.when(touched > 30, 25).otherwise(8)),
        RuleSpec("R5_NO_AMOUNTS", enabled & total.isNull() & items.isNull(), "CRITICAL", 40),
        RuleSpec("R6_NO_TOTAL_LINE", enabled & total.isNull() & items.isNotNull(), "CRITICAL", 15),
        RuleSpec("R7_TOTAL_MISMATCH", ratio > 0.02, F.when(mild, "WARNING").otherwise("CRITICAL"), F.when(mild, 15).otherwise(40)),
        RuleSpec("R7B_INVOICE_TOTAL_RECONCILIATION", reconciles, F.when(off > 2 * tolerance, "WARNING").otherwise("INFO"), F.when(off > 2 * tolerance, 8).otherwise(0)),
        RuleSpec("R8_NO_DATE", enabled & receipt.isNull(), F.when(_c("ocr_conf") < 0.4, "WARNING").otherwise("CRITICAL"), F.when(_c("ocr_conf") < 0.4, 12).otherwise(20)),
        RuleSpec("R9_NO_MERCHANT", _c("merchant").isNull(), F.when(enabled, "CRITICAL").otherwise("WARNING"), F.when(enabled, 15).otherwise(8)),
        RuleSpec("R10_TOO_FEW_LINES", _c("num_lines") < 5, "INFO", 15),
        RuleSpec("R11_TOO_MANY_LINES", _c("num_lines") > 120, "INFO", 10),
        RuleSpec("R12_HIGH_NUMERIC_RATIO", (_c("numeric_ratio") > 0.8) & (_c("num_lines") > 10), "INFO", 10),
        RuleSpec("R13_HIGH_UPPERCASE", (_c("upper_ratio") > 0.8) & (_c("num_lines") > 5), "INFO", 10),
        RuleSpec("R14_LOW_CHAR_VARIETY", (_c("unique_chars") < 15) & (_c("num_lines") > 5), "INFO", 15),
        RuleSpec("R_FUTURE_DATE", ahead > 1, F.when(ahead > 7, "HARD_FAIL").otherwise("CRITICAL"), F.when(ahead > 7, 45).otherwise(30)),
        RuleSpec("R15_IMPOSSIBLE_DATE_SEQUENCE", receipt > creation, "HARD_FAIL", 40),
        RuleSpec("R16_SUSPICIOUS_DATE_GAP", gap > F.lit(gap_days // 6), F.when((_c("profile_conf") < 0.4) & (gap < gap_days), "WARNING").otherwise("CRITICAL"), F.when((_c("profile_conf") < 0.4) & (gap < gap_days), 10).otherwise(35)),
        RuleSpec("R_TAX_RATE_ANOMALY", (tax > 0) & (_c("geo_conf") >= 0.6) & (subtotal > 0) & odd_rate, "WARNING", 10),
        RuleSpec("R_ROUND_TOTAL", (total % unit == 0) & (total >= unit * 2) & ~_c("doc_subtype").isin(*ROUND_EXEMPT), "WARNING", F.when(very_round, 10).otherwise(6) + F.when(_c("doc_subtype").isin(*ROUND_SUSPICIOUS), 4).otherwise(0)),
        RuleSpec("R_CURRENCY_INCONSISTENCY", _c("n_currencies") >= 2, "WARNING", 10),
        RuleSpec("R7D_TAX_COMPONENT_VERIFICATION", india & (_c("cgst") > 0) & (_c("sgst") > 0) & (F.abs(_c("cgst") - _c("sgst")) > _within(0.02, _c("cgst"), 0.5)), "CRITICAL", 18),
        RuleSpec("R7D_TAX_COMPONENT_VERIFICATION", india & (parts > 0) & (tax > 0) & (F.abs(parts - tax) > _within(0.02, tax, 1.0)), "WARNING", 12),
        RuleSpec("R7D_TAX_COMPONENT_VERIFICATION", india & (_c("igst") > 0) & (_c("cgst") > 0), "CRITICAL", 20),
        RuleSpec("R7D_TAX_COMPONENT_VERIFICATION", india & (subtotal > 0) & (parts > 0) & (slab > 2.0), "INFO", 6),
        RuleSpec("R_DATE_CONFLICT", _c("date_span") > 30, "CRITICAL", F.when(pos, 35).otherwise(25)),
        RuleSpec("MERCHANT_IMPLAUSIBLE", enabled & _c("merchant").isNotNull() & _c("merchant_issue").isNotNull(), "CRITICAL", F.when(label_like, 18).otherwise(12)),
        RuleSpec("MERCHANT_IMPLAUSIBLE_GATED", ~enabled & _c("merchant").isNotNull() & _c("merchant_issue").isNotNull(), "INFO", 0),
        RuleSpec("R9B_DOC_TYPE_UNKNOWN_GATED", unclear & sure_pos, "INFO", 0),
        RuleSpec("R9B_DOC_TYPE_UNKNOWN_OR_MIXED", unclear & ~sure_pos, F.when(loose, "WARNING").otherwise("CRITICAL"), F.when(loose, 8.0).when(_c("n_structural") >= 2, 7.5).otherwise(15.0)),
        RuleSpec("R_AMOUNT_PLAUSIBILITY", (total > 0) & (usd > most * 2), F.when(usd > most * 5, "CRITICAL").otherwise("WARNING"), F.when(usd > most * 5, 20).otherwise(10)),
        RuleSpec("R_QTY_RATE_MISMATCH", _c("qty_rate_off") > 1.5, "WARNING", F.when(_c("qty_rate_off") > 5.0, 10).otherwise(6)),
        RuleSpec("R_ADDRESS_FAKE", _c("address_fake"), "CRITICAL", 30),
        RuleSpec("R_ADDRESS_MISSING", invoice & no_address & (_c("profile_conf") >= 0.6), "WARNING", 10),
        RuleSpec("R_ADDRESS_IMPLAUSIBLE", (_c("address_class") == "WEAK_ADDRESS") & ~pos & (_c("address_score") <= 2), "WARNING", 8),
        RuleSpec("R_ADDRESS_MERCHANT_MISMATCH", _c("address_verdict").isin("INCONSISTENT", "SUSPICIOUS") & (_c("address_verdict_conf") >= 0.6), F.when(_c("address_verdict") == "INCONSISTENT", "CRITICAL").otherwise("WARNING"), F.when(_c("address_verdict") == "INCONSISTENT", 15).otherwise(8)),
        RuleSpec("R_STRUCTURE_ORDER", _c("out_of_order"), "WARNING", 10),
        RuleSpec("R_GSTIN_FORMAT", gstin, F.when(_c("gstin_issue") == "", "INFO").when(_c("gstin_issue").isin(*GRAVE_GSTIN), "CRITICAL").otherwise("WARNING"), F.when(_c("gstin_issue") == "", 0).when(_c("gstin_issue").isin(*GRAVE_GSTIN), 15).otherwise(8)),
        RuleSpec("R_HANDWRITTEN_RECEIPT", _c("ocr_conf") < 0.35, "WARNING", F.when(_c("ocr_conf") < 0.20, 12).otherwise(8)),
    ]


def evaluate(records: DataFrame, rules: list[RuleSpec]) -> DataFrame:
    """Records with ``events``: (ordinal, rule_id, severity, weight in thousandths as applied)."""

    def event(i: int, r: RuleSpec) -> Column:
        severity = F.lit(r.severity) if isinstance(r.severity, str) else r.severity
        weight = (F.lit(r.hundredths) if isinstance(r.hundredths, int | float) else r.hundredths) * F.when(severity == "HARD_FAIL", 10).otherwise(SOFT_TENTHS)
        return F.when(r.condition, F.struct(F.lit(i).alias("ordinal"), F.lit(r.rule_id).alias("rule_id"), severity.alias("severity"), weight.cast("double").alias("thousandths")))

    return records.withColumn("events", F.array_compact(F.array(*(event(i, r) for i, r in enumerate(rules)))))


def exploded(evaluated: DataFrame) -> DataFrame:
    """``id`` and ``e``, an event, of ``evaluate``.

    By the outer form: the inner one asks for each array's size below the projection, so that all rules are evaluated anew.
    """
    return evaluated.select("id", F.explode_outer("events").alias("e")).where("e IS NOT NULL")


def score_and_label(evaluated: DataFrame) -> DataFrame:
    """``id``, ``score`` (0 to 1), ``label`` and the ids of the rules that fired, in order."""
    total = F.least(F.lit(1000.0), F.aggregate("events", F.lit(0.0), lambda a, e: a + e["thousandths"]))
    hard = F.exists("events", lambda e: e["severity"] == "HARD_FAIL")
    critical = F.size(F.filter("events", lambda e: e["severity"] == "CRITICAL"))
    label = F.when(hard | (critical >= 2) | (total >= FAKE), "fake").when(total >= SUSPICIOUS, "suspicious").otherwise("real")
    return evaluated.select("id", (total / 1000.0).alias("score"), label.alias("label"), F.array_join(F.transform("events", lambda e: e["rule_id"]), ",").alias("rules"), critical.cast("long").alias("n_critical"), hard.alias("hard_fail"))
