"""Which rules may run for which documents, address rules, and checks of amounts on a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How a rule may act on a subtype; what isn't listed is FORBIDDEN.
_POS = ("POS_RECEIPT", "POS_RESTAURANT", "POS_RETAIL", "FUEL")
MATRIX: dict[str, dict[str, str]] = {
    "R7_TOTAL_MISMATCH": dict.fromkeys(_POS, "BLOCK"),
    "R7B_INVOICE_TOTAL_RECONCILIATION": {"COMMERCIAL_INVOICE": "BLOCK", "TAX_INVOICE": "BLOCK", "SUBSCRIPTION": "SOFT"},
    "R7C_CREDIT_NOTE_RECONCILIATION": {"TAX_INVOICE": "SOFT", "CREDIT_NOTE": "BLOCK"},
    "R9B_DOC_TYPE_UNKNOWN_OR_MIXED": dict.fromkeys(_POS, "BLOCK"),
    "R10_TEMPLATE_QUALITY": dict.fromkeys((*_POS, "COMMERCIAL_INVOICE", "TAX_INVOICE"), "SOFT"),
}
#: Profiles: subtype, then which groups of rules apply (totals, date gaps, software) and the cap of learned rules in hundredths.
PROFILES = (
    ("POS_RETAIL", True, True, True, None), ("FUEL", True, True, True, None), ("PARKING", True, True, True, None), ("COMMERCIAL_INVOICE", False, False, False, 10), ("TAX_INVOICE", True, False, True, 20), ("MISC", True, True, True, None),
)
#: Severities that a profile puts in place of a rule's own.
OVERRIDES = {("COMMERCIAL_INVOICE", "R16_SUSPICIOUS_DATE_GAP"): "INFO", ("COMMERCIAL_INVOICE", "R1_SUSPICIOUS_SOFTWARE"): "INFO"}
INVOICES = ("INVOICE", "TAX_INVOICE", "VAT_INVOICE", "COMMERCIAL_INVOICE")


def matrix(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, s, m) for r, row in MATRIX.items() for s, m in row.items()], "m_rule string, m_subtype string, mode string")


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROFILES), "p_subtype string, totals boolean, date_gaps boolean, software boolean, learned_cap int")


def gate(events: DataFrame, matrix: DataFrame, profiles: DataFrame) -> DataFrame:
    """Events (``id``, ``rule_id``, ``doc_subtype``, ``severity``) with how they may act: both dimensions are small and fixed, so broadcast.

    A rule of the matrix acts by its mode for the subtype; other rules BLOCK.
    A profile can switch a group of rules off (AUDIT: recorded, not scored) and
    override a severity.
    """
    m, p = F.broadcast(matrix), F.broadcast(profiles)
    j = events.join(m, (F.col("rule_id") == F.col("m_rule")) & (F.col("doc_subtype") == F.col("m_subtype")), "left").join(p, F.col("doc_subtype") == F.col("p_subtype"), "left")
    listed = F.col("rule_id").isin(*MATRIX)
    off = (
        (F.col("rule_id").isin("R7_TOTAL_MISMATCH") & (F.col("totals") == F.lit(False)))
        | (F.col("rule_id").isin("R16_SUSPICIOUS_DATE_GAP") & (F.col("date_gaps") == F.lit(False)))
        | (F.col("rule_id").isin("R1_SUSPICIOUS_SOFTWARE") & (F.col("software") == F.lit(False)))
    )
    mode = F.when(listed, F.coalesce("mode", F.lit("FORBIDDEN"))).when(F.coalesce(off, F.lit(False)), "AUDIT").otherwise("BLOCK")
    severity = F.col("severity")
    for (subtype, rule), other in OVERRIDES.items():
        severity = F.when((F.col("doc_subtype") == subtype) & (F.col("rule_id") == rule), other).otherwise(severity)
    return j.select("id", "rule_id", mode.alias("mode"), severity.alias("severity"))


def address_rules(signals: DataFrame) -> DataFrame:
    """The first address rule that speaks, or why none may: ``multi``, ``mismatch`` (booleans), ``address_class``, ``producer_odd``, confidences and subtype."""
    invoice, several = F.col("doc_subtype").isin(*INVOICES), F.col("multi")
    strong = F.col("address_class").isin("PLAUSIBLE_ADDRESS", "STRONG_ADDRESS")
    sure = F.col("profile_conf") >= 0.8
    rule = (
        F.when(F.col("profile_conf") < 0.55, "RULE_ADDR_SUPPRESSION_LOW_CONFIDENCE")
        .when(F.col("merchant_conf") < 0.6, "RULE_ADDR_SUPPRESSION_WEAK_MERCHANT")
        .when(sure & invoice & several & F.col("mismatch"), "RULE_ADDR_MULTI_AND_MISMATCH")
        .when((F.col("profile_conf") >= 0.7) & F.col("producer_odd") & several & strong, "RULE_ADDR_TEMPLATE_EDITING_SUSPICION")
        .when(sure & invoice & several & strong, "RULE_ADDR_MULTI_IN_INVOICE_HIGHCONF")
    )
    return signals.select("id", rule.alias("rule"))


def amount_signals(records: DataFrame) -> DataFrame:
    """Arithmetic checks of a page's amounts: a row for each that fails, with severity and confidence.

    Null and zero amounts take part in no check.
    """
    total, subtotal, tax, items = (F.col(c) for c in ("total", "subtotal", "tax", "items_sum"))
    some = lambda *cs: F.coalesce(sum((F.when(c != 0, 0).otherwise(1) for c in cs), F.lit(0)) == 0, F.lit(False))
    diff = F.abs(total - (subtotal + tax))
    pct = F.try_divide(diff, total) * 100
    rate = F.try_divide(tax, subtotal) * 100
    rounds = sum((F.when((c > 0) & (c >= 100) & (c % 100 == 0), 1).otherwise(0) for c in (total, subtotal, tax)), F.lit(0))

    def one(name: str, when: Column, severity: Column | str, confidence: Column | float) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("signal"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence")))

    found = F.array_compact(F.array(
        one("AMOUNT_MATH_MISMATCH", some(total, subtotal, tax) & (diff > total * 0.01), F.when(pct > 5, "high").otherwise("medium"), F.least(F.lit(1.0), pct / 10)),
        one("TAX_RATE_UNREALISTIC", some(subtotal, tax) & (rate > 30), "high", 0.8),
        one("TAX_RATE_NEGATIVE", some(subtotal, tax) & (rate < 0), "critical", 0.95),
        one("ROUND_NUMBER_PATTERN", rounds >= 2, "low", 0.4),
        one("ITEMS_SUM_MISMATCH", some(items, subtotal) & (F.abs(items - subtotal) > subtotal * 0.01), "medium", 0.7),
    ))
    return records.select("id", F.explode(found).alias("s")).select("id", "s.*")
