"""The gated score: profile and matrix decide which rules count, then learned rules adjust within their caps.

The order is fixed: a profile's own severity replaces a rule's, rules that the
matrix or the profile forbids are skipped, the rest are summed, learned rules
are added (each once, suppressed ones for the record only, their sum capped by
the profile), and the score is clamped. Rules are gated within their row;
learned rules, of which a record can have any number, are reduced by aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gates import MATRIX
from .rules import FAKE, SOFT_TENTHS, SUSPICIOUS, missing_enabled

# Profiles by document class, and the classes that share one.
CLASSES = {
    "POS_RECEIPT": "POS_RECEIPT", "POS_RESTAURANT": "POS_RECEIPT", "POS_RETAIL": "POS_RECEIPT", "POS_FUEL": "POS_RECEIPT",
    "COMMERCIAL_INVOICE": "COMMERCIAL_INVOICE", "SALES_INVOICE": "COMMERCIAL_INVOICE", "PROFORMA_INVOICE": "COMMERCIAL_INVOICE",
    "TAX_INVOICE": "TAX_INVOICE", "VAT_INVOICE": "TAX_INVOICE",
    "TRADE_DOCUMENT": "TRADE_DOCUMENT", "BILL_OF_LADING": "TRADE_DOCUMENT", "SHIPPING_BILL": "TRADE_DOCUMENT", "AIR_WAYBILL": "TRADE_DOCUMENT",
    "UTILITY_BILL": "UTILITY_BILL", "ELECTRICITY_BILL": "UTILITY_BILL", "WATER_BILL": "UTILITY_BILL", "TELECOM_BILL": "UTILITY_BILL",
    "BANK_STATEMENT": "BANK_STATEMENT", "CARD_STATEMENT": "BANK_STATEMENT",
    "EXPENSE_REPORT": "EXPENSE_REPORT", "EXPENSE_CLAIM": "EXPENSE_REPORT",
}
#: Profiles in which a rule is skipped.
SKIPPED = {
    "R7_TOTAL_MISMATCH": ("COMMERCIAL_INVOICE", "TRADE_DOCUMENT", "UTILITY_BILL", "BANK_STATEMENT"),
    "R16_SUSPICIOUS_DATE_GAP": ("COMMERCIAL_INVOICE", "TAX_INVOICE", "TRADE_DOCUMENT", "UTILITY_BILL", "BANK_STATEMENT"),
}
#: Severities that a profile puts in place of a rule's own.
SEVERITIES = {
    ("COMMERCIAL_INVOICE", "R16_SUSPICIOUS_DATE_GAP"): "INFO",
    ("COMMERCIAL_INVOICE", "R1_SUSPICIOUS_SOFTWARE"): "INFO",
    ("BANK_STATEMENT", "R1_SUSPICIOUS_SOFTWARE"): "HARD_FAIL",
}
#: Learned patterns that a profile disables, and the most that learned rules may add, in thousandths.
DISABLED = {
    "COMMERCIAL_INVOICE": ("spacing_anomaly", "missing_elements", "invalid_address"),
    "TRADE_DOCUMENT": ("spacing_anomaly", "missing_elements", "invalid_address"),
    "UTILITY_BILL": ("spacing_anomaly", "invalid_address"),
}
LEARNED_MOST = {"COMMERCIAL_INVOICE": 100, "TRADE_DOCUMENT": 50, "UTILITY_BILL": 100}
RULE_MOST, TOTAL_MOST = 500, 1000


def profile_of(doc_class: Column) -> Column:
    """The profile of a document class: by name, else by the words in it, else UNKNOWN."""
    name = F.upper(F.trim(F.coalesce(doc_class, F.lit("UNKNOWN"))))
    found = F.create_map(*(F.lit(x) for pair in CLASSES.items() for x in pair))[name]
    has = lambda *words: F.coalesce(name.rlike("|".join(words)), F.lit(False))
    return (
        F.when(found.isNotNull(), found)
        .when(name.startswith("POS_"), "POS_RECEIPT")
        .when(has("INVOICE") & has("TAX", "VAT"), "TAX_INVOICE")
        .when(has("INVOICE"), "COMMERCIAL_INVOICE")
        .when(has("BILL") & has("UTILITY", "ELECTRIC", "WATER", "TELECOM"), "UTILITY_BILL")
        .when(has("BILL") & has("LADING", "SHIPPING"), "TRADE_DOCUMENT")
        .when(has("STATEMENT"), "BANK_STATEMENT")
        .otherwise("UNKNOWN")
    )


def gated_events(profile: Column, subtype: Column, events: Column) -> Column:
    """The events that may act, with the profile's severities; what the matrix doesn't list for a subtype is forbidden."""

    def allowed(e: Column) -> Column:
        ok = F.lit(True)
        for rule, modes in MATRIX.items():
            ok = ok & ((e["rule_id"] != rule) | F.coalesce(F.upper(subtype).isin(*modes), F.lit(False)))
        for rule, profiles in SKIPPED.items():
            ok = ok & ((e["rule_id"] != rule) | ~profile.isin(*profiles))
        return ok

    def judged(e: Column) -> Column:
        severity = e["severity"]
        for (p, rule), other in SEVERITIES.items():
            severity = F.when((profile == p) & (e["rule_id"] == rule), other).otherwise(severity)
        tenths = lambda s: F.when(s == "HARD_FAIL", 10).otherwise(SOFT_TENTHS)
        return F.struct(e["ordinal"].alias("ordinal"), e["rule_id"].alias("rule_id"), severity.alias("severity"), (e["thousandths"] / tenths(e["severity"]) * tenths(severity)).alias("thousandths"))

    return F.filter(F.transform(events, judged), allowed)


def parse_learned(raw: Column) -> Column:
    """pattern, times_seen, thousandths (of the confidence adjustment) and missing (names, sorted) of a learned rule's text."""
    pattern = F.lower(F.regexp_extract(raw, r"(?i)pattern detected:\s*([a-zA-Z0-9_\-]+)", 1))
    seen = F.regexp_extract(raw, r"(?i)identified by users\s+(\d+)\s+time", 1).try_cast("int")
    adjustment = F.regexp_extract(raw, r"(?i)confidence adjustment:\s*([+\-]?[0-9]*\.?[0-9]+)", 1).try_cast("double")
    names = F.transform(F.split(F.regexp_extract(raw, r"(?i)missing critical elements:\s*([^.]+)", 1), ","), lambda x: F.lower(F.trim(x)))
    return F.struct(
        F.when(pattern == "", "unknown").otherwise(pattern).alias("pattern"),
        seen.alias("times_seen"),
        F.coalesce(F.round(adjustment * 1000), F.lit(0)).cast("long").alias("thousandths"),
        F.array_sort(F.array_distinct(F.filter(names, lambda x: x != ""))).alias("missing"),
    )


def learned_effects(records: DataFrame, learned: DataFrame) -> DataFrame:
    """For each record with learned rules: ``delta`` in thousandths, ``n_learned``, ``n_suppressed``, ``capped``.

    ``learned`` has ``id``, ``ordinal`` and ``raw``. Rules of one pattern and one
    set of missing names count once, the first of them. Suppressed: those that
    need the missing-field gate while it is shut, those that the profile
    disables, and on POS receipts those that its core fields answer.
    """
    parsed = learned.select("id", "ordinal", "raw", parse_learned(F.col("raw")).alias("p"))
    once = parsed.groupBy("id", "p.pattern", "p.missing").agg(F.min_by(F.struct(F.lower("raw").alias("raw"), "p.thousandths"), "ordinal").alias("first"))
    c = F.col
    pos = F.upper("doc_subtype").startswith("POS_")
    core = c("merchant").isNotNull() & (c("n_currencies") > 0)
    amounts = (F.coalesce(c("total"), F.lit(0.0)) != 0) | c("items_sum").isNotNull()
    facts = records.select(
        c("id").alias("r_id"), profile_of(c("doc_subtype")).alias("profile"), missing_enabled().alias("enabled"),
        (pos & core & amounts).alias("pos_core"), (pos & core).alias("pos_named"), ((c("profile_conf") < 0.6) | (pos & (c("upper_ratio") > 0.5))).alias("loose"),
    )
    needs_gate = F.lit(False)
    for word in ("missing_elements", "invalid_address"):
        needs_gate = needs_gate | c("first.raw").contains(word) | (c("pattern") == word)
    off = F.lit(False)
    for profile, patterns in DISABLED.items():
        off = off | ((c("profile") == profile) & c("pattern").isin(*patterns))
    yes = lambda x: F.coalesce(x, F.lit(False))
    suppressed = (
        (needs_gate & ~yes(c("enabled")))
        | off
        | ((c("pattern") == "missing_elements") & yes(c("pos_core")))
        | ((c("pattern") == "invalid_address") & yes(c("pos_named")))
        | ((c("pattern") == "spacing_anomaly") & (~yes(c("enabled")) | yes(c("loose"))))
    )
    effect = F.greatest(F.lit(-RULE_MOST), F.least(F.lit(RULE_MOST), c("first.thousandths")))
    by = once.join(facts, c("id") == c("r_id")).groupBy("id", "profile").agg(
        F.sum(F.when(suppressed, 0).otherwise(effect)).alias("total"), F.count("*").alias("n_learned"), F.count_if(suppressed).alias("n_suppressed")
    )
    most = F.create_map(*(F.lit(x) for pair in LEARNED_MOST.items() for x in pair))[c("profile")]
    capped = yes(c("total") > most)
    delta = F.greatest(F.lit(-TOTAL_MOST), F.least(F.lit(TOTAL_MOST), F.when(capped, most).otherwise(c("total"))))
    return by.select("id", delta.cast("long").alias("delta"), "n_learned", "n_suppressed", capped.alias("capped"))


def gated_score(evaluated: DataFrame, learned: DataFrame) -> DataFrame:
    """``id``, ``score``, ``label`` and the trail of every record of ``rules.evaluate``.

    ``n_skipped`` rules were forbidden; ``delta`` is what learned rules added;
    ``trail`` names all that acted, in order: the shut missing-field gate, the
    rules, the learned rules, and the cap if it was reached.
    """
    effects = learned_effects(evaluated, learned).withColumnRenamed("id", "l_id")
    profile = profile_of(F.col("doc_subtype"))
    own = evaluated.select("id", F.coalesce(missing_enabled(), F.lit(False)).alias("enabled"), F.size("events").alias("n_events"), gated_events(profile, F.col("doc_subtype"), F.col("events")).alias("events"))
    joined = own.join(effects, own["id"] == effects["l_id"], "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    base = F.aggregate("events", F.lit(0.0), lambda a, e: a + e["thousandths"])
    total = F.greatest(F.lit(0.0), F.least(F.lit(1000.0), base + count("delta")))
    hard = F.exists("events", lambda e: e["severity"] == "HARD_FAIL")
    critical = F.size(F.filter("events", lambda e: e["severity"] == "CRITICAL"))
    label = F.when(hard | (critical >= 2) | (total >= FAKE), "fake").when(total >= SUSPICIOUS, "suspicious").otherwise("real")
    text = F.array().cast("array<string>")
    trail = F.concat(
        F.when(~F.col("enabled"), F.array(F.lit("GATE_MISSING_FIELDS"))).otherwise(text),
        F.transform("events", lambda e: e["rule_id"]),
        F.array_repeat(F.lit("LR_LEARNED_PATTERN"), count("n_learned").cast("int")),
        F.when(F.col("capped"), F.array(F.lit("LR_CAP_APPLIED"))).otherwise(text),
    )
    return joined.select(
        "id", (total / 1000.0).alias("score"), label.alias("label"), (F.col("n_events") - F.size("events")).cast("long").alias("n_skipped"),
        count("delta").alias("delta"), count("n_learned").alias("n_learned"), count("n_suppressed").alias("n_suppressed"), F.array_join(trail, ",").alias("trail"),
    )
