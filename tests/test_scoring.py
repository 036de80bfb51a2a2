"""The gated score on small records, and images by claims, against values written out."""

import pytest
from pyspark.sql import functions as F

from tallyguard.operators import duplicates as P
from tallyguard.operators import scoring as S

RECORD = "id long, doc_subtype string, merchant string, n_currencies int, total double, items_sum double, profile_conf double, geo_country string, geo_conf double, upper_ratio double"
EVENTS = "array<struct<ordinal:int,rule_id:string,severity:string,thousandths:double>>"


def judged(spark, rows, learned=()):
    """rows: (id, subtype, profile_conf, [(rule, severity, hundredths)])."""
    made = []
    for i, subtype, conf, events in rows:
        own = [(k, r, s, float(w * (10 if s == "HARD_FAIL" else 7))) for k, (r, s, w) in enumerate(events)]
        made.append((i, subtype, "Shop", 1, 10.0, None, conf, "US", 0.9, 0.2, own))
    records = spark.createDataFrame(made, f"{RECORD}, events {EVENTS}")
    hits = spark.createDataFrame([(i, k, t) for k, (i, t) in enumerate(learned)], "id long, ordinal int, raw string")
    return {r.id: r for r in S.gated_score(records, hits).collect()}


def test_profiles_of_classes(spark):
    names = ["POS_RETAIL", "pos_bakery", "TAX_INVOICE", "EXPORT_VAT_INVOICE", "INVOICE", "WATER_BILL", "ELECTRICITY_UTILITY_BILL", "BILL_OF_LADING", "MONTHLY_STATEMENT", "BILL", "PARKING", None]
    got = [r.p for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", S.profile_of(F.col("n")).alias("p")).orderBy("i").collect()]
    assert got == ["POS_RECEIPT", "POS_RECEIPT", "TAX_INVOICE", "TAX_INVOICE", "COMMERCIAL_INVOICE", "UTILITY_BILL", "UTILITY_BILL", "TRADE_DOCUMENT", "BANK_STATEMENT", "UNKNOWN", "UNKNOWN", "UNKNOWN"]


def test_gates_change_labels(spark):
    total, gap, made = ("R7_TOTAL_MISMATCH", "CRITICAL", 40), ("R16_SUSPICIOUS_DATE_GAP", "CRITICAL", 35), ("R1_SUSPICIOUS_SOFTWARE", "HARD_FAIL", 50)
    got = judged(spark, [
        (1, "POS_RETAIL", 0.9, [total, gap]), (2, "COMMERCIAL_INVOICE", 0.9, [total, gap, made]), (3, "TAX_INVOICE", 0.9, [total, gap, made]),
        (4, "CARD_STATEMENT", 0.9, [("R1_SUSPICIOUS_SOFTWARE", "WARNING", 10)]), (5, "MISC", 0.9, [total, ("R_ADDRESS_FAKE", "CRITICAL", 30)]), (6, "PARKING", 0.2, []),
    ])
    assert [(got[i].label, got[i].n_skipped, round(got[i].score, 6)) for i in range(1, 7)] == [("fake", 0, 0.525), ("suspicious", 2, 0.35), ("fake", 2, 0.5), ("fake", 0, 0.1), ("real", 1, 0.21), ("real", 0, 0.0)]
    assert got[6].trail == "GATE_MISSING_FIELDS" and got[2].trail == "R1_SUSPICIOUS_SOFTWARE"


def test_learned_rules_are_capped_suppressed_and_counted_once(spark):
    font, vendor = "Pattern detected: font_mix. Confidence adjustment: +0.9", "Pattern detected: known_vendor. Confidence adjustment: -0.3"
    spacing, address = "Pattern detected: spacing_anomaly. Confidence adjustment: 0.2", "Pattern detected: invalid_address. Confidence adjustment: 0.2"
    first, again = "Missing critical elements: Total, date. Pattern detected: missing_elements. Confidence adjustment: 0.1", "missing critical elements: date , total. Pattern detected: missing_elements. Confidence adjustment: 0.4"
    rows = [(1, "EXPENSE_REPORT", 0.9, []), (2, "SALES_INVOICE", 0.9, []), (3, "POS_RETAIL", 0.9, []), (4, "EXPENSE_REPORT", 0.4, []), (5, "EXPENSE_REPORT", 0.9, []), (6, "WATER_BILL", 0.9, [])]
    learned = [(1, font), (1, vendor), (2, font), (2, spacing), (3, first), (3, address), (3, spacing), (4, first), (4, spacing), (5, first), (5, again), (6, font), (6, first), (6, address)]
    got = judged(spark, rows, learned)
    assert [(got[i].delta, got[i].n_learned, got[i].n_suppressed) for i in range(1, 7)] == [(200, 2, 0), (100, 2, 1), (200, 3, 2), (0, 2, 2), (100, 1, 0), (100, 3, 1)]
    assert got[2].trail == "LR_LEARNED_PATTERN,LR_LEARNED_PATTERN,LR_CAP_APPLIED"
    assert judged(spark, [(1, "MISC", 0.9, [("R_X", "INFO", 10)])], [(1, vendor)])[1].score == 0.0


def test_learned_text(spark):
    text = "Pattern detected: Spacing-1 identified by users 12 times. Confidence adjustment: -.25. Missing critical elements: b, A ,, b. more"
    row = spark.createDataFrame([(text,), (None,)], "t string").select(S.parse_learned(F.col("t")).alias("p")).collect()
    assert row[0].p.asDict() == {"pattern": "spacing-1", "times_seen": 12, "thousandths": -250, "missing": ["a", "b"]}
    assert row[1].p.thousandths == 0


IMAGE = "image_id long, claim_id long, file_hash string, phash string, size long, width int, height int"


def images(spark):
    """Four copies in one claim; a hash of three claims; a banner copy; a hash of one image."""
    rows = [(i, 1, "one", "0" * 16) for i in (1, 2, 3, 4)] + [(5, 2, "three", "f" * 16), (6, 3, "three", "f" * 16), (7, 4, "three", "f" * 16), (8, 4, "three", "f" * 16), (9, 5, "lone", "000000000000001f")]
    return spark.createDataFrame([(*r, 9000, 600, 500) for r in rows] + [(10, 6, "flat", "00000000ffffffff", 9000, 6000, 500), (11, 7, "flat", "00000000ffffffff", 9000, 600, 500), (12, None, "flat", None, 9000, 600, 500)], IMAGE)


def test_templates_count_claims(spark):
    got = {r.image_id: (r.n_claims, r.reason) for r in P.template_images(images(spark)).collect()}
    assert [got[i] for i in (1, 4, 5, 8, 9, 11)] == [(1, None), (1, None), (3, "common template"), (3, "common template"), (1, None), (2, None)]
    assert got[10] == (2, "banner")


def test_exact_images_are_of_other_claims_and_no_banners(spark):
    got = {r.image_id: r.matched_id for r in P.exact_images(images(spark)).collect()}
    assert got == {5: 6, 6: 5, 7: 5, 8: 5, 10: 11}


@pytest.mark.parametrize("bits,near", [(5, 2), (4, 1)])
def test_near_claims_by_every_pair(spark, bits, near):
    got = {r.phash: (r.n_claims, r.n_near_claims) for r in P.near_hash_claims(P.image_members(images(spark)), bits).collect()}
    assert got == {"0" * 16: (1, near), "000000000000001f": (1, near), "f" * 16: (3, 3), "00000000ffffffff": (2, 2)}
