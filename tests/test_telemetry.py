"""Address counters, on results written out."""

from tallyguard.operators import telemetry as M

SCHEMA = "id long, address_score int, address_class string, address_type string, merchant_conf double, profile_conf double, doc_subtype string, n_addresses long, multi_status string, consistency string, consistency_score double"
ROWS = [
    (1, 6, "STRONG_ADDRESS", "PO_BOX", 0.9, 0.9, "INVOICE", 3, "MULTIPLE", "MISMATCH", 0.2),
    (2, 4, "PLAUSIBLE_ADDRESS", "STANDARD", 0.5, 0.9, None, 1, "SINGLE", "UNKNOWN", 0.0),
    (3, 3, "WEAK_ADDRESS", "STANDARD", 0.5, 0.5, "VAT_INVOICE", 2, "MULTIPLE", "UNKNOWN", 0.5),
    (4, None, None, None, None, None, None, None, None, None, None),
]


def counted(df):
    return {r.counter: r.n for r in df.collect()}


def test_counters(spark):
    found = counted(M.counters(spark.createDataFrame(ROWS, SCHEMA)))
    assert found == {
        "documents": 4, "address_classification.STRONG_ADDRESS": 1, "address_classification.PLAUSIBLE_ADDRESS": 1, "address_classification.WEAK_ADDRESS": 1, "address_classification.UNKNOWN": 1,
        "address_type.PO_BOX": 1, "address_type.STANDARD": 2, "address_type.UNKNOWN": 1, "address_score.strong": 1, "address_score.plausible": 1, "address_score.weak": 1, "address_score.none": 1,
        "address_quality.high": 2, "address_special.po_box": 1, "multi_address.status.MULTIPLE": 2, "multi_address.status.SINGLE": 1, "multi_address.status.UNKNOWN": 1,
        "multi_address.count.three_plus": 1, "multi_address.count.two": 1, "multi_address.count.single": 1, "multi_address.count.zero": 1, "multi_address.gated.low_doc_confidence": 1, "multi_address.detected": 2,
        "consistency.status.MISMATCH": 1, "consistency.status.UNKNOWN": 3, "consistency.score.low": 1, "consistency.score.medium": 1, "consistency.score.zero": 2,
        "consistency.gated.low_merchant_confidence": 1, "consistency.gated.low_doc_confidence": 2, "consistency.mismatch_detected": 1,
        "overlap.multi_and_mismatch": 1, "overlap.multi_and_invoice": 2, "overlap.mismatch_and_invoice": 1, "overlap.multi_and_mismatch_and_invoice": 1,
    }


def test_parts_add_up_and_shares(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    parts = M.merged(M.counters(df.where("id < 3")), M.counters(df.where("id >= 3")))
    assert counted(parts) == counted(M.counters(df))
    assert {r.counter: r.pct for r in M.shares(parts).collect()}["address_quality.high"] == 50.0
    assert M.shares(M.counters(df.where("false"))).count() == 0


def test_results_of_texts(spark):
    docs = spark.createDataFrame([(1, "Harbour Logistics Inc", "P.O. Box 12, Harbour Road\nDock Ward 54321\nKenya", 0.9, 0.9, None), (2, None, None, None, None, None), (3, "x", "Main Rd", 0.9, 0.9, "MISC")], "id long, merchant string, address string, merchant_conf double, profile_conf double, doc_subtype string")
    found = {r.id: (r.address_score, r.address_type, r.n_addresses, r.multi_status, r.consistency, r.consistency_score) for r in M.address_results(docs).collect()}
    # harbour in both, and a company at a box: three tenths, of which two count
    assert found == {1: (6, "PO_BOX", 1, "SINGLE", "MISMATCH", 0.2), 2: (0, "UNKNOWN", 0, "UNKNOWN", "UNKNOWN", 0.0), 3: (0, "UNKNOWN", 0, "UNKNOWN", "UNKNOWN", 0.0)}
