"""Queries of address telemetry, in batch and as running counters."""

from __future__ import annotations

from ..operators import telemetry as M
from ..sources import sinks
from ..sources.views import ORACLE_VIEWS, VIEWS, view, with_views
from ..streaming import registry as T
from . import consistency as _consistency  # noqa: F401  its views are used here
from .registry import query

#: Visits with addresses of several forms: one, two, PO boxes, none, no text.
VIEWS["located"] = """SELECT id, merchant, merchant_conf, profile_conf, CASE id % 3 WHEN 0 THEN 'TAX_INVOICE' WHEN 1 THEN 'POS_RETAIL' END AS doc_subtype, CASE id % 8
  WHEN 0 THEN concat('7 Main Street', chr(10), 'Pune 411001', chr(10), 'Maharashtra India') WHEN 1 THEN concat('7 Main Street', chr(10), 'Pune 411001', chr(10), 'Maharashtra India', chr(10), 'Thank you', chr(10), 'Flat 7, Baker Street', chr(10), 'London 12345', chr(10), 'United Kingdom')
  WHEN 2 THEN concat('P.O. Box 12, Harbour Road', chr(10), 'Dock Ward 54321', chr(10), 'Kenya') WHEN 3 THEN concat('Thank you', chr(10), 'for coming') WHEN 4 THEN 'Green Lane Road 5 Pune'
  WHEN 6 THEN concat('P.O. Box 12, Harbour Road', chr(10), 'Dock Ward 54321', chr(10), 'Kenya', chr(10), 'Thank you', chr(10), '7 Main Street', chr(10), 'Pune 411001', chr(10), 'Maharashtra India') WHEN 7 THEN 'Main Rd' END AS address FROM {visits}"""

_CLASS = "CASE WHEN address_score < 3 THEN 'NOT_AN_ADDRESS' WHEN address_score = 3 THEN 'WEAK_ADDRESS' WHEN address_score < 6 THEN 'PLAUSIBLE_ADDRESS' ELSE 'STRONG_ADDRESS' END"
_SCORES, _COUNTS = (7, 8, 6, 2, 6, 0, 7, 0), (1, 4, 1, 0, 0, 0, 3, 0)
#: Scores and numbers of addresses of the eight forms, written out; how name and address fit is computed.
ORACLE_VIEWS["address_facts"] = f"""SELECT id, doc_subtype, merchant_conf, profile_conf, address_score, address_class, n, CASE WHEN n = 0 THEN 'UNKNOWN' WHEN n = 1 THEN 'SINGLE' ELSE 'MULTIPLE' END AS multi, CASE WHEN id % 8 IN (5, 7) THEN 'UNKNOWN' WHEN id % 8 IN (2, 6) THEN 'PO_BOX' ELSE 'STANDARD' END AS address_type,
  CASE WHEN NOT sure THEN 'UNKNOWN' WHEN t = 0 THEN 'CONSISTENT' WHEN t = 1 THEN 'WEAK_MISMATCH' ELSE 'MISMATCH' END AS status, CASE WHEN sure THEN least(t, 2) ELSE 0 END AS fit FROM (SELECT *, coalesce(merchant IS NOT NULL AND merchant_conf >= 0.6 AND profile_conf >= 0.55 AND address_score > 3, false) AS sure, {_CLASS} AS address_class,
  CASE WHEN list_has_any({_consistency._NAME}, regexp_extract_all(lower(address), '[a-z]{{4,}}')) THEN 1 ELSE 0 END + CASE WHEN regexp_matches(lower(merchant), '\\b(ltd|inc|logistics)\\b') AND id % 8 IN (2, 6) THEN 2 ELSE 0 END AS t
  FROM (SELECT *, {list(_SCORES)}[id % 8 + 1] AS address_score, {list(_COUNTS)}[id % 8 + 1] AS n FROM {{located}}))"""
_COUNTERS = with_views("""SELECT counter, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM {address_facts}), 2) AS pct FROM (SELECT unnest(['documents', 'address_classification.' || address_class, 'address_type.' || address_type,
  'address_score.' || CASE WHEN address_score >= 6 THEN 'strong' WHEN address_score >= 4 THEN 'plausible' WHEN address_score >= 1 THEN 'weak' ELSE 'none' END, CASE WHEN address_score >= 4 THEN 'address_quality.high' END, CASE WHEN address_type = 'PO_BOX' THEN 'address_special.po_box' END,
  'multi_address.status.' || multi, 'multi_address.count.' || CASE n WHEN 0 THEN 'zero' WHEN 1 THEN 'single' WHEN 2 THEN 'two' ELSE 'three_plus' END, CASE WHEN n = 0 AND profile_conf < 0.55 THEN 'multi_address.gated.low_doc_confidence' END, CASE WHEN n > 1 THEN 'multi_address.detected' END,
  'consistency.status.' || status, 'consistency.score.' || CASE WHEN fit = 0 THEN 'zero' ELSE 'low' END, CASE WHEN status = 'UNKNOWN' AND profile_conf < 0.55 THEN 'consistency.gated.low_doc_confidence' WHEN status = 'UNKNOWN' AND merchant_conf < 0.6 THEN 'consistency.gated.low_merchant_confidence' END,
  CASE WHEN fit > 0 THEN 'consistency.mismatch_detected' END, CASE WHEN n > 1 AND fit > 0 THEN 'overlap.multi_and_mismatch' END, CASE WHEN n > 1 AND doc_subtype = 'TAX_INVOICE' THEN 'overlap.multi_and_invoice' END, CASE WHEN fit > 0 AND doc_subtype = 'TAX_INVOICE' THEN 'overlap.mismatch_and_invoice' END,
  CASE WHEN n > 1 AND fit > 0 AND doc_subtype = 'TAX_INVOICE' THEN 'overlap.multi_and_mismatch_and_invoice' END]) AS counter FROM {address_facts}) WHERE counter IS NOT NULL GROUP BY counter""")


@query("address_metrics", _COUNTERS)
def address_metrics(spark, sf):
    """Counters and shares of address results over all documents."""
    return M.shares(M.counters(M.address_results(view(spark, sf, "located"))))


@query("address_metrics_stream", _COUNTERS)
def address_metrics_stream(spark, sf):
    """The same counters, running over results as they are written."""
    at = sinks.shared_folder(spark)
    results = M.address_results(view(spark, sf, "located"))
    results.write.parquet(f"{at}/results")
    stream = M.counters(T.files(spark, f"{at}/results", results.schema))
    return M.shares(T.drained(stream, f"{at}/out", f"{at}/checkpoint", "complete"))
