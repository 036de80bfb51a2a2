"""Queries of rule gates, address rules and checks of amounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates as G
from ..operators import rules as R
from ..sources.dims import values_sql
from ..sources.views import CLAIMS_AS_OF, view, with_views
from . import rules as _rules  # noqa: F401  its views are used here
from .registry import query

_M = values_sql([(r, s, m) for r, row in G.MATRIX.items() for s, m in row.items()])
_LISTED = ", ".join(f"'{r}'" for r in G.MATRIX)


@query("rule_gating", with_views(f"""SELECT f.id, f.rule_id, CASE WHEN f.rule_id IN ({_LISTED}) THEN coalesce(m.mode, 'FORBIDDEN') WHEN f.rule_id = 'R16_SUSPICIOUS_DATE_GAP' AND r.doc_subtype IN ('COMMERCIAL_INVOICE', 'TAX_INVOICE') THEN 'AUDIT' WHEN f.rule_id = 'R1_SUSPICIOUS_SOFTWARE' AND r.doc_subtype = 'COMMERCIAL_INVOICE' THEN 'AUDIT' ELSE 'BLOCK' END AS mode,
  CASE WHEN r.doc_subtype = 'COMMERCIAL_INVOICE' AND f.rule_id IN ('R16_SUSPICIOUS_DATE_GAP', 'R1_SUSPICIOUS_SOFTWARE') THEN 'INFO' ELSE f.severity END AS severity FROM {{fired}} f JOIN {{records}} r ON f.id = r.id LEFT JOIN ({_M}) AS m(rule, s, mode) ON m.rule = f.rule_id AND m.s = r.doc_subtype"""))
def rule_gating(spark, sf):
    events = R.evaluate(view(spark, sf, "records"), R.registry(CLAIMS_AS_OF)).select("id", "doc_subtype", F.explode("events").alias("e")).select("id", "doc_subtype", "e.rule_id", "e.severity")
    return G.gate(events, G.matrix(spark), G.profiles(spark))


@query("address_rules", with_views("""SELECT id, CASE WHEN profile_conf < 0.55 THEN 'RULE_ADDR_SUPPRESSION_LOW_CONFIDENCE' WHEN ocr_conf < 0.6 THEN 'RULE_ADDR_SUPPRESSION_WEAK_MERCHANT' WHEN profile_conf >= 0.8 AND inv AND id % 2 = 0 AND id % 3 = 0 THEN 'RULE_ADDR_MULTI_AND_MISMATCH'
  WHEN profile_conf >= 0.7 AND lower(producer) LIKE '%canva%' AND id % 2 = 0 AND num_lines % 4 < 2 THEN 'RULE_ADDR_TEMPLATE_EDITING_SUSPICION' WHEN profile_conf >= 0.8 AND inv AND id % 2 = 0 AND num_lines % 4 < 2 THEN 'RULE_ADDR_MULTI_IN_INVOICE_HIGHCONF' END AS rule
  FROM (SELECT *, doc_subtype IN ('TAX_INVOICE', 'COMMERCIAL_INVOICE') AS inv FROM {records})"""))
def address_rules(spark, sf):
    k, lines = F.col("id"), F.col("num_lines") % 4
    kind = F.when(lines == 0, "STRONG_ADDRESS").when(lines == 1, "PLAUSIBLE_ADDRESS").otherwise("WEAK_ADDRESS")
    return G.address_rules(view(spark, sf, "records").select("id", "doc_subtype", "profile_conf", F.col("ocr_conf").alias("merchant_conf"), (k % 2 == 0).alias("multi"), (k % 3 == 0).alias("mismatch"), kind.alias("address_class"), F.lower("producer").contains("canva").alias("producer_odd")))


@query("amount_signals", with_views("""SELECT id, 'AMOUNT_MATH_MISMATCH' AS signal, CASE WHEN abs(total - (subtotal + tax)) / total * 100 > 5 THEN 'high' ELSE 'medium' END AS severity, least(1.0::DOUBLE, abs(total - (subtotal + tax)) / total * 100 / 10) AS confidence FROM {records} WHERE total <> 0 AND subtotal <> 0 AND tax <> 0 AND abs(total - (subtotal + tax)) > total * 0.01::DOUBLE
  UNION ALL SELECT id, 'TAX_RATE_UNREALISTIC', 'high', 0.8 FROM {records} WHERE subtotal <> 0 AND tax <> 0 AND tax / subtotal * 100 > 30 UNION ALL SELECT id, 'TAX_RATE_NEGATIVE', 'critical', 0.95 FROM {records} WHERE subtotal <> 0 AND tax <> 0 AND tax / subtotal * 100 < 0
  UNION ALL SELECT id, 'ROUND_NUMBER_PATTERN', 'low', 0.4 FROM {records} WHERE coalesce((total >= 100 AND total % 100 = 0)::INT, 0) + coalesce((subtotal >= 100 AND subtotal % 100 = 0)::INT, 0) + coalesce((tax >= 100 AND tax % 100 = 0)::INT, 0) >= 2
  UNION ALL SELECT id, 'ITEMS_SUM_MISMATCH', 'medium', 0.7 FROM {records} WHERE items_sum <> 0 AND subtotal <> 0 AND abs(items_sum - subtotal) > subtotal * 0.01::DOUBLE"""))
def amount_signals(spark, sf):
    return G.amount_signals(view(spark, sf, "records"))
