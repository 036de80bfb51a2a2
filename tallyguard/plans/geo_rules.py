"""Queries of geography against currency and tax."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geo_rules as Q
from ..sources.views import VIEWS, view, with_views
from . import rules as _rules  # noqa: F401  its views are used here
from .registry import query

# Country, currencies, tier; and tax names with the days they hold.
COUNTRIES = (("IN", ["INR"], "STRICT"), ("US", ["USD"], "STRICT"), ("DE", ["EUR"], "STRICT"), ("FR", ["EUR"], "STRICT"), ("CA", ["CAD"], "STRICT"), ("AU", ["AUD"], "RELAXED"))
TAXES = (("IN", "GST", "2020-01-01", None), ("IN", "CGST", "2020-01-01", None), ("IN", "SGST", "2020-01-01", None), ("US", "SALES_TAX", "2020-01-01", None), ("DE", "VAT", "2020-01-01", None), ("FR", "VAT", "2020-01-01", None))

#: What a receipt's text and number say of region, currency and tax.
VIEWS["geo_located"] = """
SELECT r.id, CASE WHEN c.id % 37 <> 0 THEN r.merchant END AS merchant, c.geo_country, c.geo_conf, CAST(c.id % 4 AS INT) AS n_geos,
  CASE WHEN c.id % 29 = 0 THEN 'CAD' WHEN c.id % 5 = 0 THEN NULL WHEN r.full_text LIKE '%Total: Rs %' THEN 'INR' WHEN c.id % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
  CASE c.id % 6 WHEN 0 THEN 'GST' WHEN 1 THEN 'VAT' WHEN 2 THEN 'SALES_TAX' WHEN 3 THEN 'CGST' WHEN 4 THEN 'VAT' END AS tax_regime,
  concat(r.full_text, CASE c.id % 7 WHEN 0 THEN ' Airport hotel' WHEN 1 THEN ' City clinic' WHEN 2 THEN ' VAT No 77' WHEN 3 THEN ' VAT TIN 77, VAT 5%' ELSE '' END) AS full_text
FROM {receipts} r JOIN {records} c ON r.id = c.id
"""

_TRAVEL = "(geo_country IN ('IN', 'US', 'DE', 'FR', 'CA') AND regexp_matches(lower(full_text), 'airline|flight|boarding pass|pnr|iata|hotel|resort|inn|lodge|booking|check-in|check out|room|stay|airport|terminal|gate'))"
_CURRENCY = "(n_geos IN (1, 2) AND CASE geo_country WHEN 'IN' THEN currency <> 'INR' WHEN 'US' THEN currency <> 'USD' WHEN 'DE' THEN currency <> 'EUR' WHEN 'FR' THEN currency <> 'EUR' END)"
_LABEL = "(geo_country = 'IN' AND tax_regime = 'VAT' AND regexp_matches(lower(full_text), '\\bvat\\s*(no|tin|reg)') AND NOT regexp_matches(lower(full_text), '\\bvat\\s*[0-9.]+%'))"
_TAX = f"(n_geos IN (1, 2) AND NOT {_LABEL} AND CASE geo_country WHEN 'IN' THEN tax_regime NOT IN ('GST', 'CGST', 'SGST') WHEN 'US' THEN tax_regime <> 'SALES_TAX' WHEN 'DE' THEN tax_regime <> 'VAT' WHEN 'FR' THEN tax_regime <> 'VAT' END)"
_HEALTH = "(regexp_matches(lower(merchant), 'hospital|clinic|health|medical|pharmacy|\\blab\\b|urgent care|dental|imaging') OR regexp_matches(lower(full_text), 'hospital|clinic|health|medical|pharmacy|\\blab\\b|urgent care|dental|imaging'))"


@query("geo_consistency", with_views(f"""SELECT id, ordinal, rule_id, severity, CAST(hundredths * 7 AS DOUBLE) AS thousandths FROM (
  SELECT id, 0 AS ordinal, 'GEO_CROSS_BORDER_HINTS' AS rule_id, 'INFO' AS severity, 0 AS hundredths FROM {{located}} WHERE n_geos = 3
  UNION ALL SELECT id, 1, 'GEO_NO_REGION_HINT', 'INFO', 0 FROM {{located}} WHERE n_geos = 0 AND (currency IS NOT NULL OR tax_regime IS NOT NULL)
  UNION ALL SELECT id, 2, 'GEO_CURRENCY_MISMATCH', CASE WHEN geo_conf < 0.6 THEN 'INFO' WHEN {_TRAVEL} THEN 'WARNING' ELSE 'CRITICAL' END, CASE WHEN geo_conf < 0.6 THEN 0 WHEN {_TRAVEL} THEN 15 ELSE 25 END FROM {{located}} WHERE {_CURRENCY}
  UNION ALL SELECT id, 3, 'GEO_TAX_MISMATCH', CASE WHEN {_TRAVEL} THEN 'WARNING' ELSE 'CRITICAL' END, CASE WHEN {_TRAVEL} THEN 10 ELSE 18 END FROM {{located}} WHERE {_TAX}
  UNION ALL SELECT id, 4, 'GEO_TRAVEL_SOFTENER', 'INFO', 0 FROM {{located}} WHERE {_TRAVEL} AND (coalesce({_CURRENCY}, false) OR coalesce({_TAX}, false))
  UNION ALL SELECT id, 5, 'MERCHANT_CURRENCY_IMPLAUSIBLE', 'CRITICAL', 22 FROM {{located}} WHERE merchant IS NOT NULL AND currency = 'CAD' AND (n_geos = 3 OR (n_geos > 0 AND geo_country = 'US')) AND {_HEALTH}
  UNION ALL SELECT id, 6, 'MERCHANT_CURRENCY_IMPLAUSIBLE', 'CRITICAL', 18 FROM {{located}} WHERE merchant IS NOT NULL AND currency = 'INR' AND (n_geos = 3 OR (n_geos > 0 AND geo_country = 'US')) AND NOT (n_geos > 0 AND geo_country = 'IN') AND {_HEALTH})""", own={"located": VIEWS["geo_located"]}))
def geo_consistency(spark, sf):
    own = F.array("geo_country")
    geos = F.when(F.col("n_geos") == 0, F.array().cast("array<string>")).when(F.col("n_geos") == 3, F.concat(own, F.array(F.lit("US")))).otherwise(own)
    records = view(spark, sf, "geo_located").withColumn("geos", geos)
    countries = spark.createDataFrame(list(COUNTRIES), "country string, currencies array<string>, tier string")
    taxes = spark.createDataFrame(list(TAXES), "country string, tax_name string, effective_from string, effective_to string")
    return Q.consistency(records, countries, taxes, "2024-01-31")
