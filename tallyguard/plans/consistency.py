"""Queries of consistency between a receipt's parts."""

from __future__ import annotations


from ..operators import consistency as K
from ..sources.dims import values_sql
from ..sources.views import VIEWS, view, with_views
from .registry import query

#: Names, times, codes and addresses that fit or don't.
VIEWS["visits"] = """
SELECT id, CASE id % 6 WHEN 0 THEN 'Green Cafe Ltd' WHEN 1 THEN 'City Pharmacy' WHEN 2 THEN 'Mobile World' WHEN 3 THEN 'Harbour Logistics Inc' WHEN 4 THEN NULL ELSE 'Corner Shop' END AS merchant,
  CASE WHEN id % 9 = 0 THEN 'late' ELSE concat(CAST(id % 24 AS STRING), ':15') END AS time, CASE id % 5 WHEN 0 THEN '560001' WHEN 1 THEN '110001' WHEN 2 THEN '999999' WHEN 3 THEN '' ELSE '411001' END AS pin,
  CASE id % 4 WHEN 0 THEN 'Karnataka, India' WHEN 1 THEN 'Delhi' WHEN 2 THEN '' ELSE 'Kerala' END AS state,
  CASE id % 7 WHEN 0 THEN 'P.O. Box 12, Harbour Road' WHEN 1 THEN 'Green Lane 5' ELSE '7 Main Street' END AS address, CAST(id % 10 AS DOUBLE) / 10 AS merchant_conf, CAST(id % 8 AS DOUBLE) / 8 AS profile_conf,
  CASE WHEN id % 3 = 0 THEN 'WEAK_ADDRESS' ELSE 'STRONG_ADDRESS' END AS address_class FROM {claims}
"""
_CAT = "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(merchant, '')), '{'|'.join(w)}') THEN '{n}'" for n, w in K.CATEGORIES) + " ELSE 'retail' END"


@query("business_hours", with_views(f"""SELECT id, category, CAST(h AS INT) AS hour, CAST(CASE WHEN h IS NULL THEN 5 WHEN a = 0 AND b = 24 THEN 10 ELSE greatest(0, 10 - CASE WHEN h < a OR h >= b THEN 3 ELSE 0 END - CASE WHEN h BETWEEN 2 AND 4 THEN 4 ELSE 0 END
  - CASE WHEN (h >= 23 OR h < 2) AND category NOT IN ('pharmacy', 'gas_station', 'airport', 'convenience_store') THEN 2 ELSE 0 END - CASE WHEN h BETWEEN 5 AND 6 AND category NOT IN ('pharmacy', 'gas_station', 'airport', 'restaurant', 'cafe') THEN 2 ELSE 0 END) END AS DOUBLE) / 10.0 AS confidence
  FROM (SELECT id, {_CAT} AS category, TRY_CAST(string_split(time, ':')[1] AS INT) AS h FROM {{visits}}) v JOIN ({values_sql([(k, a, b) for k, (a, b) in K.HOURS.items()])}) AS t(k, a, b) ON v.category = t.k"""))
def business_hours(spark, sf):
    return K.business_hours(view(spark, sf, "visits"))


@query("postal_states", with_views(f"""SELECT id, CASE WHEN pin = '' THEN 'incomplete_data' WHEN expected IS NULL THEN 'unknown_prefix' WHEN state = '' OR contains(lower(state), expected) OR contains(expected, lower(state)) THEN 'valid' ELSE 'mismatch' END AS reason FROM {{visits}} LEFT JOIN ({values_sql(K.CIRCLES)}) AS c(circle, expected) ON pin[1:2] = circle"""))
def postal_states(spark, sf):
    return K.postal_states(view(spark, sf, "visits"), K.circles(spark))


_NAME = "list_filter(regexp_extract_all(lower(merchant), '[a-z]{4,}'), lambda w: w NOT IN ('ltd', 'llp', 'inc', 'corp', 'company', 'co', 'pvt', 'private', 'limited'))"


@query("merchant_address", with_views(f"""SELECT id, CASE WHEN NOT sure THEN 'UNKNOWN' WHEN t = 0 THEN 'CONSISTENT' WHEN t = 1 THEN 'WEAK_MISMATCH' ELSE 'MISMATCH' END AS status, CAST(CASE WHEN sure THEN least(t, 2) ELSE 0 END AS DOUBLE) / 10.0 AS score FROM (SELECT id, coalesce(merchant IS NOT NULL AND merchant_conf >= 0.6 AND profile_conf >= 0.55 AND address_class = 'STRONG_ADDRESS', false) AS sure,
  CASE WHEN list_has_any({_NAME}, regexp_extract_all(lower(address), '[a-z]{{4,}}')) THEN 1 ELSE 0 END + CASE WHEN regexp_matches(lower(merchant), '\\b(ltd|llp|inc|corp|company|logistics|services|solutions|industries)\\b') AND regexp_matches(lower(address), '\\b(p\\.?\\s*o\\.?\\s*box)\\b') THEN 2 ELSE 0 END AS t FROM {{visits}})"""))
def merchant_address(spark, sf):
    return K.merchant_address(view(spark, sf, "visits"))
