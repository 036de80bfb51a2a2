"""Queries of the gated score."""

from __future__ import annotations

from ..operators import rules as R
from ..operators import scoring as S
from ..sources.views import CLAIMS_AS_OF, ORACLE_VIEWS, VIEWS, view, with_views
from . import rules as _rules  # noqa: F401  its views are used here
from .registry import query

#: What learned rules said of the records, in their own words.
VIEWS["learned_hits"] = """
SELECT id, 0 AS ordinal, concat('Pattern detected: spacing_anomaly, identified by users ', CAST(id % 9 AS STRING), ' times. Confidence adjustment: +0.15') AS raw FROM {claims} WHERE id % 4 = 0
UNION ALL SELECT id, 1, 'Missing critical elements: Total, date. Pattern detected: missing_elements. Confidence adjustment: 0.2' FROM {claims} WHERE id % 5 = 0
UNION ALL SELECT id, 2, 'missing critical elements: date, total. pattern detected: Missing_Elements. confidence adjustment: +0.35' FROM {claims} WHERE id % 10 = 0
UNION ALL SELECT id, 3, 'Pattern detected: invalid_address. Confidence adjustment: +.1' FROM {claims} WHERE id % 6 = 1
UNION ALL SELECT id, 4, 'Pattern detected: font_mix. Confidence adjustment: +0.9' FROM {claims} WHERE id % 7 = 2
UNION ALL SELECT id, 5, 'Pattern detected: known_vendor. Confidence adjustment: -0.3' FROM {claims} WHERE id % 9 = 4
UNION ALL SELECT id, 6, concat('Seen before: ', issue) FROM {claims} WHERE id % 11 = 0
"""

_CLASS = """CASE WHEN doc_subtype IN ('POS_RECEIPT', 'POS_RESTAURANT', 'POS_RETAIL', 'POS_FUEL') OR starts_with(doc_subtype, 'POS_') THEN 'POS_RECEIPT' WHEN doc_subtype IN ('TAX_INVOICE', 'VAT_INVOICE') THEN 'TAX_INVOICE' WHEN contains(doc_subtype, 'INVOICE') THEN 'COMMERCIAL_INVOICE' ELSE 'UNKNOWN' END"""
ORACLE_VIEWS["passed"] = f"""SELECT id, ordinal, rule_id, CASE WHEN class = 'COMMERCIAL_INVOICE' AND rule_id = 'R1_SUSPICIOUS_SOFTWARE' THEN 'INFO' ELSE severity END AS severity, hundredths FROM (
  SELECT f.*, r.doc_subtype, {_CLASS} AS class FROM {{fired}} f JOIN {{records}} r ON f.id = r.id) WHERE CASE rule_id
  WHEN 'R7_TOTAL_MISMATCH' THEN doc_subtype IN ('POS_RECEIPT', 'POS_RESTAURANT', 'POS_RETAIL', 'FUEL')
  WHEN 'R7B_INVOICE_TOTAL_RECONCILIATION' THEN doc_subtype IN ('COMMERCIAL_INVOICE', 'TAX_INVOICE', 'SUBSCRIPTION')
  WHEN 'R9B_DOC_TYPE_UNKNOWN_OR_MIXED' THEN doc_subtype IN ('POS_RECEIPT', 'POS_RESTAURANT', 'POS_RETAIL', 'FUEL')
  WHEN 'R16_SUSPICIOUS_DATE_GAP' THEN class NOT IN ('COMMERCIAL_INVOICE', 'TAX_INVOICE') ELSE true END"""
ORACLE_VIEWS["learned_once"] = """SELECT * FROM (SELECT id, ordinal, lower(raw) AS raw, coalesce(nullif(lower(regexp_extract(raw, '(?i)pattern detected:\\s*([a-zA-Z0-9_\\-]+)', 1)), ''), 'unknown') AS pattern,
  list_sort(list_distinct(list_filter(list_transform(string_split(regexp_extract(raw, '(?i)missing critical elements:\\s*([^.]+)', 1), ','), lambda x: lower(trim(x))), lambda x: x <> ''))) AS missing,
  coalesce(CAST(round(TRY_CAST(regexp_extract(raw, '(?i)confidence adjustment:\\s*([+-]?[0-9]*\\.?[0-9]+)', 1) AS DOUBLE) * 1000) AS BIGINT), 0) AS t FROM {learned_hits})
  QUALIFY row_number() OVER (PARTITION BY id, pattern, missing ORDER BY ordinal) = 1"""
_ENABLED = "(profile_conf >= 0.55 AND NOT (geo_country = 'UNKNOWN' AND geo_conf < 0.30) AND NOT (doc_subtype IN ('MISC', 'UNKNOWN') AND profile_conf < 0.55))"
ORACLE_VIEWS["effects"] = f"""SELECT id, class, count(*) AS n_learned, count(*) FILTER (hush) AS n_suppressed, sum(CASE WHEN hush THEN 0 ELSE greatest(-500, least(500, t)) END) AS total FROM (
  SELECT l.id, l.t, {_CLASS} AS class,
    ((contains(raw, 'missing_elements') OR contains(raw, 'invalid_address')) AND NOT {_ENABLED})
    OR (doc_subtype = 'COMMERCIAL_INVOICE' AND pattern IN ('spacing_anomaly', 'missing_elements', 'invalid_address'))
    OR (pattern = 'missing_elements' AND starts_with(doc_subtype, 'POS_') AND merchant IS NOT NULL AND n_currencies > 0 AND (coalesce(total, 0) <> 0 OR items_sum IS NOT NULL))
    OR (pattern = 'invalid_address' AND starts_with(doc_subtype, 'POS_') AND merchant IS NOT NULL AND n_currencies > 0)
    OR (pattern = 'spacing_anomaly' AND (NOT {_ENABLED} OR profile_conf < 0.6 OR (starts_with(doc_subtype, 'POS_') AND upper_ratio > 0.5))) AS hush
  FROM {{learned_once}} l JOIN {{records}} r ON l.id = r.id) GROUP BY id, class"""


@query("gated_score", with_views(f"""SELECT id, least(1000, greatest(0, base + delta)) / 1000.0::DOUBLE AS score, CASE WHEN hard OR n_critical >= 2 OR base + delta >= 700 THEN 'fake' WHEN base + delta >= 350 THEN 'suspicious' ELSE 'real' END AS label,
  CAST(n_fired - n_passed AS BIGINT) AS n_skipped, delta, n_learned, n_suppressed,
  concat_ws(',', CASE WHEN NOT enabled THEN 'GATE_MISSING_FIELDS' END, rules, nullif(array_to_string(list_transform(range(n_learned), lambda x: 'LR_LEARNED_PATTERN'), ','), ''), CASE WHEN capped THEN 'LR_CAP_APPLIED' END) AS trail FROM (
  SELECT r.id, {_ENABLED} AS enabled, coalesce(p.base, 0)::DOUBLE AS base, coalesce(p.hard, false) AS hard, coalesce(p.n_critical, 0) AS n_critical, coalesce(p.n, 0) AS n_passed, coalesce(f.n, 0) AS n_fired, p.rules,
    coalesce(e.n_learned, 0) AS n_learned, coalesce(e.n_suppressed, 0) AS n_suppressed, coalesce(e.class = 'COMMERCIAL_INVOICE' AND e.total > 100, false) AS capped,
    CAST(CASE WHEN e.id IS NULL THEN 0 ELSE greatest(-1000, least(1000, CASE WHEN e.class = 'COMMERCIAL_INVOICE' THEN least(100, e.total) ELSE e.total END)) END AS BIGINT) AS delta
  FROM {{records}} r LEFT JOIN {{effects}} e ON r.id = e.id LEFT JOIN (SELECT id, count(*) AS n FROM {{fired}} GROUP BY id) f ON r.id = f.id
  LEFT JOIN (SELECT id, count(*) AS n, sum(CASE WHEN severity = 'HARD_FAIL' THEN hundredths * 10 ELSE hundredths * 7 END) AS base, bool_or(severity = 'HARD_FAIL') AS hard, count(*) FILTER (severity = 'CRITICAL') AS n_critical, string_agg(rule_id, ',' ORDER BY ordinal) AS rules FROM {{passed}} GROUP BY id) p ON r.id = p.id)"""))
def gated_score(spark, sf):
    return S.gated_score(R.evaluate(view(spark, sf, "records"), R.registry(CLAIMS_AS_OF)), view(spark, sf, "learned_hits"))


@query("gated_label_changes", with_views(f"""SELECT {_CLASS} AS profile, l.label AS ungated, CASE WHEN coalesce(p.hard, false) OR coalesce(p.n_critical, 0) >= 2 OR coalesce(p.base, 0) + coalesce(e.delta, 0) >= 700 THEN 'fake' WHEN coalesce(p.base, 0) + coalesce(e.delta, 0) >= 350 THEN 'suspicious' ELSE 'real' END AS gated, count(*) AS n
  FROM {{records}} r JOIN {{labelled}} l ON r.id = l.id LEFT JOIN (SELECT id, greatest(-1000, least(1000, CASE WHEN class = 'COMMERCIAL_INVOICE' THEN least(100, total) ELSE total END)) AS delta FROM {{effects}}) e ON r.id = e.id
  LEFT JOIN (SELECT id, sum(CASE WHEN severity = 'HARD_FAIL' THEN hundredths * 10 ELSE hundredths * 7 END) AS base, bool_or(severity = 'HARD_FAIL') AS hard, count(*) FILTER (severity = 'CRITICAL') AS n_critical FROM {{passed}} GROUP BY id) p ON r.id = p.id GROUP BY ALL"""))
def gated_label_changes(spark, sf):
    """How many records of each profile have which label without and with the gates."""
    evaluated = R.evaluate(view(spark, sf, "records"), R.registry(CLAIMS_AS_OF))
    plain = R.score_and_label(evaluated).select("id", "label")
    gated = S.gated_score(evaluated, view(spark, sf, "learned_hits")).select("id", "label")
    of = evaluated.select("id", S.profile_of(evaluated["doc_subtype"]).alias("profile"))
    joined = of.join(plain.withColumnRenamed("label", "ungated"), "id").join(gated.withColumnRenamed("label", "gated"), "id")
    return joined.groupBy("profile", "ungated", "gated").count().withColumnRenamed("count", "n")
