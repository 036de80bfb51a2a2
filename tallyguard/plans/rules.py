"""Queries of rules, ensemble and unified signals over receipt records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensemble as N
from ..operators import rules as R
from ..sources.views import CLAIMS_AS_OF, ORACLE_VIEWS, VIEWS, view, with_views
from .registry import query

VIEWS["records"] = """
SELECT c.id, CASE WHEN c.id % 37 <> 0 THEN c.dealer_name END AS merchant, CASE WHEN c.id % 31 <> 0 THEN c.total_c / CAST(100 AS DOUBLE) END AS total, (c.parts_c + c.labor_c) / CAST(100 AS DOUBLE) AS subtotal, c.tax_c / CAST(100 AS DOUBLE) AS tax,
  CASE WHEN c.id % 62 <> 0 THEN (c.parts_c + c.labor_c + c.tax_c + CASE WHEN c.id % 13 = 0 THEN 9000 WHEN c.id % 17 = 0 THEN c.total_c * 3 // 100 ELSE 0 END) / CAST(100 AS DOUBLE) END AS items_sum,
  CASE WHEN c.country_code = 'IN' THEN CAST(abs(c.tax_c) // 200 AS DOUBLE) END AS cgst, CASE WHEN c.country_code = 'IN' THEN CAST(abs(c.tax_c) // 200 + CASE WHEN c.id % 19 = 0 THEN 7 ELSE 0 END AS DOUBLE) END AS sgst,
  CASE WHEN c.id % 58 = 0 THEN 4.0 END AS igst, CASE WHEN c.id % 3 = 0 THEN 12.0 END AS shipping, CASE WHEN c.id % 5 = 0 THEN 5.25 END AS discount,
  CASE WHEN c.id % 9 = 8 THEN 'UNKNOWN' ELSE c.country_code END AS geo_country, CAST(c.id % 10 AS DOUBLE) / 10 AS geo_conf, CAST(c.id % 11 AS DOUBLE) / 10 AS profile_conf, CAST(c.id % 21 AS DOUBLE) / 20 AS ocr_conf,
  CASE c.id % 6 WHEN 0 THEN 'POS_RETAIL' WHEN 1 THEN 'TAX_INVOICE' WHEN 2 THEN 'MISC' WHEN 3 THEN 'FUEL' WHEN 4 THEN 'PARKING' ELSE 'COMMERCIAL_INVOICE' END AS doc_subtype,
  CAST(c.id % 140 AS INT) AS num_lines, CAST(c.id % 12 AS DOUBLE) / 10 AS numeric_ratio, CAST(c.id % 13 AS DOUBLE) / 10 AS upper_ratio, CAST(c.id % 60 AS INT) AS unique_chars, CAST(c.id % 3 AS INT) AS n_currencies,
  CASE WHEN c.id % 41 <> 0 THEN CAST(c.claim_date AS DATE) END AS receipt_date, CAST(c.decision_date AS DATE) AS creation_date, CAST(c.decision_date AS DATE) + CAST(c.id % 45 - 3 AS INT) AS mod_date,
  CASE c.id % 23 WHEN 0 THEN 'Adobe Photoshop 21' WHEN 1 THEN 'Canva' WHEN 2 THEN 'WPS Writer' WHEN 3 THEN 'iText' WHEN 4 THEN 'Figma' WHEN 5 THEN 'Pixlr X' WHEN 6 THEN 'Smallpdf' WHEN 7 THEN 'sejda pdf' WHEN 8 THEN 'GIMP 2' ELSE 'Scanner 2' END AS producer, CASE c.id % 83 WHEN 0 THEN 'exact' WHEN 1 THEN 'fuzzy' ELSE 'new' END AS duplicate,
  CAST(c.id % 53 AS INT) AS date_span, CASE c.id % 29 WHEN 0 THEN 'looks_like_label' WHEN 1 THEN 'looks_like_identifier' WHEN 2 THEN 'too_short' END AS merchant_issue,
  CASE c.id % 7 WHEN 0 THEN 'ambiguous' WHEN 1 THEN 'unknown' ELSE 'receipt' END AS doc_type_hint, CAST(c.id % 4 AS INT) AS n_structural,
  CASE c.id % 5 WHEN 0 THEN 'INVOICE' WHEN 1 THEN 'COMMERCIAL' ELSE 'TRANSACTIONAL' END AS doc_family,
  CASE c.id % 8 WHEN 0 THEN 'NOT_AN_ADDRESS' WHEN 1 THEN 'WEAK_ADDRESS' WHEN 2 THEN 'PLAUSIBLE_ADDRESS' WHEN 3 THEN 'STRONG_ADDRESS' END AS address_class, CAST(c.id % 9 AS INT) AS address_score, c.id % 71 = 0 AS address_fake,
  CASE c.id % 17 WHEN 0 THEN 'INCONSISTENT' WHEN 1 THEN 'SUSPICIOUS' ELSE 'CONSISTENT' END AS address_verdict, CAST(c.id % 10 AS DOUBLE) / 10 AS address_verdict_conf,
  CASE WHEN c.id % 12 = 0 THEN CAST(c.id % 90 AS DOUBLE) / 10 END AS qty_rate_off, c.id % 43 = 0 AS out_of_order,
  CASE c.id % 11 WHEN 0 THEN 'invalid_pan_format' WHEN 1 THEN 'invalid_state_code' WHEN 2 THEN 'missing_z_at_pos14' WHEN 3 THEN 'state_pin_mismatch' WHEN 4 THEN '' END AS gstin_issue
FROM {claims} c
"""

_ENABLED = "(profile_conf >= 0.55 AND NOT (geo_country = 'UNKNOWN' AND geo_conf < 0.30) AND NOT (doc_subtype IN ('MISC', 'UNKNOWN') AND profile_conf < 0.55))"
_MILD = "(doc_subtype LIKE 'POS\\_%' ESCAPE '\\' AND ocr_conf < 0.5 AND ratio > 0 AND ratio <= 0.05)"
_RATES = " OR ".join(f"(geo_country = '{c}' AND (rate < {lo - 1.0!r} OR rate > {hi + 2.0!r}))" for c, (lo, hi) in R.TAX_RANGES.items())
_UNCLEAR = "(doc_type_hint IN ('ambiguous', 'unknown') AND (starts_with(doc_subtype, 'POS_') OR doc_subtype = 'FUEL'))"
_SURE_POS, _LOOSE = "(profile_conf >= 0.8 AND starts_with(doc_subtype, 'POS_'))", "((doc_family = 'TRANSACTIONAL' AND profile_conf < 0.4) OR n_structural = 3)"
_USD = "(total * CASE geo_country WHEN 'IN' THEN 0.012::DOUBLE ELSE 1.0::DOUBLE END)"
#: No dealer's name tells a trade here, so the subtype alone sets the most.
_MOST = "CASE WHEN profile_conf >= 0.7 AND doc_subtype = 'FUEL' THEN 500 WHEN profile_conf >= 0.7 AND doc_subtype = 'PARKING' THEN 200 END"
_WARN16 = "(profile_conf < 0.4 AND gap < 540)"
#: rule, condition, severity, hundredths: as SQL, in the registry's order.
_RULES = [
    ("R_DUPLICATE_RECEIPT", "duplicate = 'exact'", "'HARD_FAIL'", "60"), ("R_DUPLICATE_RECEIPT", "duplicate = 'fuzzy'", "'CRITICAL'", "40"),
    ("R1_SUSPICIOUS_SOFTWARE", "list_has_any(regexp_extract_all(lower(producer), '[a-z]+'), ['canva', 'photoshop', 'illustrator', 'sketch', 'figma', 'affinity', 'gimp', 'inkscape', 'coreldraw', 'pixlr', 'fotor', 'befunky', 'snappa', 'crello', 'desygner'])", "'HARD_FAIL'", "50"), ("R1_SUSPICIOUS_SOFTWARE", "list_has_any(regexp_extract_all(lower(producer), '[a-z]+'), ['wps', 'ilovepdf', 'smallpdf', 'pdfcandy', 'sejda'])", "'WARNING'", "10"),
    ("R1B_METADATA_TIMESTAMP_ANOMALY", "touched > 1", "CASE WHEN touched > 30 THEN 'CRITICAL' ELSE 'WARNING' END", "CASE WHEN touched > 30 THEN 25 ELSE 8 END"),
    ("R5_NO_AMOUNTS", f"{_ENABLED} AND total IS NULL AND items_sum IS NULL", "'CRITICAL'", "40"), ("R6_NO_TOTAL_LINE", f"{_ENABLED} AND total IS NULL AND items_sum IS NOT NULL", "'CRITICAL'", "15"),
    ("R7_TOTAL_MISMATCH", "ratio > 0.02", f"CASE WHEN {_MILD} THEN 'WARNING' ELSE 'CRITICAL' END", f"CASE WHEN {_MILD} THEN 15 ELSE 40 END"),
    ("R7B_INVOICE_TOTAL_RECONCILIATION", "profile_conf >= 0.75 AND expected > 0 AND abs(total - expected) >= 1.0 AND off > tol", "CASE WHEN off > 2 * tol THEN 'WARNING' ELSE 'INFO' END", "CASE WHEN off > 2 * tol THEN 8 ELSE 0 END"),
    ("R8_NO_DATE", f"{_ENABLED} AND receipt_date IS NULL", "CASE WHEN ocr_conf < 0.4 THEN 'WARNING' ELSE 'CRITICAL' END", "CASE WHEN ocr_conf < 0.4 THEN 12 ELSE 20 END"),
    ("R9_NO_MERCHANT", "merchant IS NULL", f"CASE WHEN {_ENABLED} THEN 'CRITICAL' ELSE 'WARNING' END", f"CASE WHEN {_ENABLED} THEN 15 ELSE 8 END"),
    ("R10_TOO_FEW_LINES", "num_lines < 5", "'INFO'", "15"), ("R11_TOO_MANY_LINES", "num_lines > 120", "'INFO'", "10"), ("R12_HIGH_NUMERIC_RATIO", "numeric_ratio > 0.8 AND num_lines > 10", "'INFO'", "10"),
    ("R13_HIGH_UPPERCASE", "upper_ratio > 0.8 AND num_lines > 5", "'INFO'", "10"), ("R14_LOW_CHAR_VARIETY", "unique_chars < 15 AND num_lines > 5", "'INFO'", "15"),
    ("R_FUTURE_DATE", "ahead > 1", "CASE WHEN ahead > 7 THEN 'HARD_FAIL' ELSE 'CRITICAL' END", "CASE WHEN ahead > 7 THEN 45 ELSE 30 END"), ("R15_IMPOSSIBLE_DATE_SEQUENCE", "receipt_date > creation_date", "'HARD_FAIL'", "40"),
    ("R16_SUSPICIOUS_DATE_GAP", "gap > 90", f"CASE WHEN {_WARN16} THEN 'WARNING' ELSE 'CRITICAL' END", f"CASE WHEN {_WARN16} THEN 10 ELSE 35 END"),
    ("R_TAX_RATE_ANOMALY", f"tax > 0 AND geo_conf >= 0.6 AND subtotal > 0 AND ({_RATES})", "'WARNING'", "10"),
    ("R_ROUND_TOTAL", "total % unit = 0 AND total >= unit * 2 AND doc_subtype NOT IN ('PARKING', 'TOLL', 'SUBSCRIPTION', 'MEMBERSHIP', 'DONATION', 'RENT', 'UTILITY', 'INSURANCE')", "'WARNING'", "CASE WHEN total % (unit * 10) = 0 AND total >= unit * 10 THEN 10 ELSE 6 END + CASE WHEN doc_subtype IN ('FUEL', 'POS_RETAIL') THEN 4 ELSE 0 END"),
    ("R_CURRENCY_INCONSISTENCY", "n_currencies >= 2", "'WARNING'", "10"),
    ("R7D_TAX_COMPONENT_VERIFICATION", "geo_country = 'IN' AND cgst > 0 AND sgst > 0 AND abs(cgst - sgst) > greatest(0.5, cgst * 0.02)", "'CRITICAL'", "18"),
    ("R7D_TAX_COMPONENT_VERIFICATION", "geo_country = 'IN' AND parts > 0 AND tax > 0 AND abs(parts - tax) > greatest(1.0, tax * 0.02)", "'WARNING'", "12"),
    ("R7D_TAX_COMPONENT_VERIFICATION", "geo_country = 'IN' AND igst > 0 AND cgst > 0", "'CRITICAL'", "20"),
    ("R7D_TAX_COMPONENT_VERIFICATION", "geo_country = 'IN' AND subtotal > 0 AND parts > 0 AND least(abs(pr - 0), abs(pr - 5), abs(pr - 12), abs(pr - 18), abs(pr - 28)) > 2.0", "'INFO'", "6"),
    ("R_DATE_CONFLICT", "date_span > 30", "'CRITICAL'", "CASE WHEN starts_with(doc_subtype, 'POS_') THEN 35 ELSE 25 END"),
    ("MERCHANT_IMPLAUSIBLE", f"{_ENABLED} AND merchant IS NOT NULL AND merchant_issue IS NOT NULL", "'CRITICAL'", "CASE WHEN merchant_issue LIKE 'looks%' THEN 18 ELSE 12 END"),
    ("MERCHANT_IMPLAUSIBLE_GATED", f"NOT {_ENABLED} AND merchant IS NOT NULL AND merchant_issue IS NOT NULL", "'INFO'", "0"),
    ("R9B_DOC_TYPE_UNKNOWN_GATED", f"{_UNCLEAR} AND {_SURE_POS}", "'INFO'", "0"),
    ("R9B_DOC_TYPE_UNKNOWN_OR_MIXED", f"{_UNCLEAR} AND NOT {_SURE_POS}", f"CASE WHEN {_LOOSE} THEN 'WARNING' ELSE 'CRITICAL' END", f"CASE WHEN {_LOOSE} THEN 8 WHEN n_structural = 2 THEN 7.5 ELSE 15 END"),
    ("R_AMOUNT_PLAUSIBILITY", f"total > 0 AND {_USD} > 2 * {_MOST}", f"CASE WHEN {_USD} > 5 * {_MOST} THEN 'CRITICAL' ELSE 'WARNING' END", f"CASE WHEN {_USD} > 5 * {_MOST} THEN 20 ELSE 10 END"),
    ("R_QTY_RATE_MISMATCH", "qty_rate_off > 1.5", "'WARNING'", "CASE WHEN qty_rate_off > 5 THEN 10 ELSE 6 END"),
    ("R_ADDRESS_FAKE", "address_fake", "'CRITICAL'", "30"),
    ("R_ADDRESS_MISSING", "(doc_family <> 'TRANSACTIONAL' OR doc_subtype LIKE '%INVOICE%') AND (address_class IS NULL OR address_class = 'NOT_AN_ADDRESS') AND profile_conf >= 0.6", "'WARNING'", "10"),
    ("R_ADDRESS_IMPLAUSIBLE", "address_class = 'WEAK_ADDRESS' AND NOT starts_with(doc_subtype, 'POS_') AND address_score <= 2", "'WARNING'", "8"),
    ("R_ADDRESS_MERCHANT_MISMATCH", "address_verdict <> 'CONSISTENT' AND address_verdict_conf >= 0.6", "CASE address_verdict WHEN 'INCONSISTENT' THEN 'CRITICAL' ELSE 'WARNING' END", "CASE address_verdict WHEN 'INCONSISTENT' THEN 15 ELSE 8 END"),
    ("R_STRUCTURE_ORDER", "out_of_order", "'WARNING'", "10"),
    ("R_GSTIN_FORMAT", "geo_country = 'IN' AND geo_conf >= 0.5 AND gstin_issue IS NOT NULL", "CASE gstin_issue WHEN '' THEN 'INFO' WHEN 'missing_z_at_pos14' THEN 'WARNING' ELSE 'CRITICAL' END", "CASE gstin_issue WHEN '' THEN 0 WHEN 'missing_z_at_pos14' THEN 8 ELSE 15 END"),
    ("R_HANDWRITTEN_RECEIPT", "ocr_conf < 0.35", "'WARNING'", "CASE WHEN ocr_conf < 0.20 THEN 12 ELSE 8 END"),
]
ORACLE_VIEWS["judged"] = f"""SELECT *, abs(total - items_sum) / nullif(total, 0) AS ratio, CASE WHEN total > 0 THEN abs(total - expected) / total ELSE 0.0 END AS off, parts / nullif(subtotal, 0) * 100 AS pr FROM (SELECT *, subtotal + tax + coalesce(shipping, 0) - coalesce(discount, 0) AS expected,
  CASE WHEN ocr_conf < 0.5 THEN 0.10::DOUBLE WHEN ocr_conf < 0.7 THEN 0.05::DOUBLE ELSE 0.02::DOUBLE END * CASE WHEN doc_subtype = 'TAX_INVOICE' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS tol, tax / nullif(subtotal, 0) * 100 AS rate,
  CASE WHEN geo_country IN ('IN', 'JP', 'KR', 'ID') THEN 100.0::DOUBLE ELSE 10.0::DOUBLE END AS unit, coalesce(cgst, 0) + coalesce(sgst, 0) + coalesce(igst, 0) AS parts, receipt_date - DATE '{CLAIMS_AS_OF}' AS ahead, creation_date - receipt_date AS gap, mod_date - creation_date AS touched FROM {{records}})"""
ORACLE_VIEWS["fired"] = " UNION ALL ".join(f"SELECT id, {i} AS ordinal, '{n}' AS rule_id, {s} AS severity, {w} AS hundredths FROM {{judged}} WHERE {c}" for i, (n, c, s, w) in enumerate(_RULES))
ORACLE_VIEWS["scored"] = """SELECT r.id, CAST(least(1000, coalesce(sum(CASE WHEN severity = 'HARD_FAIL' THEN hundredths * 10 ELSE hundredths * 7 END), 0)) AS DOUBLE) / 1000.0 AS score, coalesce(bool_or(severity = 'HARD_FAIL'), false) AS hard_fail,
  count(*) FILTER (severity = 'CRITICAL') AS n_critical, coalesce(string_agg(rule_id, ',' ORDER BY ordinal), '') AS rules FROM {records} r LEFT JOIN {fired} f ON r.id = f.id GROUP BY r.id"""
ORACLE_VIEWS["labelled"] = "SELECT *, CASE WHEN hard_fail OR n_critical >= 2 OR score >= 0.7 THEN 'fake' WHEN score >= 0.35 THEN 'suspicious' ELSE 'real' END AS label FROM {scored}"


def evaluated(spark, sf):
    return R.evaluate(view(spark, sf, "records"), R.registry(CLAIMS_AS_OF))


def events_of(spark, sf):
    return R.exploded(evaluated(spark, sf))


@query("rule_events", with_views("SELECT id, ordinal, rule_id, severity, CAST(CASE WHEN severity = 'HARD_FAIL' THEN hundredths * 10 ELSE hundredths * 7 END AS DOUBLE) AS thousandths FROM {fired}"))
def rule_events(spark, sf):
    return events_of(spark, sf).select("id", "e.*")


@query("score_and_label", with_views("SELECT id, CAST(score AS DOUBLE) AS score, label, rules, n_critical, hard_fail FROM {labelled}"))
def score_and_label(spark, sf):
    return R.score_and_label(evaluated(spark, sf))


@query("rule_statistics", with_views("SELECT rule_id, severity, count(*) AS n, count(DISTINCT id) AS n_records FROM {fired} GROUP BY ALL"))
def rule_statistics(spark, sf):
    events = events_of(spark, sf)
    return events.groupBy("e.rule_id", "e.severity").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_records"))


@query("ensemble_verdict", with_views("""SELECT id, CASE WHEN hard_fail OR (label = 'fake' AND (score >= 0.85 OR n_critical >= 1)) THEN 'fake' ELSE label END AS final_label,
  CAST(CASE WHEN hard_fail THEN 186000 WHEN label = 'fake' AND (score >= 0.85 OR n_critical >= 1) THEN 170000 WHEN label = 'fake' THEN least(190000, 120000 + CAST(round(score * 2000) AS BIGINT) * 35) WHEN label = 'real' THEN least(190000, 100000 + (2000 - CAST(round(score * 2000) AS BIGINT)) * 45) ELSE 130000 END AS DOUBLE) / 200000 AS confidence,
  CASE WHEN label = 'fake' THEN 'reject' WHEN label = 'real' THEN 'approve' ELSE 'human_review' END AS action FROM {labelled}"""))
def ensemble_verdict(spark, sf):
    return N.verdict(R.score_and_label(evaluated(spark, sf)))


VIEWS["engines"] = """
SELECT id, CASE WHEN id % 4 <> 0 THEN dealer_name END AS layoutlm_merchant, CASE WHEN id % 3 <> 0 THEN concat(' ', upper(dealer_name)) END AS donut_merchant, CASE WHEN id % 5 = 0 THEN brand END AS donut_receipt_merchant,
  CASE WHEN id % 5 <> 0 THEN total_c / CAST(100 AS DOUBLE) END AS layoutlm_total, CASE WHEN id % 7 <> 0 THEN (total_c + CASE id % 6 WHEN 0 THEN 40 WHEN 1 THEN 99900 ELSE 0 END) / CAST(100 AS DOUBLE) END AS donut_total, CASE WHEN id % 2 = 0 THEN total_c / CAST(100 AS DOUBLE) END AS donut_receipt_total,
  CASE WHEN id % 3 <> 1 THEN claim_date END AS layoutlm_date, CASE WHEN id % 9 = 0 THEN decision_date END AS donut_date, CASE WHEN id % 4 <> 1 THEN CASE WHEN id % 8 = 0 THEN decision_date ELSE claim_date END END AS donut_receipt_date FROM {claims}
"""


def _pick(field: str) -> str:
    engines = N.PRIORITY[field]
    return f"coalesce({', '.join(f'{e}_{field}' for e, _ in engines)})"


def _which(field: str, what: int) -> str:
    return "CASE " + " ".join(f"WHEN {e}_{field} IS NOT NULL THEN " + (f"'{e}'" if what == 0 else str(w)) for e, w in N.PRIORITY[field]) + " END"


_KNOWN = "list_filter([layoutlm_total, donut_total, donut_receipt_total], lambda x: x IS NOT NULL)"


@query("ensemble_converge", with_views(f"""SELECT id, merchant, merchant_source, CAST(mc AS DOUBLE) / 100 AS merchant_confidence, total, total_source, CAST(tc AS DOUBLE) / 100 AS total_confidence, date, date_source, CAST(dc AS DOUBLE) / 100 AS date_confidence,
  coalesce((coalesce(mc * 40, 0) + coalesce(tc * 40, 0) + coalesce(dc * 20, 0)) / nullif(CASE WHEN mc IS NULL THEN 0 ELSE 40 END + CASE WHEN tc IS NULL THEN 0 ELSE 40 END + CASE WHEN dc IS NULL THEN 0 ELSE 20 END, 0), 70.0) / 100 AS confidence FROM (
  SELECT id, {_pick('merchant')} AS merchant, {_which('merchant', 0)} AS merchant_source, {_which('merchant', 1)} AS mc, {_pick('total')} AS total, {_which('total', 0)} AS total_source,
  CASE WHEN len({_KNOWN}) >= 2 AND len(list_distinct({_KNOWN})) = 1 THEN least(95, {_which('total', 1)} + 20) ELSE {_which('total', 1)} END AS tc, {_pick('date')} AS date, {_which('date', 0)} AS date_source, {_which('date', 1)} AS dc FROM {{engines}})"""))
def ensemble_converge(spark, sf):
    return N.converge(view(spark, sf, "engines"))


_M = "list_filter([lower(trim(layoutlm_merchant)), lower(trim(donut_merchant)), lower(trim(donut_receipt_merchant))], lambda x: x IS NOT NULL)"
_D = "list_filter([layoutlm_date, donut_receipt_date], lambda x: x IS NOT NULL)"


@query("ensemble_agreement", with_views(f"""SELECT id, coalesce((m + t + d) / nullif(10 * (mk + tk + dk), 0), 0.0) AS agreement FROM (SELECT id, CASE WHEN len({_M}) = 0 THEN 0 WHEN len(list_distinct({_M})) < len({_M}) THEN 10 WHEN len({_M}) = 1 THEN 5 ELSE 0 END AS m, CAST(len({_M}) > 0 AS INT) AS mk,
  CASE WHEN len({_KNOWN}) = 0 THEN 0 WHEN len({_KNOWN}) < 2 THEN 5 WHEN list_max({_KNOWN}) = list_min({_KNOWN}) THEN 10 WHEN list_max({_KNOWN}) - list_min({_KNOWN}) <= greatest(0.5, list_max({_KNOWN}) * 0.01) THEN 8 ELSE 3 END AS t, CAST(len({_KNOWN}) > 0 AS INT) AS tk,
  CASE WHEN len({_D}) = 0 THEN 0 WHEN len({_D}) >= 2 AND len(list_distinct({_D})) = 1 THEN 10 WHEN len({_D}) = 1 THEN 5 ELSE 3 END AS d, CAST(len({_D}) > 0 AS INT) AS dk FROM {{engines}})"""))
def ensemble_agreement(spark, sf):
    return N.agreement(view(spark, sf, "engines"))
