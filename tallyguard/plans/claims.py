"""Queries over warranty claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dashboards as D
from ..operators import warranty as V
from ..sources.dims import BENCHMARKS, benchmarks, values_sql
from ..sources.sinks import stored
from ..sources.views import CLAIMS_AS_OF, ORACLE_VIEWS, view, with_views
from .registry import query

ORACLE_VIEWS["wmi"] = "SELECT * FROM (" + values_sql(V.WMI.items()) + ") AS t(prefix, maker)"
ORACLE_VIEWS["vin_years"] = "SELECT * FROM (" + values_sql(V.YEARS.items()) + ") AS t(letter, vin_year)"
ORACLE_VIEWS["benchmark_rows"] = "SELECT * FROM (" + values_sql(BENCHMARKS) + ") AS t(brand, issue_type, avg_parts, avg_labor, avg_total, std_parts, std_labor, std_total)"
ORACLE_VIEWS["m"] = "SELECT *, parts_c / 100.0 AS parts, labor_c / 100.0 AS labor, tax_c / 100.0 AS tax, total_c / 100.0 AS total, CAST(claim_date AS DATE) AS cd, CAST(decision_date AS DATE) AS dd FROM {claims}"
_CENTS = "list_filter([CASE WHEN parts > 0 THEN floor((parts * 100) % 100) END, CASE WHEN labor > 0 THEN floor((labor * 100) % 100) END, CASE WHEN tax > 0 THEN floor((tax * 100) % 100) END], lambda x: x IS NOT NULL)"
_TYPICAL = "CASE " + " ".join(f"WHEN contains(lower(issue), '{k}') THEN {v}" for k, v in V.TYPICAL_HOURS.items()) + " END"
_TAX = " OR ".join(f"(country_code = '{c}' AND (tax / total < {lo - 0.02!r} OR tax / total > {hi + 0.02!r}))" for c, (lo, hi) in V.TAX_RATES.items())
_CHECKS = [
    ("NEGATIVE_TAX", "HIGH", "tax < 0"), ("NEGATIVE_PARTS_COST", "HIGH", "parts < 0"), ("NEGATIVE_LABOR_COST", "HIGH", "labor < 0"),
    ("TOTAL_MISMATCH", "MEDIUM", "abs(parts + labor + tax - total) > 1.0"), ("LABOR_PARTS_RATIO_HIGH", "MEDIUM", "parts > 0 AND labor / parts > 2.0"),
    ("TAX_RATE_HIGH", "MEDIUM", "parts <> 0 AND labor <> 0 AND parts + labor > 0 AND tax / (parts + labor) > 0.15"),
    ("FUTURE_CLAIM_DATE", "HIGH", f"cd > DATE '{CLAIMS_AS_OF}'"), ("VEHICLE_TOO_OLD", "MEDIUM", "year(cd) - year > 10"), ("CLAIM_BEFORE_MANUFACTURE", "HIGH", "year(cd) - year < 0"),
    ("DECISION_BEFORE_CLAIM", "HIGH", "dd < cd"), ("ROUND_TOTAL", "LOW", "total > 100 AND total_c % 100 = 0"),
    ("MATCHING_CENTS", "LOW", f"len({_CENTS}) >= 2 AND len(list_distinct({_CENTS})) = 1 AND ({_CENTS})[1] <> 0"),
    ("ZERO_LABOR_COMPLEX_REPAIR", "MEDIUM", "labor_c = 0 AND regexp_matches(lower(issue), 'transmission|engine|steering|suspension')"),
    ("VIN_INVALID_FORMAT", "MEDIUM", "length(vin) <> 17"), ("VIN_INVALID_FORMAT", "MEDIUM", "regexp_matches(upper(vin), '[IOQ]')"),
    ("VIN_MODEL_MISMATCH", "HIGH", "length(vin) >= 3 AND lower(brand) <> lower(coalesce((SELECT maker FROM wmi WHERE prefix = upper(vin[1:3])), (SELECT maker FROM wmi WHERE prefix = upper(vin[1:2]))))"),
    ("VIN_MODEL_MISMATCH", "HIGH", "length(vin) >= 10 AND abs((SELECT vin_year FROM vin_years WHERE letter = upper(vin[10])) - year) > 1"),
    ("LABOR_RATE_OUTLIER", "MEDIUM", "labor_hours > 0 AND (labor / labor_hours < 30 OR labor / labor_hours > 300)"),
    ("EXCESSIVE_LABOR_HOURS_FOR_PART", "MEDIUM", f"labor_hours > 2 * {_TYPICAL}"), ("TAX_INCONSISTENT_WITH_GEO", "MEDIUM", f"total > 0 AND ({_TAX})"),
    ("IMAGE_COUNT_MISMATCH", "LOW", "image_count < CASE WHEN regexp_matches(lower(issue), 'engine|transmission|body') THEN 3 ELSE 2 END"),
]


def _check(name: str, severity: str, condition: str) -> str:
    """A check as SQL; the dimensions that its condition names are put in braces, so that they are among the views."""
    for dim in ("wmi", "vin_years"):
        condition = condition.replace(f"FROM {dim} ", f"FROM {{{dim}}} ")
    return f"SELECT id, '{name}' AS signal_type, '{severity}' AS severity FROM {{m}} WHERE {condition}"


ORACLE_VIEWS["own_signals"] = " UNION ALL ".join(_check(*c) for c in _CHECKS)
ORACLE_VIEWS["zscores"] = """SELECT m.id, coalesce(o.brand, CASE WHEN g.issue_type IS NOT NULL THEN 'generic' END) AS benchmark,
  CAST((parts - coalesce(o.avg_parts, g.avg_parts)) / coalesce(o.std_parts, g.std_parts) AS DOUBLE) AS z_parts, CAST((labor - coalesce(o.avg_labor, g.avg_labor)) / coalesce(o.std_labor, g.std_labor) AS DOUBLE) AS z_labor,
  CAST((total - coalesce(o.avg_total, g.avg_total)) / coalesce(o.std_total, g.std_total) AS DOUBLE) AS z_total
FROM {m} m LEFT JOIN {benchmark_rows} o ON m.brand = o.brand AND m.issue = o.issue_type LEFT JOIN {benchmark_rows} g ON g.brand IS NULL AND m.issue = g.issue_type"""
ORACLE_VIEWS["past_signals"] = f"""
SELECT id, 'TOTAL_ABOVE_BENCHMARK' AS signal_type, 'MEDIUM' AS severity FROM {{zscores}} WHERE z_total > 2.5
UNION ALL SELECT id, 'PARTS_COST_ABOVE_BENCHMARK', 'LOW' FROM {{zscores}} WHERE z_parts > 2.5
UNION ALL SELECT id, 'LABOR_COST_ABOVE_BENCHMARK', 'LOW' FROM {{zscores}} WHERE z_labor > 2.5
UNION ALL SELECT c.id, 'ODOMETER_REGRESSION', 'HIGH' FROM {{claims}} c WHERE EXISTS (
  SELECT 1 FROM {{claims}} p WHERE c.vin = p.vin AND p.odometer > c.odometer AND (p.claim_date < c.claim_date OR (p.claim_date = c.claim_date AND p.id < c.id)))
UNION ALL SELECT DISTINCT c.id, 'REPEAT_CLAIM_SAME_PART_SHORT_WINDOW', 'MEDIUM' FROM {{claims}} c JOIN {{claims}} p ON c.vin = p.vin AND p.id <> c.id
  AND datediff('day', CAST(p.claim_date AS DATE), CAST(c.claim_date AS DATE)) BETWEEN 0 AND 90 AND (p.claim_date < c.claim_date OR p.id < c.id)
  WHERE len(list_intersect(string_split(lower(c.issue), ' '), string_split(lower(p.issue), ' '))) >= 2
UNION ALL SELECT c.id, CASE WHEN n >= 4 THEN 'VIN_EXCESSIVE_CLAIMS' ELSE 'VIN_MULTIPLE_CLAIMS' END, CASE WHEN n >= 4 THEN 'HIGH' ELSE 'MEDIUM' END
  FROM {{claims}} c JOIN (SELECT vin, count(*) AS n FROM {{claims}} GROUP BY vin) v ON c.vin = v.vin WHERE n >= 3
UNION ALL SELECT c.id, 'HIGH_RISK_DEALER', 'HIGH' FROM {{claims}} c JOIN (
  SELECT x.dealer_id, count(DISTINCT x.id) AS n, count(f.feedback_id) AS frauds FROM {{claims}} x LEFT JOIN {{feedback}} f ON f.receipt_id = x.id AND f.verdict = 'CONFIRMED_FRAUD' GROUP BY x.dealer_id) d
  ON c.dealer_id = d.dealer_id WHERE n > 5 AND frauds > 0 AND frauds / n > 0.1
UNION ALL SELECT c.id, 'DEALER_SPIKE_IN_CLAIMS', 'MEDIUM' FROM {{claims}} c JOIN (
  SELECT dealer_id, count(*) FILTER (claim_date >= CAST(DATE '{CLAIMS_AS_OF}' - 30 AS VARCHAR)) AS recent,
    count(*) FILTER (claim_date >= CAST(DATE '{CLAIMS_AS_OF}' - 60 AS VARCHAR) AND claim_date < CAST(DATE '{CLAIMS_AS_OF}' - 30 AS VARCHAR)) AS prior FROM {{claims}} GROUP BY dealer_id) d
  ON c.dealer_id = d.dealer_id WHERE prior > 0 AND recent > prior * 2.5
UNION ALL SELECT claim_id_1, CASE match_type WHEN 'IMAGE_EXACT' THEN 'DUPLICATE_IMAGE_EXACT' WHEN 'IMAGE_LIKELY_SAME' THEN 'DUPLICATE_IMAGE_SIMILAR' ELSE 'POTENTIAL_DUPLICATE_CLAIM' END,
  CASE match_type WHEN 'VIN_ISSUE_DUPLICATE' THEN 'MEDIUM' ELSE 'HIGH' END FROM {{matches}} WHERE match_type IN ('IMAGE_EXACT', 'IMAGE_LIKELY_SAME', 'VIN_ISSUE_DUPLICATE')
"""
ORACLE_VIEWS["signals"] = "SELECT * FROM {own_signals} UNION ALL SELECT * FROM {past_signals}"
ORACLE_VIEWS["risk"] = """
SELECT c.id, least(10, coalesce(s.t, 0) + coalesce(d.t, 0)) / 10.0 AS risk_score, coalesce(s.n, 0) AS n_signals,
  CASE WHEN coalesce(d.exact, false) OR coalesce(s.grave, false) OR least(10, coalesce(s.t, 0) + coalesce(d.t, 0)) >= 7 THEN 'INVESTIGATE'
    WHEN least(10, coalesce(s.t, 0) + coalesce(d.t, 0)) >= 3 THEN 'REVIEW' ELSE 'AUTO_APPROVE' END AS triage_class,
  (least(10, coalesce(s.t, 0) + coalesce(d.t, 0)) >= 3 OR d.t IS NOT NULL OR coalesce(s.high, false)) AS is_suspicious
FROM {claims} c
LEFT JOIN (SELECT id, sum(CASE severity WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS t, count(*) AS n, bool_or(severity = 'HIGH') AS high,
  bool_or(signal_type IN ('NEGATIVE_TAX', 'FUTURE_CLAIM_DATE', 'CLAIM_BEFORE_MANUFACTURE', 'DECISION_BEFORE_CLAIM', 'HIGH_RISK_DEALER')) AS grave FROM {signals} GROUP BY id) s ON c.id = s.id
LEFT JOIN (SELECT claim_id_1 AS id, sum(CASE match_type WHEN 'IMAGE_EXACT' THEN 5 WHEN 'IMAGE_LIKELY_SAME' THEN 4 WHEN 'IMAGE_SIMILAR' THEN 2 WHEN 'VIN_ISSUE_DUPLICATE' THEN 3 ELSE 0 END) AS t,
  bool_or(match_type = 'IMAGE_EXACT') AS exact FROM {matches} GROUP BY claim_id_1) d ON c.id = d.id
"""
ORACLE_VIEWS["risked"] = "SELECT c.*, r.risk_score, r.triage_class, r.is_suspicious FROM {claims} c JOIN {risk} r ON c.id = r.id"
_R10 = "CAST(round(risk_score * 10) AS BIGINT)"


def signalled(spark: SparkSession, sf: str) -> DataFrame:
    return V.stateless_signals(view(spark, sf, "claims"), CLAIMS_AS_OF)


def history(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Claims and their matches, each built once: the orders' lines are read by one job alone."""
    claims = stored(view(spark, sf, "claims"))
    return claims, stored(view(spark, sf, "matches", {"claims": claims}))


def past(spark: SparkSession, sf: str, claims: DataFrame, matches: DataFrame) -> DataFrame:
    return V.history_signals(claims, matches, benchmarks(spark), view(spark, sf, "feedback"), CLAIMS_AS_OF)


def risk(spark: SparkSession, sf: str, claims: DataFrame, matches: DataFrame) -> DataFrame:
    """Claims with risk, triage and suspicion as further columns."""
    return V.risk_and_triage(V.stateless_signals(claims, CLAIMS_AS_OF), matches, claims.columns, past(spark, sf, claims, matches))


def risked(spark: SparkSession, sf: str) -> DataFrame:
    return risk(spark, sf, *history(spark, sf)).drop("n_signals")


@query("warranty_signals", with_views("SELECT id, signal_type, severity FROM {signals}"))
def warranty_signals(spark, sf):
    claims, matches = history(spark, sf)
    own = V.stateless_signals(claims, CLAIMS_AS_OF).select("id", F.explode("signals").alias("s")).select("id", "s.signal_type", "s.severity")
    return own.union(past(spark, sf, claims, matches))


@query("risk_and_triage", with_views("SELECT id, CAST(risk_score AS DOUBLE) AS risk_score, triage_class, is_suspicious, n_signals FROM {risk}"))
def risk_and_triage(spark, sf):
    return risk(spark, sf, *history(spark, sf)).select("id", "risk_score", "triage_class", "is_suspicious", "n_signals")


@query("dashboard_overview", with_views(f"""
SELECT count(*) AS total_claims, count(*) FILTER (triage_class = 'AUTO_APPROVE') AS auto_approve, count(*) FILTER (triage_class = 'REVIEW') AS review,
  count(*) FILTER (triage_class = 'INVESTIGATE') AS investigate, count(*) FILTER (is_suspicious) AS suspicious, CAST(sum({_R10}) AS DOUBLE) / count(*) / 10.0 AS avg_risk,
  (SELECT count(*) FROM (SELECT claim_id_1 FROM {{matches}} UNION SELECT claim_id_2 FROM {{matches}})) AS claims_with_duplicates FROM {{risked}}"""))
def dashboard_overview(spark, sf):
    claims, matches = history(spark, sf)
    return D.overview(risk(spark, sf, claims, matches), matches)


def _grouped(key: str, name: str, limit: str = "") -> str:
    return with_views(f"""SELECT {key} AS {name}, count(*) AS n_claims, CAST(sum(total_c) AS DOUBLE) / count(*) / 100.0 AS avg_amount, CAST(sum(total_c) AS BIGINT) AS sum_c,
      CAST(sum({_R10}) AS DOUBLE) / count(*) / 10.0 AS avg_risk, count(*) FILTER (is_suspicious) AS suspicious FROM {{risked}} GROUP BY {key}
      ORDER BY n_claims DESC, {name} NULLS FIRST {limit}""")


@query("root_causes", _grouped("issue", "issue", "LIMIT 20"))
def root_causes(spark, sf):
    return D.by_group(risked(spark, sf), F.col("issue"), "issue", 20)


@query("claims_by_brand", with_views("SELECT coalesce(brand, 'Unknown') AS brand, n_claims, avg_amount, sum_c, avg_risk, suspicious FROM (" + f"""SELECT brand, count(*) AS n_claims, CAST(sum(total_c) AS DOUBLE) / count(*) / 100.0 AS avg_amount,
      CAST(sum(total_c) AS BIGINT) AS sum_c, CAST(sum({_R10}) AS DOUBLE) / count(*) / 10.0 AS avg_risk, count(*) FILTER (is_suspicious) AS suspicious FROM {{risked}} GROUP BY brand)"""))
def claims_by_brand(spark, sf):
    return D.by_group(risked(spark, sf), F.col("brand"), "brand").withColumn("brand", F.coalesce("brand", F.lit("Unknown")))


@query("claims_by_dealer", _grouped("coalesce(dealer_name, dealer_id, 'Unknown')", "dealer", "LIMIT 15"))
def claims_by_dealer(spark, sf):
    return D.by_group(risked(spark, sf), F.coalesce("dealer_name", "dealer_id", F.lit("Unknown")), "dealer", 15)


@query("claims_trend_monthly", with_views("SELECT claim_date[1:7] AS month, count(*) AS n_claims, count(*) FILTER (is_suspicious) AS suspicious, CAST(sum(total_c) AS BIGINT) AS sum_c FROM {risked} WHERE length(claim_date) >= 7 GROUP BY 1"))
def claims_trend_monthly(spark, sf):
    return D.monthly_trend(risked(spark, sf))


@query("claims_drilldown", with_views("""SELECT id, dealer_id, brand, issue, claim_date, total_c, CAST(risk_score AS DOUBLE) AS risk_score, triage_class, count(*) OVER () AS n_fit FROM {risked}
  WHERE status = 'Approved' AND is_suspicious AND id IN (SELECT claim_id_1 FROM {matches} UNION SELECT claim_id_2 FROM {matches}) ORDER BY claim_date DESC, id DESC LIMIT 25 OFFSET 10"""))
def claims_drilldown(spark, sf):
    claims, matches = history(spark, sf)
    return D.drilldown(risk(spark, sf, claims, matches), matches, filters={"status": "Approved"}, suspicious=True, duplicates_only=True, limit=25, offset=10)


@query("signal_frequency", with_views("SELECT signal_type, severity, count(*) AS n FROM {own_signals} GROUP BY ALL"))
def signal_frequency(spark, sf):
    return D.signal_frequency(signalled(spark, sf).select(F.to_json("signals").alias("signals")))


@query("duplicate_overview", with_views("SELECT match_type, count(*) AS n_pairs, CAST(sum(CAST(round(similarity * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0 AS avg_similarity FROM {matches} GROUP BY match_type"))
def duplicate_overview(spark, sf):
    return D.duplicates_by_type(view(spark, sf, "matches"))


@query("duplicate_top_claims", with_views("""SELECT claim_id, count(*) AS n_matches FROM (SELECT claim_id_1 AS claim_id FROM {matches} UNION ALL SELECT claim_id_2 FROM {matches}) GROUP BY claim_id ORDER BY n_matches DESC, claim_id LIMIT 10"""))
def duplicate_top_claims(spark, sf):
    return D.most_duplicated(view(spark, sf, "matches"))


@query("duplicate_audit", with_views("""SELECT g.*, vin, dealer_id, issue, claim_date, total_c, status FROM (SELECT claim_id, other_id, count(*) AS n_reasons, CAST(max(similarity) AS DOUBLE) AS max_similarity, string_agg(DISTINCT match_type, ',' ORDER BY match_type) AS reason_types FROM
  (SELECT claim_id_1 AS claim_id, claim_id_2 AS other_id, match_type, similarity FROM {matches} UNION ALL SELECT claim_id_2, claim_id_1, match_type, similarity FROM {matches}) GROUP BY claim_id, other_id) g LEFT JOIN {claims} c ON g.other_id = c.id"""))
def duplicate_audit(spark, sf):
    return D.duplicate_audit(*history(spark, sf))


@query("benchmark_zscore", with_views("SELECT id, benchmark, z_parts, z_labor, z_total, z_parts > 2.5 AS parts_above, z_labor > 2.5 AS labor_above, z_total > 2.5 AS total_above FROM {zscores}"))
def benchmark_zscore(spark, sf):
    return V.benchmark_scores(view(spark, sf, "claims"), benchmarks(spark)).select("id", "benchmark", "z_parts", "z_labor", "z_total", "parts_above", "labor_above", "total_above")


@query("odometer_regression", with_views("""SELECT c.id, c.odometer AS current_odometer, arg_max(p.id, (p.claim_date, p.id)) AS prior_claim_id, arg_max(p.odometer, (p.claim_date, p.id)) AS prior_odometer, max(p.claim_date) AS prior_claim_date
  FROM {claims} c JOIN {claims} p ON c.vin = p.vin AND p.odometer > c.odometer AND (p.claim_date < c.claim_date OR (p.claim_date = c.claim_date AND p.id < c.id)) GROUP BY c.id, c.odometer"""))
def odometer_regression(spark, sf):
    return V.odometer_regressions(view(spark, sf, "claims"))


@query("repeat_claims", with_views("""SELECT c.id, min(p.id) AS prior_claim_id, count(*) AS n_similar FROM {claims} c JOIN {claims} p ON c.vin = p.vin AND p.id <> c.id
  AND datediff('day', CAST(p.claim_date AS DATE), CAST(c.claim_date AS DATE)) BETWEEN 0 AND 90 AND (p.claim_date < c.claim_date OR p.id < c.id)
  WHERE len(list_intersect(string_split(lower(c.issue), ' '), string_split(lower(p.issue), ' '))) >= 2 GROUP BY c.id"""))
def repeat_claims(spark, sf):
    return V.repeat_claims(view(spark, sf, "claims"))


@query("vin_history", with_views("""SELECT id, vin, count(*) OVER w - 1 AS other_claims, CAST(sum(total_c) OVER w - total_c AS BIGINT) AS other_total_c, min(claim_date) OVER w AS first_claim, max(claim_date) OVER w AS last_claim,
  CASE WHEN count(*) OVER w >= 4 THEN 'VIN_EXCESSIVE_CLAIMS' WHEN count(*) OVER w >= 3 THEN 'VIN_MULTIPLE_CLAIMS' END AS signal FROM {claims} WINDOW w AS (PARTITION BY vin)"""))
def vin_history(spark, sf):
    return V.vin_history(view(spark, sf, "claims"))


@query("dealer_spike", with_views(f"""SELECT *, prior > 0 AND recent > prior * 2.5 AS spike FROM (SELECT dealer_id, count(*) FILTER (claim_date >= CAST(DATE '{CLAIMS_AS_OF}' - 30 AS VARCHAR)) AS recent,
  count(*) FILTER (claim_date >= CAST(DATE '{CLAIMS_AS_OF}' - 60 AS VARCHAR) AND claim_date < CAST(DATE '{CLAIMS_AS_OF}' - 30 AS VARCHAR)) AS prior FROM {{claims}} GROUP BY dealer_id)"""))
def dealer_spike(spark, sf):
    return V.dealer_spikes(view(spark, sf, "claims"), CLAIMS_AS_OF)


ORACLE_VIEWS["dealers"] = """
SELECT c.dealer_id, count(*) AS total_claims, count(*) FILTER (c.status = 'Approved') AS approved_claims, count(*) FILTER (c.status = 'Rejected') AS rejected_claims,
  CAST((SELECT count(*) FROM {feedback} f JOIN {claims} x ON f.receipt_id = x.id WHERE f.verdict = 'CONFIRMED_FRAUD' AND x.dealer_id = c.dealer_id) AS BIGINT) AS fraud_confirmed,
  CAST((SELECT count(*) FROM {matches} d JOIN {claims} x ON d.claim_id_1 = x.id WHERE x.dealer_id = c.dealer_id) + (SELECT count(*) FROM {matches} d JOIN {claims} x ON d.claim_id_2 = x.id WHERE x.dealer_id = c.dealer_id) AS BIGINT) AS duplicate_count,
  count(*) FILTER (c.is_suspicious) AS suspicious_count, CAST(sum(c.total_c) AS DOUBLE) / count(*) / 100.0 AS avg_claim_amount, CAST(sum(c.parts_c) AS DOUBLE) / count(*) / 100.0 AS avg_parts_cost,
  CAST(sum(c.labor_c) AS DOUBLE) / count(*) / 100.0 AS avg_labor_cost, min(c.claim_date) AS first_claim_date, max(c.claim_date) AS last_claim_date FROM {risked} c GROUP BY c.dealer_id
"""


def dealers(spark, sf):
    claims, matches = history(spark, sf)
    return V.dealer_statistics(risk(spark, sf, claims, matches), matches, view(spark, sf, "feedback"))


@query("dealer_statistics", with_views("SELECT * FROM {dealers}"))
def dealer_statistics(spark, sf):
    return dealers(spark, sf)


@query("dealer_history", with_views("""SELECT dealer_id, fraud_confirmed / total_claims AS fraud_rate, CASE WHEN fraud_confirmed > 0 AND total_claims > 5 AND fraud_confirmed / total_claims > 0.1 THEN 'HIGH_RISK_DEALER' END AS signal,
  CASE WHEN fraud_confirmed > 0 AND total_claims > 5 AND fraud_confirmed / total_claims > 0.05 AND fraud_confirmed / total_claims <= 0.1 THEN 'elevated fraud rate' END AS warning, duplicate_count > 2 AS many_duplicates FROM {dealers}"""))
def dealer_history(spark, sf):
    return V.dealer_history_signals(dealers(spark, sf))
