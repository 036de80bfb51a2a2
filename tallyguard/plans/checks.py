"""Queries of layout, dates, amounts, confidences, phone numbers and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks as C
from ..functions.ids import us_phone
from ..operators import lookups as L
from ..sources.dims import values_sql
from ..sources.views import VIEWS, view, with_views
from .registry import query


#: Receipts, some with tabs and wide gaps.
VIEWS["gapped_receipts"] = """
SELECT id, CASE WHEN id % 13 <> 0 THEN concat(full_text, CASE id % 4 WHEN 0 THEN concat(chr(10), chr(9), 'Thank you', chr(10), '   ', chr(10), ' Come  again ') WHEN 1 THEN concat(chr(10), 'Qty', chr(9), '1', chr(10), 'a  b', chr(10), 'c  d', chr(10), 'e  f') ELSE chr(10) END) END AS text FROM {receipts}
"""


@query("wide_lines", with_views(r"""
WITH l AS (SELECT id, list_filter(string_split(coalesce(text, ''), chr(10)),
    lambda x: regexp_matches(x, '[^\x20\x09-\x0D]') AND (contains(x, '  ') OR contains(x, chr(9)))) AS wide FROM {gapped_receipts})
SELECT id, CAST(len(wide) AS INT) AS n_wide, CASE WHEN len(wide) < 2 THEN 0.0 ELSE CAST(least(len(wide), 4) AS DOUBLE) / 10.0 END AS score,
  CASE WHEN len(wide) >= 2 THEN array_to_string(list_transform(wide[1:3], lambda x: left(regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 80)), '|') END AS evidence
FROM l"""))
def wide_lines(spark, sf):
    found = C.wide_lines(F.col("text"))
    return view(spark, sf, "gapped_receipts").select("id", *(c.alias(n) for n, c in found.items()))


#: A claim's two dates as they are written in different places.
VIEWS["written_dates"] = """
SELECT id, concat(substr(claim_date, 9, 2), '/', substr(claim_date, 6, 2), '/', substr(claim_date, 1, 4)) AS day_first,
  concat(substr(decision_date, 6, 2), '.', substr(decision_date, 9, 2), '.', substr(decision_date, 3, 2)) AS month_first,
  CASE WHEN id % 3 = 0 THEN concat(substr(decision_date, 9, 2), '-', substr(decision_date, 6, 2), '-', substr(decision_date, 1, 4)) WHEN id % 3 = 1 THEN claim_date END AS other FROM {claims}
"""


@query("day_first_dates", with_views("""
SELECT id, CAST(n AS INT) AS n_day_first, CAST(least(n, 2) AS DOUBLE) / 10.0 AS score FROM (
  SELECT w.id, (SELECT count(*) FROM (SELECT unnest([w.day_first, w.month_first, w.other]) AS d) x
    WHERE regexp_matches(d, '^[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}') AND CAST(regexp_extract(d, '^[0-9]+') AS INT) > 12) AS n FROM {written_dates} w)"""))
def day_first_dates(spark, sf):
    found = C.day_first_dates(F.array("day_first", "month_first", "other"))
    return view(spark, sf, "written_dates").select("id", *(c.alias(n) for n, c in found.items()))


#: Amounts as receipts write them, and labels whose letters are set apart.
VIEWS["amount_texts"] = """
SELECT id, CASE id % 8 WHEN 0 THEN concat('(', CAST(parts_c AS STRING), '.50)') WHEN 1 THEN concat('Rs ', CAST(parts_c AS STRING), ',000') WHEN 2 THEN concat('-', CAST(tax_c AS STRING))
    WHEN 3 THEN '' WHEN 4 THEN concat(chr(160), '12', chr(160), CAST(id AS STRING), '.75 ') WHEN 5 THEN '( - )' WHEN 6 THEN concat('(USD 1,', CAST(100 + id % 900 AS STRING), ')') END AS amount_text,
  CASE id % 5 WHEN 0 THEN concat('T o t a l   d u e ', CAST(parts_c AS STRING)) WHEN 1 THEN concat('Total due 1,', CAST(100 + id % 900 AS STRING), '.25 of 99') WHEN 2 THEN 'A b'
    WHEN 3 THEN concat(' S u b ', dealer_name, ' a m o u n t  7 . 5 ') END AS label_text
FROM {claims}
"""


@query("signed_amounts", with_views(r"""
WITH s AS (SELECT id, regexp_replace(amount_text, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g') AS t FROM {amount_texts})
SELECT id, CASE WHEN t LIKE '(%)' THEN -1.0 ELSE 1.0 END * TRY_CAST(regexp_replace(t, '[^0-9.-]', '', 'g') AS DOUBLE) AS amount FROM s"""))
def signed_amounts(spark, sf):
    return view(spark, sf, "amount_texts").select("id", C.signed_amount(F.col("amount_text")).alias("amount"))


@query("unspaced_labels", with_views(r"""
WITH w AS (SELECT id, label_text, list_filter(regexp_split_to_array(label_text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM {amount_texts}),
j AS (SELECT id, CASE WHEN len(words) > 2 AND 2 * len(list_filter(words, lambda x: length(x) = 1)) > len(words)
    THEN trim(replace(list_reduce(list_prepend('', words), lambda a, x: CASE WHEN length(x) > 1 THEN a || ' ' || x WHEN right(a, 1) = chr(1) THEN a || x || chr(1) ELSE a || ' ' || x || chr(1) END), chr(1), ''))
    ELSE label_text END AS label FROM w)
SELECT id, label, list_max(list_transform(regexp_extract_all(label, '[0-9,]+\.?[0-9]*'), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE))) AS amount FROM j"""))
def unspaced_labels(spark, sf):
    label = C.unspaced(F.col("label_text"))
    return view(spark, sf, "amount_texts").select("id", label.alias("label")).withColumn("amount", C.largest_amount(F.col("label")))


#: Confidences as engines state them.
VIEWS["stated"] = """
SELECT event_id, CASE event_id % 11 WHEN 0 THEN 'High' WHEN 1 THEN ' med ' WHEN 2 THEN 'very low' WHEN 3 THEN concat(CAST(user_id % 130 AS STRING), '%') WHEN 4 THEN CAST(user_id % 140 AS STRING) WHEN 5 THEN '0.4'
  WHEN 6 THEN '' WHEN 7 THEN 'unsure' WHEN 8 THEN '-3' WHEN 9 THEN '250 %' END AS stated FROM {events}
"""


@query("stated_confidences", with_views("""
WITH s AS (SELECT event_id, stated, lower(trim(stated)) AS t, CASE WHEN right(trim(stated), 1) = '%' THEN TRY_CAST(rtrim(trim(stated), '%') AS DOUBLE) / 100 END AS pct, TRY_CAST(trim(stated) AS DOUBLE) AS num FROM {stated}),
v AS (SELECT event_id, CASE WHEN t IN ('high', 'very high') THEN 0.9 WHEN t IN ('medium', 'med') THEN 0.7 WHEN t IN ('low', 'very low') THEN 0.4
    WHEN pct IS NOT NULL THEN greatest(0.0, least(1.0, pct)) WHEN num > 1 THEN least(1.0, num / 100) WHEN num IS NOT NULL THEN greatest(0.0, num) ELSE 0.0 END AS confidence,
  CASE WHEN coalesce(pct, num) > 1 THEN least(1.0, coalesce(pct, num) / 100) WHEN coalesce(pct, num) IS NOT NULL THEN greatest(0.0, coalesce(pct, num)) ELSE 0.5 END AS rule_score FROM s)
SELECT event_id, CAST(confidence AS DOUBLE) AS confidence, CAST(rule_score AS DOUBLE) AS rule_score, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.65 THEN 'medium' ELSE 'low' END AS level FROM v"""))
def stated_confidences(spark, sf):
    known = view(spark, sf, "stated").select("event_id", C.confidence(F.col("stated")).alias("confidence"), C.rule_score(F.col("stated")).alias("rule_score"))
    return known.withColumn("level", C.confidence_level(F.col("confidence")))


#: Numbers of the United States, some of them false.
VIEWS["us_numbers"] = """
SELECT id, CASE id % 7 WHEN 0 THEN concat('+1 (212) 555-', lpad(CAST(id % 10000 AS STRING), 4, '0')) WHEN 1 THEN concat('1', lpad(CAST((id * 7919) % 10000000000 AS STRING), 10, '0'))
  WHEN 2 THEN '212-555-123' WHEN 3 THEN '' WHEN 4 THEN concat('3', lpad(CAST((id * 104729) % 1000000000 AS STRING), 9, '7')) WHEN 5 THEN '(123) 456-7890' END AS phone FROM {claims}
"""
_SEQUENCES = "01234|12345|23456|34567|45678|56789|98765|87654|76543|65432|54321|43210"


@query("us_phone_check", with_views(rf"""
WITH a AS (SELECT id, coalesce(phone, '') AS p, regexp_replace(coalesce(phone, ''), '[^0-9+]', '', 'g') AS r FROM {{us_numbers}}),
d AS (SELECT id, p, CASE WHEN r LIKE '+1%' THEN r[3:] WHEN r LIKE '1%' AND length(r) = 11 THEN r[2:] ELSE r END AS digits FROM a),
t AS (SELECT id, digits, CASE WHEN p = '' THEN 0 WHEN length(digits) <> 10 THEN 5 ELSE greatest(0, 10 - CASE WHEN digits[1] IN ('0', '1') THEN 4 ELSE 0 END
    - CASE WHEN regexp_matches(digits, '0{{5}}|1{{5}}|2{{5}}|3{{5}}|4{{5}}|5{{5}}|6{{5}}|7{{5}}|8{{5}}|9{{5}}') THEN 5 ELSE 0 END - CASE WHEN regexp_matches(digits, '{_SEQUENCES}') THEN 6 ELSE 0 END) END AS tenths FROM d)
SELECT id, digits, CAST(tenths AS DOUBLE) / 10.0 AS confidence, tenths > 5 AS valid, CASE WHEN length(digits) = 10 THEN '+1-' || digits[1:3] || '-' || digits[4:6] || '-' || digits[7:] ELSE digits END AS formatted FROM t"""))
def us_phone_check(spark, sf):
    return view(spark, sf, "us_numbers").select("id", *(c.alias(n) for n, c in us_phone(F.col("phone")).items()))


@query("currency_countries", with_views(f"""
WITH c AS (SELECT currency, string_agg(country, ',' ORDER BY country) AS countries FROM ({values_sql(L.CURRENCY_COUNTRIES)}) AS m(currency, country) GROUP BY currency),
r AS (SELECT id, CASE id % 5 WHEN 0 THEN 'EUR' WHEN 1 THEN 'INR' WHEN 2 THEN 'XYZ' WHEN 3 THEN 'SAR' END AS currency FROM {{claims}})
SELECT id, r.currency, countries FROM r LEFT JOIN c ON r.currency = c.currency"""))
def currency_countries(spark, sf):
    k = F.col("id") % 5
    rows = view(spark, sf, "claims").select("id", F.when(k == 0, "EUR").when(k == 1, "INR").when(k == 2, "XYZ").when(k == 3, "SAR").alias("currency"))
    found = L.countries_of(rows, L.currency_countries(spark))
    return found.select("id", "currency", F.array_join("countries", ",").alias("countries"))


@query("users_with_roles", """SELECT c_custkey AS user_id, c_name AS name, n_name AS role_name, r_name AS role_permissions FROM customer
LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey > 0) ON c_nationkey = n_nationkey""")
def users_with_roles(spark, sf):
    users = view(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("role_id"))
    n, r = view(spark, sf, "nation"), view(spark, sf, "region")
    roles = n.where("n_regionkey > 0").join(r, n["n_regionkey"] == r["r_regionkey"])
    roles = roles.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("permissions"))
    return L.users_with_roles(users, roles).drop("role_id")


@query("feedback_with_decisions", with_views("""SELECT f.feedback_id, f.created_at AS created_at_feedback, CAST(f.receipt_id AS VARCHAR) AS analysis_ref, c.claim_date AS created_at_analysis, CAST(c.id AS VARCHAR) AS file_path, c.status AS label
FROM {feedback} f JOIN {claims} c ON f.receipt_id = c.id"""))
def feedback_with_decisions(spark, sf):
    feedback = view(spark, sf, "feedback").select("feedback_id", "created_at", F.col("receipt_id").cast("string").alias("analysis_ref"))
    decisions = view(spark, sf, "claims").select(F.col("claim_date").alias("created_at"), F.col("id").cast("string").alias("file_path"), F.col("status").alias("label"))
    return L.feedback_with_decisions(feedback, decisions)


@query("first_decision", with_views("""SELECT c_custkey AS analysis_id, d.system_verdict AS engine_label, CASE WHEN d.receipt_id IS NOT NULL THEN coalesce(d.value, 0.0) END AS engine_score FROM customer
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY receipt_id ORDER BY feedback_id) AS k FROM {feedback}) d ON d.receipt_id = c_custkey AND d.k = 1"""))
def first_decision(spark, sf):
    analyses = view(spark, sf, "customer").select(F.col("c_custkey").alias("analysis_id"))
    log = view(spark, sf, "feedback").select(F.col("receipt_id").alias("file_path"), F.col("feedback_id").alias("position"), F.col("system_verdict").alias("label"), F.col("value").alias("score"))
    return L.first_decision(analyses, log)


@query("feedback_summary", with_views("""SELECT 'claims' AS measure, NULL::VARCHAR AS value, count(*) AS n FROM {claims}
UNION ALL SELECT 'claims_with_duplicates', NULL, count(DISTINCT claim_id_1) FROM {matches}
UNION ALL SELECT 'feedback', verdict, count(*) FROM {feedback} GROUP BY verdict"""))
def feedback_summary(spark, sf):
    return L.feedback_summary(view(spark, sf, "claims"), view(spark, sf, "matches"), view(spark, sf, "feedback"))
