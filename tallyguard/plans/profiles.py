"""Queries of geography, unified signals, templates, merchants and domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..operators import geo as G
from ..operators import profiles as Q
from ..operators import rules as R
from ..operators import signals as S
from ..operators import templates as T
from ..sources.dims import values_sql
from ..sources.views import CLAIMS_AS_OF, ORACLE_VIEWS, VIEWS, view, with_views
from . import rules as _rules  # noqa: F401  its views are used here
from .registry import query

#: Receipts with a place and a tax number of one of several countries.
VIEWS["placed"] = """
SELECT id AS doc_id, concat_ws(chr(10), full_text, CASE id % 8 WHEN 0 THEN 'Pune 411001' WHEN 1 THEN 'London SW1A 1AA VAT Number 1' WHEN 2 THEN 'Berlin Rechnung MwSt +49' WHEN 3 THEN 'New York zip code 10001-1234 Sales Tax' WHEN 4 THEN 'Toronto M5V 2T6' WHEN 5 THEN 'Dubai TRN 100123456789012' ELSE 'nowhere' END) AS text FROM {receipts}
"""
_CITY = [(c, w) for c, ws in G.CITIES.items() for w in ws]
_TERM = [(c, w, n) for c, ws in G.TERMS.items() for w, n in ws]
_HIT = "(contains(' ' || d.norm || ' ', ' ' || x.word || ' ') OR starts_with(d.norm, x.word) OR ends_with(d.norm, x.word))"
ORACLE_VIEWS["geo_scores"] = f"""SELECT d.doc_id, c.country, c.ord, coalesce((SELECT sum(x.w) FROM ({values_sql([(c, p, w) for c, p, w in (*G.POSTAL, *G.STRONG)])}) AS x(country, pattern, w) WHERE x.country = c.country AND regexp_matches(d.text, '(?i)' || x.pattern)), 0)
  + least(35, coalesce((SELECT count(*) * 25 FROM ({values_sql(_CITY)}) AS x(country, word) WHERE x.country = c.country AND {_HIT}), 0)) + least(35, coalesce((SELECT sum(x.w) FROM ({values_sql(_TERM)}) AS x(country, word, w) WHERE x.country = c.country AND {_HIT}), 0)) AS score
FROM (SELECT doc_id, text, regexp_replace(lower(text), '\\s+', ' ', 'g') AS norm FROM {{placed}}) d, ({values_sql([(c, i) for i, c in enumerate(G.COUNTRIES)])}) AS c(country, ord)"""


@query("geo_infer", with_views("""SELECT doc_id, CASE WHEN ok THEN country ELSE 'UNKNOWN' END AS country, CASE WHEN ok THEN round(conf, 3) ELSE 0.0 END AS confidence, CAST(top AS INT) AS top_score, CAST(second AS INT) AS second_score, mixed FROM (
  SELECT *, top >= 30 AND conf >= 0.30::DOUBLE AS ok FROM (SELECT *, greatest(0.0, least(1.0, (top - second)::DOUBLE / greatest(top, 1) * 0.70::DOUBLE + least(0.30::DOUBLE, top::DOUBLE / 100 * 0.40::DOUBLE)) - CASE WHEN mixed THEN 0.20 ELSE 0.0 END::DOUBLE) AS conf FROM (
  SELECT *, second > 35 AND top - second < 25 AS mixed FROM (SELECT doc_id, list(country ORDER BY score DESC, ord)[1] AS country, list(score ORDER BY score DESC, ord)[1] AS top, list(score ORDER BY score DESC, ord)[2] AS second FROM {geo_scores} GROUP BY doc_id))))"""))
def geo_infer(spark, sf):
    return G.infer(view(spark, sf, "placed"))


# Rules of tax with the time they are in force, and expectations by scope.
VAT_RULES = (("UK", "VAT", 20.0, "2011-01-04", None), ("UK", "VAT", 17.5, "2010-01-01", "2011-01-03"), ("DE", "MwSt", 19.0, "2007-01-01", None), ("DE", "MwSt", 16.0, "2020-07-01", "2020-12-31"), ("AE", "VAT", 5.0, "2018-01-01", None), ("SA", "VAT", 15.0, "2020-07-01", None), ("SA", "VAT", 5.0, "2018-01-01", "2020-06-30"))
EXPECTATIONS = (("COUNTRY", "IN", "TAX_INVOICE", "gstin"), ("COUNTRY", "DE", "TAX_INVOICE", "ust-idnr"), ("REGION", "EU", "TAX_INVOICE", "vat"), ("REGION", "EU", "FUEL", "vat"), ("GLOBAL", "*", "FUEL", "litres"), ("GLOBAL", "*", "POS_RETAIL", "total"))


@query("vat_rules_in_force", f"SELECT country, tax_name, CAST(rate AS DOUBLE) AS rate, effective_from FROM (SELECT *, row_number() OVER (PARTITION BY country, tax_name ORDER BY effective_from DESC) AS n FROM ({values_sql(VAT_RULES)}) AS v(country, tax_name, rate, effective_from, effective_to) WHERE (effective_to IS NULL OR CAST(effective_to AS DATE) >= DATE '2020-08-15') AND CAST(effective_from AS DATE) <= DATE '2020-08-15') WHERE n = 1")
def vat_rules_in_force(spark, sf):
    rules = spark.createDataFrame(list(VAT_RULES), "country string, tax_name string, rate double, effective_from string, effective_to string")
    return G.effective(rules, "2020-08-15", ["country", "tax_name"]).select("country", "tax_name", "rate", "effective_from")


@query("doc_expectations", with_views(f"""SELECT d.id, coalesce(c.expects, r.expects, g.expects) AS expects, CASE WHEN c.expects IS NOT NULL THEN 'COUNTRY' WHEN r.expects IS NOT NULL THEN 'REGION' WHEN g.expects IS NOT NULL THEN 'GLOBAL' END AS scope
  FROM (SELECT *, CASE WHEN geo_country IN ('DE', 'FR') THEN 'EU' END AS region FROM {{records}}) d LEFT JOIN ({values_sql(EXPECTATIONS)}) AS c(s, code, t, expects) ON c.s = 'COUNTRY' AND c.code = d.geo_country AND c.t = d.doc_subtype
  LEFT JOIN ({values_sql(EXPECTATIONS)}) AS r(s, code, t, expects) ON r.s = 'REGION' AND r.code = d.region AND r.t = d.doc_subtype LEFT JOIN ({values_sql(EXPECTATIONS)}) AS g(s, code, t, expects) ON g.s = 'GLOBAL' AND g.t = d.doc_subtype"""))
def doc_expectations(spark, sf):
    rules = spark.createDataFrame(list(EXPECTATIONS), "geo_scope string, geo_code string, doc_subtype string, expects string")
    docs = view(spark, sf, "records").select("id", F.col("geo_country").alias("country"), F.when(F.col("geo_country").isin("DE", "FR"), "EU").alias("region"), "doc_subtype")
    return G.expectations(docs, rules).select("id", "expects", "scope")


_GATED = "profile_conf < 0.55"


def _signal(name: str, trigger: str, confidence: str, gated: bool) -> str:
    gate = f"WHEN {_GATED} THEN 'GATED' " if gated else ""
    conf = f"CASE WHEN {_GATED} THEN 0.0 ELSE coalesce({confidence}, 0.0) END" if gated else f"coalesce({confidence}, 0.0)"
    return f"SELECT id, '{name}' AS signal, CASE {gate}WHEN ({trigger}) IS NULL THEN 'UNKNOWN' WHEN {trigger} THEN 'TRIGGERED' ELSE 'NOT_TRIGGERED' END AS status, CAST({conf} AS DOUBLE) AS confidence FROM {{records}}"


_TX = "doc_subtype IN ('POS_RETAIL', 'POS_RESTAURANT', 'TAX_INVOICE', 'COMMERCIAL_INVOICE', 'FUEL')"
_BAD = "regexp_matches(lower(producer), 'canva|photoshop|wps|fotor|ilovepdf|sejda|smallpdf|pdfescape|dochub|foxit|tcpdf|fpdf|dompdf|wkhtmltopdf|conta[.]com|invoice generator|receipt maker|fake receipt|invoice maker')"
_AC = "CASE WHEN num_lines % 5 = 0 THEN 'STRONG_ADDRESS' WHEN num_lines % 5 = 1 THEN 'PLAUSIBLE_ADDRESS' WHEN num_lines % 5 = 2 THEN 'WEAK_ADDRESS' ELSE 'NOT_AN_ADDRESS' END"


@query("unified_signals", with_views(" UNION ALL ".join([
    _signal("addr.structure", f"{_AC} IN ('STRONG_ADDRESS', 'PLAUSIBLE_ADDRESS')", "CASE WHEN num_lines % 5 = 0 THEN 0.9 WHEN num_lines % 5 = 1 THEN 0.6 WHEN num_lines % 5 = 2 THEN 0.3 ELSE 0.0 END", False),
    _signal("amount.total_mismatch", "abs(total - items_sum) > 1.0", "0.8", True), _signal("amount.missing", f"total IS NULL AND {_TX}", f"CASE WHEN total IS NULL AND {_TX} THEN 0.7 ELSE 0.9 END", True),
    _signal("template.pdf_producer_suspicious", _BAD, f"CASE WHEN {_BAD} THEN 0.6 ELSE 0.8 END", False), _signal("merchant.extraction_weak", "merchant IS NULL", "0.9", True), _signal("date.missing", f"receipt_date IS NULL AND {_TX}", "0.7", True),
    _signal("date.future", f"receipt_date - DATE '{CLAIMS_AS_OF}' > 1", "0.8", True), _signal("date.gap_suspicious", "creation_date - receipt_date < 0 OR creation_date - receipt_date > 365", "CASE WHEN creation_date - receipt_date < 0 THEN 0.9 ELSE 0.7 END", True),
    _signal("ocr.confidence_low", "ocr_conf < 0.7", "CASE WHEN ocr_conf < 0.7 THEN 1.0::DOUBLE - ocr_conf ELSE ocr_conf END", False), _signal("ocr.text_sparse", "num_lines < 10", "0.8", True)])))
def unified_signals(spark, sf):
    k = F.col("num_lines") % 5
    records = view(spark, sf, "records").withColumn("address_class", F.when(k == 0, "STRONG_ADDRESS").when(k == 1, "PLAUSIBLE_ADDRESS").when(k == 2, "WEAK_ADDRESS").otherwise("NOT_AN_ADDRESS"))
    return S.emit(records, S.registry(CLAIMS_AS_OF))


@query("ml_contract", with_views("""SELECT l.id, label, CAST(score AS DOUBLE) AS score, coalesce(s.ids, '') AS signals_emitted, coalesce(s.n, 0) AS n_events FROM {labelled} l LEFT JOIN (SELECT id, string_agg(rule_id, ',' ORDER BY o) AS ids, CAST(sum(n) AS BIGINT) AS n FROM (SELECT id, rule_id, min(ordinal) AS o, count(*) AS n FROM {fired} GROUP BY id, rule_id) GROUP BY id) s ON l.id = s.id"""))
def ml_contract(spark, sf):
    events = R.evaluate(view(spark, sf, "records"), R.registry(CLAIMS_AS_OF))
    return S.contract(R.score_and_label(events), events)


_KW = "list_distinct(flatten(list_transform({0}, lambda x: regexp_extract_all(lower(x), '[a-z]{{4,}}'))))"
_JAC = "CASE WHEN len(r.{0}) = 0 AND len(t.{0}) = 0 THEN 0.5 ELSE coalesce(len(list_intersect(r.{0}, t.{0})) / nullif(len(list_distinct(list_concat(r.{0}, t.{0}))), 0), 0.0) END"
ORACLE_VIEWS["prints"] = f"""SELECT id, merchant_name, {_KW.format('ls[1:5]')} AS merchant, {_KW.format('ls[2:5]')} AS header, {_KW.format('ls[-5:]')} AS footer, len(ls) AS line_count, len(regexp_extract_all(full_text, '\\d+\\.\\d{{2}}')) AS amount_count, regexp_matches(lower(full_text), 'tax|gst|vat') AS has_tax,
  contains(lower(full_text), 'subtotal') AS has_subtotal, contains(lower(full_text), 'total') AS has_total, regexp_matches(full_text, '\\b\\d{{1,2}}:\\d{{2}}\\b') AS has_time, regexp_matches(full_text, '(?m)^[-=*]{{3,}}$') AS has_separator, regexp_matches(lower(full_text), 'qty|quantity') AS has_table
FROM (SELECT *, string_split(full_text, chr(10)) AS ls FROM {{chained}})"""
#: Receipts of a few chains, by a name that the first line shows.
VIEWS["chained"] = """SELECT id, CASE id % 5 WHEN 0 THEN 'Green Market Stores' WHEN 1 THEN 'Blue Motors Garage' WHEN 2 THEN 'Green Garage' WHEN 3 THEN 'Central Market Hall' ELSE 'Blue Hall' END AS merchant_name,
  concat(CASE id % 5 WHEN 0 THEN 'Green Market Stores' WHEN 1 THEN 'Blue Motors Garage' WHEN 2 THEN 'Green Garage' WHEN 3 THEN 'Central Market Hall' ELSE 'Blue Hall' END, chr(10), CASE WHEN id % 4 = 0 THEN '10:45' ELSE 'Qty list' END, chr(10), full_text) AS full_text FROM {receipts}"""
ORACLE_VIEWS["learned"] = """SELECT merchant_name, list_distinct(flatten(list(merchant))) AS merchant, list_distinct(flatten(list(header))) AS header, list_distinct(flatten(list(footer))) AS footer, min(line_count) AS line_lo, max(line_count) AS line_hi, min(amount_count) AS amount_lo, max(amount_count) AS amount_hi,
  bool_or(has_tax) AS has_tax, bool_or(has_subtotal) AS has_subtotal, bool_or(has_total) AS has_total, bool_or(has_time) AS has_time, bool_or(has_separator) AS has_separator, bool_or(has_table) AS has_table FROM {prints} GROUP BY merchant_name"""
_SCORE = " + ".join([f"({_JAC.format(k)}) * {T.WEIGHTS[k]}" for k in ("merchant", "header", "footer")] + [f"greatest(0.0, 1.0 - greatest(t.{a}_lo - r.{k}, r.{k} - t.{a}_hi, 0)::DOUBLE * 0.1::DOUBLE) * {T.WEIGHTS[k]}" for k, a in (("line_count", "line"), ("amount_count", "amount"))] + [f"CASE WHEN r.{k} = t.{k} THEN 1.0 ELSE 0.5 END::DOUBLE * {w}" for k, w in T.WEIGHTS.items() if k.startswith("has_")])


@query("template_match", with_views(f"""SELECT id, merchant_name, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, merchant_name) AS rank FROM (
  SELECT r.id, t.merchant_name, round(({_SCORE}) / 100.0, 6) AS score FROM {{prints}} r CROSS JOIN {{learned}} t) WHERE score >= 0.5) WHERE rank <= 3"""))
def template_match(spark, sf):
    rows = view(spark, sf, "chained")
    return T.match(rows, T.learn(rows))


_VOTES = ", ".join(f"count(*) FILTER ({k}) > count(*) // 2 AS {k}" for k in T.FLAGS)
_WORDS = ", ".join(f"array_to_string(list_sort(list_distinct(flatten(list({k})))), ' ') AS {k}" for k in ("merchant", "header", "footer"))


@query("template_groups", with_views(f"""SELECT name AS merchant_name, count(*) AS n, {_WORDS}, CAST(greatest(1, min(lines) - 5) AS INT) AS line_count_lo, CAST(max(lines) + 5 AS INT) AS line_count_hi, CAST(greatest(1, min(sums) - 3) AS INT) AS amount_count_lo, CAST(max(sums) + 5 AS INT) AS amount_count_hi, {_VOTES}
  FROM (SELECT *, substr(coalesce(list_min(merchant), 'unknown'), 1, 20) AS name, greatest(1, line_count - 10) AS lines, greatest(1, amount_count - 5) AS sums FROM {{prints}}) GROUP BY name HAVING count(*) >= 3"""))
def template_groups(spark, sf):
    found = T.generate(T.cluster(view(spark, sf, "chained")))
    return found.withColumns({k: F.array_join(k, " ") for k in ("merchant", "header", "footer")})


_OFF = "CASE WHEN regexp_matches(n, '[^a-zA-Z0-9\\s\\-&''.()]') THEN 20 ELSE 0 END + CASE WHEN n = upper(n) AND n <> lower(n) AND length(n) > 5 THEN 15 ELSE 0 END + CASE WHEN length(n) < 3 THEN 30 ELSE 0 END + CASE WHEN length(n) > 50 THEN 20 ELSE 0 END + CASE WHEN regexp_matches(lower(n), 'test|sample|dummy|fake|xxx|zzz|abc|temp') THEN 60 ELSE 0 END + CASE WHEN regexp_matches(replace(n, ' ', ''), '^\\d+$') THEN 50 ELSE 0 END + CASE WHEN length(regexp_replace(n, '[\\w\\s]', '', 'g')) > 5 THEN 20 ELSE 0 END + CASE WHEN EXISTS (SELECT 1 FROM range(1, length(n) - 1) q(i) WHERE n[i] = n[i + 1] AND n[i] = n[i + 2]) THEN 40 ELSE 0 END"


@query("merchant_check", f"SELECT id, CAST(greatest(0, 100 - o) AS DOUBLE) / 100.0 AS confidence, 100 - o > 50 AS valid FROM (SELECT id, {_OFF} AS o FROM (SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN s_name WHEN 1 THEN 'ACME STORES' WHEN 2 THEN 'Test @ Shop!!!!!!' WHEN 3 THEN CAST(s_suppkey * 37 AS VARCHAR) WHEN 4 THEN 'Bob''s & Co. (North)' ELSE 'AA' END AS n FROM supplier))")
def merchant_check(spark, sf):
    k = F.col("s_suppkey")
    name = F.when(k % 6 == 0, F.col("s_name")).when(k % 6 == 1, "ACME STORES").when(k % 6 == 2, "Test @ Shop!!!!!!").when(k % 6 == 3, (k * 37).cast("string")).when(k % 6 == 4, "Bob's & Co. (North)").otherwise("AA")
    checked = T.merchant_check(F.col("n"))
    return view(spark, sf, "supplier").select(k.alias("id"), name.alias("n")).select("id", checked["confidence"].alias("confidence"), checked["valid"].alias("valid"))


@query("document_intent", with_views("SELECT id, CASE doc_subtype WHEN 'POS_RETAIL' THEN 'PURCHASE' WHEN 'FUEL' THEN 'PURCHASE' WHEN 'PARKING' THEN 'PURCHASE' WHEN 'MISC' THEN 'PURCHASE' WHEN 'TAX_INVOICE' THEN 'BILLING' WHEN 'COMMERCIAL_INVOICE' THEN 'BILLING' ELSE 'UNKNOWN' END AS intent FROM {records}"))
def document_intent(spark, sf):
    return view(spark, sf, "records").select("id", T.intent(F.col("doc_subtype")).alias("intent"))


# Packs of fields that speak for a domain.
PACKS = [
    {"id": "retail", "required_any": (("merchant",), ("total", "tax")), "forbidden": ("photoshop",)},
    {"id": "india_tax", "required_all": (("cgst", "total"),), "required_any": (("merchant", "tax"),)},
    {"id": "logistics", "required_all": (("shipping",),), "required_any": (("receipt_date",), ("total",), ("cgst",))},
]


@query("domain_packs", with_views("""SELECT id, CASE WHEN greatest(a, b, c) = 0 THEN NULL WHEN a >= b AND a >= c THEN 'retail' WHEN b >= c THEN 'india_tax' ELSE 'logistics' END AS domain, CAST(greatest(a, b, c) AS DOUBLE) AS confidence FROM (SELECT id,
  CASE WHEN contains(lower(producer), 'photoshop') THEN 0.0 ELSE (CAST(merchant IS NOT NULL AS INT) + CAST(total IS NOT NULL OR tax IS NOT NULL AS INT)) / 2 END AS a,
  CASE WHEN cgst IS NULL OR total IS NULL THEN 0.0 ELSE (1 + CAST(merchant IS NOT NULL OR tax IS NOT NULL AS INT)) / 2 END AS b,
  CASE WHEN shipping IS NULL THEN 0.0 ELSE (1 + CAST(receipt_date IS NOT NULL AS INT) + CAST(total IS NOT NULL AS INT) + CAST(cgst IS NOT NULL AS INT)) / 4 END AS c FROM {records})"""))
def domain_packs(spark, sf):
    return T.domain(view(spark, sf, "records"), PACKS)


@query("receipt_times", with_views("""SELECT id, CASE WHEN h IS NULL THEN NULL ELSE lpad(CAST(CASE WHEN ap = 'PM' AND h <> 12 THEN h + 12 WHEN ap = 'AM' AND h = 12 THEN 0 ELSE h END AS VARCHAR), 2, '0') || ':' || m END AS time FROM (
  SELECT id, TRY_CAST(nullif(regexp_extract(t, '\\b(\\d{1,2}):(\\d{2})', 1), '') AS INT) AS h, regexp_extract(t, '\\b(\\d{1,2}):(\\d{2})', 2) AS m, upper(regexp_extract(t, '\\b\\d{1,2}:\\d{2}\\s*(AM|PM|am|pm)\\b', 1)) AS ap
  FROM (SELECT id, CASE id % 4 WHEN 0 THEN 'at ' || (id % 12 + 1) || ':' || lpad(CAST(id % 60 AS VARCHAR), 2, '0') || ' PM' WHEN 1 THEN (id % 12 + 1) || ':05am' WHEN 2 THEN (id % 24) || ':30' ELSE 'none' END AS t FROM {receipts}))"""))
def receipt_times(spark, sf):
    k = F.col("id")
    text = F.when(k % 4 == 0, F.format_string("at %d:%02d PM", k % 12 + 1, k % 60)).when(k % 4 == 1, F.concat((k % 12 + 1).cast("string"), F.lit(":05am"))).when(k % 4 == 2, F.concat((k % 24).cast("string"), F.lit(":30"))).otherwise("none")
    return view(spark, sf, "receipts").select("id", D.time(text).alias("time"))


@query("receipt_dates", with_views("""SELECT id, CAST(coalesce(TRY_CAST(d AS DATE), try_strptime(d, '%d/%m/%Y')::DATE, try_strptime(d, '%m/%d/%Y')::DATE) AS VARCHAR) AS first_date, coalesce(TRY_CAST(d AS DATE), try_strptime(d, '%m/%d/%Y')::DATE, try_strptime(d, '%d/%m/%Y')::DATE) <> coalesce(TRY_CAST(d AS DATE), try_strptime(d, '%d/%m/%Y')::DATE, try_strptime(d, '%m/%d/%Y')::DATE) AS ambiguous
  FROM (SELECT id, CASE id % 3 WHEN 0 THEN receipt_date WHEN 1 THEN strftime(CAST(receipt_date AS DATE), '%d/%m/%Y') ELSE strftime(CAST(receipt_date AS DATE), '%m/%d/%Y') END AS d FROM {receipts})"""))
def receipt_dates(spark, sf):
    """First dates with day before month, and whether month before day reads another date."""
    d = F.to_date("receipt_date")
    written = F.when(F.col("id") % 3 == 0, F.col("receipt_date")).when(F.col("id") % 3 == 1, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy"))
    first, other = (F.coalesce(*(F.try_to_timestamp("d", F.lit(f)).cast("date") for f in order)) for order in (("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy"), ("yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy")))
    return view(spark, sf, "receipts").select("id", written.alias("d")).select("id", first.cast("string").alias("first_date"), (first != other).alias("ambiguous"))


_CASES = [(s, w, word) for s, (w, words) in Q.KEYWORDS.items() for word in words]
_ORDERS = [(s, i) for i, s in enumerate(Q.KEYWORDS)]


@query("document_profile", with_views(f"""SELECT id, CASE WHEN score = 0 THEN 'UNKNOWN' WHEN s = 'SHIPPING_BILL' THEN 'LOGISTICS' WHEN s = 'PAYMENT_RECEIPT' THEN 'PAYMENT' ELSE 'TRANSACTIONAL' END AS family, CASE WHEN score = 0 THEN 'UNKNOWN' ELSE s END AS subtype,
  CASE WHEN score = 0 THEN 0.0 ELSE round(CASE WHEN hits >= 2 AND s IN ('COMMERCIAL_INVOICE', 'SHIPPING_BILL') THEN greatest(raw, 0.55::DOUBLE) WHEN hits <= 2 AND s = 'MISC' THEN least(raw, 0.45::DOUBLE) WHEN hits <= 2 AND s = 'UTILITY' THEN least(raw, 0.35::DOUBLE) ELSE raw END, 6) END AS confidence, hits FROM (
  SELECT *, CASE WHEN second > 0 THEN greatest(0.0::DOUBLE, r0 - least(0.65::DOUBLE, 0.55::DOUBLE * (second / score))) ELSE r0 END AS raw FROM (SELECT id, s, score, hits, lead(score) OVER w AS second, row_number() OVER w AS n, least(1.0::DOUBLE, 0.25::DOUBLE + 0.16::DOUBLE * hits) AS r0 FROM (
  SELECT d.id, o.s, o.i, CAST(count(x.word) AS BIGINT) AS hits, coalesce(sum(x.w), 0) AS score FROM (SELECT id, lower(full_text) AS t, trim(regexp_replace(regexp_replace(lower(full_text), '[^\\w\\s/]', ' ', 'g'), '\\s+', ' ', 'g')) AS n FROM {{receipts}}) d CROSS JOIN ({values_sql(_ORDERS)}) AS o(s, i)
  LEFT JOIN ({values_sql(_CASES)}) AS x(s, w, word) ON x.s = o.s AND (contains(d.t, x.word) OR contains(d.n, x.word)) GROUP BY d.id, o.s, o.i) WINDOW w AS (PARTITION BY id ORDER BY score DESC, i)) WHERE n = 1)"""))
def document_profile(spark, sf):
    return Q.profile(view(spark, sf, "receipts"))


_MARK = "concat_ws(chr(10), full_text, CASE id % 5 WHEN 0 THEN 'TN 37087-1234 EIN 12-3456789' WHEN 1 THEN 'RFC ABCD010203XY9 C.P. 06600' WHEN 2 THEN 'Pin code: 560001' WHEN 3 THEN 'CNPJ 12.345.678/0001-95' ELSE 'VAT 312345678901233' END)"


@query("country_fields", with_views("SELECT id, " + ", ".join(f"nullif(regexp_extract(t, '(?i){p}', 1), '') AS {n}" for n, p in Q.COUNTRY_FIELDS.items()) + f" FROM (SELECT id, {_MARK} AS t FROM {{receipts}})"))
def country_fields(spark, sf):
    k = F.col("id") % 5
    mark = F.when(k == 0, "TN 37087-1234 EIN 12-3456789").when(k == 1, "RFC ABCD010203XY9 C.P. 06600").when(k == 2, "Pin code: 560001").when(k == 3, "CNPJ 12.345.678/0001-95").otherwise("VAT 312345678901233")
    rows = view(spark, sf, "receipts").select("id", F.concat_ws("\n", "full_text", mark).alias("t"))
    return rows.select("id", *(c.alias(n) for n, c in Q.country_fields(F.col("t")).items()))


@query("multi_address")
def multi_address(spark, sf):
    """Addresses of texts that hold one, two or none."""
    k = F.col("c_custkey")
    one, two = F.concat(k.cast("string"), F.lit(" Main Street\nPune 411001\nMaharashtra India")), F.lit("Flat 7, Baker Street\nLondon 12345\nUnited Kingdom")
    text = F.when(k % 3 == 0, one).when(k % 3 == 1, F.concat_ws("\n", one, F.lit("Thank you"), two)).otherwise("Thank you\nfor coming")
    return Q.multi_address(view(spark, sf, "customer").select(k.alias("id"), text.alias("text")))


@query("script_candidates", """SELECT conv_id, turn, CASE WHEN alpha = 0 THEN NULL WHEN latin > 0.05 * alpha THEN 'latin' END AS scripts, coalesce(latin < 0.95 * alpha AND latin > 0.05 * alpha, false) AS mixed FROM (SELECT conv_id, turn, length(text) - length(regexp_replace(text, '\\p{L}', '', 'g')) AS alpha, length(text) - length(regexp_replace(text, '[A-Za-zÀ-ÖØ-öø-ɏ]', '', 'g')) AS latin FROM conversations)""")
def script_candidates(spark, sf):
    """Scripts with over a twentieth of a text's letters, and whether letters are mixed."""
    counts = X.script_counts(F.col("text"))
    rows = view(spark, sf, "conversations").select("conv_id", "turn", *(c.alias(k) for k, c in counts.items()))
    share = {n: F.col(n) > 0.05 * F.col("alpha") for n in X.SCRIPTS}
    found = F.array_join(F.array_compact(F.array(*(F.when(c, n) for n, c in share.items()))), ",")
    return rows.select("conv_id", "turn", F.nullif(found, F.lit("")).alias("scripts"), F.coalesce((F.col("latin") < 0.95 * F.col("alpha")) & share["latin"], F.lit(False)).alias("mixed"))
