"""Queries of streams, sources, sinks and page layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import duplicates as P
from ..operators import layout as L
from ..sources import readers, sinks
from ..sources.views import VIEWS, view, with_views
from ..streaming import registry as T
from .registry import query


def _events(spark, sf):
    schema = view(spark, sf, "events").schema
    return T.files(spark, f"{sf}/events.parquet", schema)


def _arrivals(events):
    """Events as receipts: the user is the merchant, the day the date, the value the total."""
    merchant, day = F.concat(F.lit("m"), (F.col("user_id") % 20).cast("string")), F.date_format("ts", "yyyy-MM-dd")
    return P.fingerprinted(events.select(F.col("event_id").alias("id"), merchant.alias("merchant"), day.alias("receipt_date"), (F.floor("value") % 30).cast("double").alias("total")))


_PRINTS = """SELECT event_id AS id, concat_ws('|', 'm' || (user_id % 20), strftime(ts, '%Y-%m-%d'), format('{:.2f}', (floor(value) % 30)::DOUBLE)) AS exact_fp,
  concat_ws('|', 'm' || (user_id % 20), strftime(ts, '%Y-%m-%d'), CASE WHEN floor(value) % 30 <= 0 THEN 'zero' ELSE CAST(floor((floor(value) % 30) / 10) AS VARCHAR) END) AS fuzzy_fp FROM events"""


@query("streaming_duplicate_registry", f"""SELECT id, CASE WHEN id = of THEN 'new' WHEN exact_fp = e THEN 'exact' ELSE 'fuzzy' END AS status, CASE WHEN id <> of THEN of END AS duplicate_of
  FROM (SELECT *, first_value(id) OVER w AS of, first_value(exact_fp) OVER w AS e FROM ({_PRINTS}) WINDOW w AS (PARTITION BY fuzzy_fp ORDER BY id))""")
def streaming_duplicate_registry(spark, sf):
    at = sinks.shared_folder(spark)
    stream = T.duplicates(_arrivals(_events(spark, sf)).select("id", "exact_fp", "fuzzy_fp"))
    return T.drained(stream, f"{at}/out", f"{at}/checkpoint")


@query("streaming_trend", "SELECT CAST(date_trunc('month', ts) AS DATE) AS month, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value_c FROM events GROUP BY ALL")
def streaming_trend(spark, sf):
    at = sinks.shared_folder(spark)
    stream = T.monthly(_events(spark, sf).select("ts", "event_type", F.round(F.col("value") * 100).cast("long").alias("value_c")))
    return T.drained(stream, f"{at}/out", f"{at}/checkpoint", "complete")


@query("streaming_windows", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL")
def streaming_windows(spark, sf):
    """Days that the watermark has closed."""
    at = sinks.shared_folder(spark)
    stream = T.windowed(_events(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), "event_type"))
    out = T.drained(stream, f"{at}/out", f"{at}/checkpoint")
    return out.select(F.to_date("window.start").alias("day"), "event_type", "n")


@query("rolling_windows", "SELECT CAST(s AS DATE) AS window_start, event_type, count(*) AS n FROM events, (SELECT unnest(generate_series((SELECT CAST(min(ts) AS DATE) - 7 FROM events), (SELECT CAST(max(ts) AS DATE) FROM events), INTERVAL 1 DAY)) AS s) WHERE ts >= s AND ts < s + INTERVAL 7 DAYS GROUP BY ALL")
def rolling_windows(spark, sf):
    rows = T.rolling(view(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), 7)
    day = F.to_date("window.start")
    return rows.select(day.alias("window_start"), "event_type", "n")


VIEWS["claim_texts"] = """SELECT id, concat('Claim ID: WC', lpad(CAST(id AS STRING), 8, '0'), chr(10), 'Brand: ', coalesce(brand, ''), chr(10), 'Year: ', CAST(year AS STRING), chr(10), 'VIN: ', vin, chr(10), 'Mileage: ', CAST(odometer // 1000 AS STRING), ',', lpad(CAST(odometer % 1000 AS STRING), 3, '0'), chr(10),
  'Issue Description: ', issue, chr(10), 'Claim Date: ', claim_date, chr(10), 'Parts Cost: $', CAST(parts_c // 100 AS STRING), '.50', chr(10), 'Labor Cost: $', CAST(labor_c // 100 AS STRING), chr(10), 'Tax: $', CAST(tax_c // 100 AS STRING), chr(10), 'Claim Status: ', status) AS text FROM {claims}"""


def _field(name: str) -> str:
    found = f"nullif(trim(regexp_extract(text, '(?i){readers.CLAIM_FIELDS[name]}', 1)), '')"
    kind = {"year": "INT", "odometer": "INT", "parts_cost": "DOUBLE", "labor_cost": "DOUBLE", "tax": "DOUBLE"}.get(name)
    return f"TRY_CAST(replace({found}, ',', '') AS {kind}) AS {name}" if kind else f"{found} AS {name}"


@query("claim_fields", with_views("SELECT id, " + ", ".join(map(_field, readers.CLAIM_FIELDS)) + " FROM {claim_texts}"))
def claim_fields(spark, sf):
    return view(spark, sf, "claim_texts").select("id", *(c.alias(k) for k, c in readers.claim_fields(F.col("text")).items()))


@query("upsert_latest", with_views("SELECT id, status, claim_date FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY claim_date DESC, fresh DESC) AS n FROM (SELECT id, status, claim_date, 0 AS fresh FROM {claims} UNION ALL SELECT id, 'Reopened', CASE WHEN id % 2 = 0 THEN decision_date ELSE claim_date END, 1 FROM {claims} WHERE id % 3 = 0)) WHERE n = 1 AND id % 7 <> 0"))
def upsert_latest(spark, sf):
    """Changed claims merged in, the latest of a key winning, then some keys deleted."""
    claims = view(spark, sf, "claims")
    changes = claims.where("id % 3 = 0").select("id", F.lit("Reopened").alias("status"), F.when(F.col("id") % 2 == 0, F.col("decision_date")).otherwise(F.col("claim_date")).alias("claim_date"))
    merged = sinks.upserted(claims.select("id", "status", "claim_date"), changes, ["id"], "claim_date")
    return sinks.deleted(merged, claims.where("id % 7 = 0").select("id"))


#: Lines of orders as tokens on a page.
VIEWS["tokens"] = "SELECT o_custkey AS page, o_orderkey AS token_id, CAST(o_orderkey % 97 AS DOUBLE) * 5 AS y, CAST((o_orderkey * 31) % 600 AS DOUBLE) AS x FROM {orders}"


@query("token_lines", with_views("""SELECT page, CAST(line AS BIGINT) AS line, count(*) AS n_tokens, min(x) AS x_lo, max(x) AS x_hi, round(avg(gap), 6) AS mean_gap FROM (SELECT *, x - lag(x) OVER (PARTITION BY page, line ORDER BY x, token_id) AS gap FROM (
  SELECT *, sum(jump) OVER (PARTITION BY page ORDER BY y, x, token_id) AS line FROM (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY page ORDER BY y, x, token_id) > 20 THEN 1 ELSE 0 END AS jump FROM {tokens}))) GROUP BY ALL"""))
def token_lines(spark, sf):
    return L.line_statistics(L.text_lines(view(spark, sf, "tokens"), 20.0))


_BOX = "SELECT o_custkey AS page, o_orderkey AS region_id, CAST(o_orderkey % 50 AS DOUBLE) AS x0, CAST(o_orderkey % 50 + 20 AS DOUBLE) AS x1, CAST((o_orderkey * 7) % 60 AS DOUBLE) AS y0, CAST((o_orderkey * 7) % 60 + 15 AS DOUBLE) AS y1 FROM orders"


@query("region_overlaps", f"""SELECT a.page, a.region_id AS region_1, b.region_id AS region_2, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / 300.0, 6) AS share FROM ({_BOX}) a JOIN ({_BOX}) b
  ON a.page = b.page AND a.region_id < b.region_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1""")
def region_overlaps(spark, sf):
    k = F.col("o_orderkey")
    x, y = (k % 50).cast("double"), (k * 7 % 60).cast("double")
    return L.overlapping(view(spark, sf, "orders").select(F.col("o_custkey").alias("page"), k.alias("region_id"), x.alias("x0"), (x + 20).alias("x1"), y.alias("y0"), (y + 15).alias("y1")))


_IOU = "greatest(0, least(k.x1, q[1].x1) - greatest(k.x0, q[1].x0)) * greatest(0, least(k.y1, q[1].y1) - greatest(k.y0, q[1].y0))"
_AREA = "({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0)"
#: Boxes of several sizes, of which many nearly cover one another, and some are equal.
VIEWS["page_boxes"] = """SELECT user_id % 97 AS page, event_id AS region_id, CAST(event_id % 23 AS DOUBLE) AS x0, CAST(event_id % 23 + 60 + event_id % 5 * 4 AS DOUBLE) AS x1,
  CAST(event_id * 7 % 29 AS DOUBLE) AS y0, CAST(event_id * 7 % 29 + 40 + event_id % 3 * 5 + CASE WHEN event_id % 11 = 0 THEN 100 ELSE 0 END AS DOUBLE) AS y1 FROM {events}"""


@query("distinct_regions", with_views(f"""SELECT page, kept[i].r AS region_id, kept[i].x0 AS x0, kept[i].y0 AS y0, kept[i].x1 AS x1, kept[i].y1 AS y1, CAST(i AS INT) AS rank FROM (SELECT page, kept, unnest(range(1, len(kept) + 1)) AS i FROM (
  SELECT page, list_reduce(list_transform(boxes, lambda b: [b]), lambda p, q: CASE WHEN len(list_filter(p, lambda k: {_IOU} > 0.7::DOUBLE * ({_AREA.format('k')} + {_AREA.format('q[1]')} - {_IOU}))) > 0 THEN p ELSE list_concat(p, q) END) AS kept
  FROM (SELECT page, list({{{{'r': region_id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}}} ORDER BY (x1 - x0) * (y1 - y0) DESC, region_id) AS boxes FROM {{page_boxes}} GROUP BY page)))""".replace("{{", "{").replace("}}", "}")))
def distinct_regions(spark, sf):
    return L.distinct_regions(view(spark, sf, "page_boxes"))


@query("spatial_risk", """SELECT *, CASE WHEN risk >= 0.75 THEN 'critical' WHEN risk >= 0.5 THEN 'high' WHEN risk >= 0.25 THEN 'medium' ELSE 'low' END AS level FROM (SELECT user_id AS doc_id, count(*) AS n_signals,
  CAST(least(1.0::DOUBLE, sum(CASE event_id % 4 WHEN 0 THEN 100 WHEN 1 THEN 70 WHEN 2 THEN 40 ELSE 15 END * (event_id % 101))::DOUBLE / count(*) / 10000.0::DOUBLE + count(*) * 5 / 100.0::DOUBLE) AS DOUBLE) AS risk FROM events GROUP BY user_id)""")
def spatial_risk(spark, sf):
    k = F.col("event_id")
    severity = F.when(k % 4 == 0, "critical").when(k % 4 == 1, "high").when(k % 4 == 2, "medium").otherwise("low")
    return L.risk(view(spark, sf, "events").select(F.col("user_id").alias("doc_id"), severity.alias("severity"), (k % 101).alias("confidence_c")))


@query("image_forensics", """SELECT image_id, concat_ws(',', CASE WHEN e > 25 THEN 'ela_splice' END, CASE WHEN n < 1 THEN 'digital_origin' END, CASE WHEN d < 100 THEN 'very_low_resolution' END, CASE WHEN h > 0.3 THEN 'histogram_gaps' END) AS signals, CAST((e > 25)::INT + (n < 1)::INT + (d < 100)::INT + (h > 0.3)::INT AS BIGINT) AS n_signals,
  CASE WHEN (e > 25)::INT + (n < 1)::INT + (d < 100)::INT + (h > 0.3)::INT >= 3 THEN 'CRITICAL' WHEN (e > 25)::INT + (n < 1)::INT + (d < 100)::INT + (h > 0.3)::INT >= 2 THEN 'WARNING' END AS severity FROM (SELECT doc_id AS image_id, n_chars % 40 AS e, (n_chars % 30) / 10 AS n, n_chars % 300 AS d, (n_chars % 7) / 10 AS h FROM documents)""")
def image_forensics(spark, sf):
    c = F.col("n_chars")
    return L.forensics(view(spark, sf, "documents").select(F.col("doc_id").alias("image_id"), (c % 40).cast("double").alias("ela_zone_variance"), (c % 30 / 10).alias("noise_mean"), (c % 300).alias("dpi"), (c % 7 / 10).alias("histogram_gap_ratio")))


@query("audit_log_page", "SELECT event_id, user_id, event_type, ts, count(*) OVER () AS n_fit FROM events WHERE event_type IN ('error', 'signup') AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id DESC LIMIT 20")
def audit_log_page(spark, sf):
    rows = view(spark, sf, "events").where(F.col("event_type").isin("error", "signup") & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")))
    page = rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id", "event_type", "ts")
    return page.crossJoin(rows.agg(F.count("*").alias("n_fit")))  # one row


VIEWS["sized_tokens"] = "SELECT *, CAST(y AS BIGINT) + token_id % 7 + CASE WHEN token_id % 5 = 0 THEN 9 ELSE 0 END AS base, 10 + token_id % 3 + CASE WHEN token_id % 11 = 0 THEN 12 ELSE 0 END AS height FROM {tokens}"


@query("page_anomalies", with_views("""SELECT page, n_lines, concat_ws(',', CASE WHEN m >= 2 THEN 'BASELINE_MISALIGNMENT' END, CASE WHEN u >= 2 THEN 'INTRA_LINE_HEIGHT_VARIATION' END) AS signals FROM (SELECT page, count(*) AS n_lines, count(*) FILTER (apart / n >= 0.15::DOUBLE) AS m, count(*) FILTER (v > 0.0625::DOUBLE) AS u FROM (
  SELECT page, line, count(*) AS n, count(*) FILTER (abs(base - mean) > 3) AS apart, (sum(height * height) * count(*) - sum(height) * sum(height)) / (sum(height) * sum(height)) AS v FROM (SELECT *, sum(base) OVER (PARTITION BY page, line) / count(*) OVER (PARTITION BY page, line) AS mean FROM (
  SELECT *, sum(jump) OVER (PARTITION BY page ORDER BY y, x, token_id) AS line FROM (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY page ORDER BY y, x, token_id) > 60 THEN 1 ELSE 0 END AS jump FROM {sized_tokens}))) GROUP BY page, line HAVING count(*) >= 3) GROUP BY page) WHERE m >= 2 OR u >= 2"""))
def page_anomalies(spark, sf):
    return L.page_signals(L.line_anomalies(L.text_lines(view(spark, sf, "sized_tokens"), 60.0)))


VIEWS["noted"] = """SELECT id, concat_ws(chr(10), full_text, CASE id % 7 WHEN 0 THEN 'Lorem ipsum for John Doe' WHEN 1 THEN '$5 or €4' WHEN 2 THEN '1,234.50 and 1.234,50' WHEN 3 THEN 'call 555-0123' WHEN 4 THEN 'a.b@mailinator.com' WHEN 5 THEN 'c@shop.org' ELSE '[Your Name]' END) AS full_text FROM {receipts}"""
_DOMAINS = "[" + ", ".join(f"'{d}'" for d in L.BRIEF_DOMAINS) + "]"


@query("text_signals", with_views(f"""SELECT id, 'PLACEHOLDER_TEXT_DETECTED' AS signal, 'high' AS severity FROM {{noted}} WHERE regexp_matches(full_text, '(?i){L.PLACEHOLDERS}') UNION ALL SELECT id, 'MULTIPLE_CURRENCIES', 'medium' FROM {{noted}} WHERE len(list_distinct(regexp_extract_all(full_text, '[$€£¥₹]'))) > 1
  UNION ALL SELECT id, 'INCONSISTENT_NUMBER_FORMAT', 'medium' FROM {{noted}} WHERE regexp_matches(full_text, '\\d{{1,3}}(?:,\\d{{3}})+\\.\\d{{2}}\\b') AND regexp_matches(full_text, '\\d{{1,3}}(?:\\.\\d{{3}})+,\\d{{2}}\\b')
  UNION ALL SELECT id, 'PLACEHOLDER_PHONE_NUMBER', 'high' FROM {{noted}} WHERE regexp_matches(full_text, '\\b(?:1234567890|0000000000|555-?01\\d\\d)\\b') UNION ALL SELECT id, 'SUSPICIOUS_EMAIL_DOMAIN', 'medium' FROM {{noted}} WHERE list_has_any(regexp_extract_all(lower(full_text), '[a-z0-9._%+-]+@([a-z0-9-]+)\\.', 1), {_DOMAINS})"""))
def text_signals(spark, sf):
    return L.text_signals(view(spark, sf, "noted"), "id", "full_text")
