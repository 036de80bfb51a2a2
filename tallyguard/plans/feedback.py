"""Queries over feedback, decisions and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feedback as K
from ..sources.views import EVENTS_AS_OF, ORACLE_VIEWS, view, with_views
from .registry import query

_RECENT = f"created_at >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 20 DAYS"


@query("feedback_stats", with_views(f"""SELECT total, correct, false_positives, false_negatives, real_receipts, fake_receipts, suspicious_receipts, round(correct / total * 100, 2) AS accuracy FROM (
  SELECT count(*) AS total, count(*) FILTER (system_verdict = correct_verdict) AS correct, count(*) FILTER (system_verdict <> 'real' AND correct_verdict = 'real') AS false_positives,
    count(*) FILTER (system_verdict = 'real' AND correct_verdict <> 'real') AS false_negatives, count(*) FILTER (correct_verdict = 'real') AS real_receipts,
    count(*) FILTER (correct_verdict = 'fake') AS fake_receipts, count(*) FILTER (correct_verdict = 'suspicious') AS suspicious_receipts FROM {{feedback}} WHERE {_RECENT})"""))
def feedback_stats(spark, sf):
    return K.statistics(K.recent(view(spark, sf, "feedback"), EVENTS_AS_OF, 20))


#: Two indicators of an event, as JSON; every seventh is malformed.
ORACLE_VIEWS["missed"] = """SELECT feedback_id AS doc_id, created_at, event_type, unnest(['i' || (feedback_id % 13), event_type]) AS indicator FROM {feedback} WHERE feedback_id % 7 <> 0"""


def _missed(spark, sf):
    good = F.to_json(F.array(F.concat(F.lit("i"), (F.col("feedback_id") % 13).cast("string")), F.col("event_type")))
    return view(spark, sf, "feedback").withColumn("missed_indicators", F.when(F.col("feedback_id") % 7 == 0, "[broken").otherwise(good))


@query("missed_indicators_top", with_views("SELECT indicator, count(*) AS n FROM {missed} GROUP BY indicator ORDER BY n DESC, indicator LIMIT 5"))
def missed_indicators_top(spark, sf):
    return K.most_missed(_missed(spark, sf))


@query("decision_stats", with_views("SELECT lower(upper(system_verdict)) AS label, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0 AS avg_score FROM {feedback} GROUP BY 1"))
def decision_stats(spark, sf):
    return K.decisions(view(spark, sf, "feedback").select(F.upper("system_verdict").alias("label"), F.round(F.col("value") * 100).cast("long").alias("score_c")))


@query("latest_analysis", with_views("SELECT receipt_id, feedback_id, created_at, system_verdict FROM (SELECT *, row_number() OVER (PARTITION BY receipt_id ORDER BY created_at DESC, feedback_id DESC) AS n FROM {feedback}) WHERE n = 1"))
def latest_analysis(spark, sf):
    return K.latest(view(spark, sf, "feedback"), "receipt_id", "created_at", "feedback_id").select("receipt_id", "feedback_id", "created_at", "system_verdict")


@query("feedback_with_predictions", with_views("SELECT f.feedback_id, f.receipt_id, c.issue, c.status, a.system_verdict AS latest_verdict FROM {feedback} f JOIN {claims} c ON f.receipt_id = c.id JOIN (SELECT receipt_id, arg_max(system_verdict, (created_at, feedback_id)) AS system_verdict FROM {feedback} GROUP BY receipt_id) a ON f.receipt_id = a.receipt_id"))
def feedback_with_predictions(spark, sf):
    f, c = view(spark, sf, "feedback"), view(spark, sf, "claims")
    newest = K.latest(f, "receipt_id", "created_at", "feedback_id").select(F.col("receipt_id").alias("l_id"), F.col("system_verdict").alias("latest_verdict"))
    joined = f.join(c, f["receipt_id"] == c["id"]).join(newest, f["receipt_id"] == newest["l_id"])
    return joined.select("feedback_id", "receipt_id", "issue", "status", "latest_verdict")


@query("learned_rules_train", with_views("""SELECT event_type AS rule_type, indicator AS pattern, count(*) AS learned_from, min(created_at) AS first_seen, max(created_at) AS last_seen,
  CAST(least(50, CASE event_type WHEN 'purchase' THEN 20 WHEN 'view' THEN 15 WHEN 'click' THEN 25 ELSE 10 END + 5 * (count(*) - 1)) AS DOUBLE) / 100.0 AS adjustment FROM {missed} GROUP BY 1, 2"""))
def learned_rules_train(spark, sf):
    rows = _missed(spark, sf).withColumn("pattern", F.explode(F.from_json("missed_indicators", "array<string>")))
    return K.learn_rules(rows.withColumnRenamed("event_type", "rule_type"), initial={"purchase": 20, "view": 15, "click": 25, "signup": 10, "error": 10})


@query("learned_rules_apply", with_views("""SELECT doc_id, count(adjustment_c) AS n_rules, CAST(least(40, coalesce(sum(adjustment_c), 0)) AS DOUBLE) / 100.0 AS adjustment FROM {missed} m
  LEFT JOIN (SELECT 'i' || (x % 13) AS pattern, max(x) AS adjustment_c FROM range(40) t(x) WHERE x % 2 = 0 AND x % 13 < 9 GROUP BY 1) r ON m.indicator = r.pattern GROUP BY doc_id"""))
def learned_rules_apply(spark, sf):
    rows = _missed(spark, sf).withColumn("indicator", F.explode(F.from_json("missed_indicators", "array<string>"))).select(F.col("feedback_id").alias("doc_id"), "indicator")
    x = F.col("id")
    rules = spark.range(40).select(F.lit("user").alias("rule_type"), F.concat(F.lit("i"), (x % 13).cast("string")).alias("pattern"), x.alias("adjustment_c"), ((x % 2 == 0) & (x % 13 < 9)).alias("enabled"))
    return K.apply_rules(rows, rules)
