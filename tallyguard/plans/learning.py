"""Queries of rules learned from feedback, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning as L
from ..sources import sinks
from ..sources.views import ORACLE_VIEWS, VIEWS, view, with_views
from ..streaming import registry as T
from .registry import query

#: Feedback with what was detected and what people say of it; lists are parted by bars.
VIEWS["lessons"] = """SELECT feedback_id, created_at, system_verdict, correct_verdict,
  CASE WHEN feedback_id % 4 < 3 THEN CASE receipt_id % 5 WHEN 0 THEN 'Canva' WHEN 1 THEN 'Figma' WHEN 2 THEN 'GIMP 2' ELSE 'Photoshop' END END AS software_detected, feedback_id % 3 > 0 AS software_flagged,
  feedback_id % 2 = 0 AS has_spacing_issue, feedback_id % 5 = 0 AS has_date_issue,
  CASE feedback_id % 7 WHEN 0 THEN concat('Odd spacing in total|merchant: ', event_type) WHEN 1 THEN concat('torn corner ', CAST(receipt_id % 9 AS STRING), '|Invalid phone') WHEN 2 THEN 'PDF made by Canva|PDF made by Canva' END AS missed,
  CASE feedback_id % 9 WHEN 0 THEN 'spacing' WHEN 1 THEN concat('torn corner ', CAST(receipt_id % 9 AS STRING)) END AS confirmed,
  CASE WHEN feedback_id % 13 < 2 THEN concat('torn corner ', CAST(feedback_id % 9 AS STRING), ': it was: whole|bad date') END AS belied,
  CASE WHEN feedback_id % 17 = 0 THEN concat('Shop ', CAST(receipt_id % 20 AS STRING)) END AS corrected_merchant FROM {feedback}"""

#: What feedback says of rules, in words of its own: the patterns of these indicators are written out.
_USER = {
    "missed": "CASE feedback_id % 7 WHEN 0 THEN ['spacing_anomaly', event_type] WHEN 1 THEN ['torn corner ' || (receipt_id % 9), 'invalid_phone'] WHEN 2 THEN ['made', 'made'] END",
    "confirmed": "CASE feedback_id % 9 WHEN 0 THEN ['spacing_anomaly'] WHEN 1 THEN ['torn corner ' || (receipt_id % 9)] END",
    "belied": "CASE WHEN feedback_id % 13 < 2 THEN ['torn corner ' || (feedback_id % 9), 'date_manipulation'] END",
}
_SAID = f"""SELECT l.feedback_id, l.created_at, part, rule_type, pattern, op FROM (SELECT l.*, f.event_type, f.receipt_id, l.system_verdict <> 'real' AND l.correct_verdict = 'real' AS alarm, l.system_verdict = 'real' AND l.correct_verdict <> 'real' AS lost FROM {{lessons}} l JOIN {{feedback}} f USING (feedback_id)) l, LATERAL (
  SELECT 0 AS part, 'suspicious_software' AS rule_type, software_detected AS pattern, 'raise' AS op WHERE lost AND software_detected IS NOT NULL UNION ALL SELECT 1, 'spacing_threshold', 'consecutive_spaces', 'raise' WHERE lost AND has_spacing_issue
  UNION ALL SELECT 2, 'date_manipulation', 'creation_after_receipt', 'raise' WHERE lost AND has_date_issue UNION ALL SELECT 3, 'suspicious_software', software_detected, 'lower' WHERE alarm AND software_flagged AND software_detected IS NOT NULL
  UNION ALL SELECT 10 + i, 'user_identified_pattern', w[i], 'raise' FROM (SELECT {_USER['missed']} AS w, unnest(range(1, 3)) AS i) WHERE w[i] IS NOT NULL UNION ALL SELECT 20 + i, 'user_identified_pattern', w[i], 'confirm' FROM (SELECT {_USER['confirmed']} AS w, unnest(range(1, 3)) AS i) WHERE w[i] IS NOT NULL
  UNION ALL SELECT 30, 'merchant_pattern', corrected_merchant, 'raise' WHERE corrected_merchant IS NOT NULL UNION ALL SELECT 40 + i, 'user_identified_pattern', w[i], 'belie' FROM (SELECT {_USER['belied']} AS w, unnest(range(1, 3)) AS i) WHERE w[i] IS NOT NULL)"""
ORACLE_VIEWS["said"] = _SAID
_FIRST = "CASE rule_type WHEN 'suspicious_software' THEN 20 WHEN 'spacing_threshold' THEN 15 WHEN 'date_manipulation' THEN 25 WHEN 'user_identified_pattern' THEN 15 ELSE 0 END"
_GAIN = "CASE rule_type WHEN 'suspicious_software' THEN 5 WHEN 'merchant_pattern' THEN 0 ELSE 3 END"
#: One arrival after another: v is the adjustment (null before the rule is there), e whether it is on, w whether it is white.
_FOLD = f"""WITH RECURSIVE q AS MATERIALIZED (SELECT rule_type, pattern, op, created_at, row_number() OVER (PARTITION BY rule_type, pattern ORDER BY created_at, feedback_id, part) AS n FROM {{said}}),
  z AS (SELECT rule_type, pattern, CAST(0 AS BIGINT) AS n, CAST(NULL AS INT) AS v, true AS e, false AS w, CAST(0 AS BIGINT) AS c, CAST(NULL AS TIMESTAMP) AS born, CAST(NULL AS TIMESTAMP) AS last FROM (SELECT DISTINCT rule_type, pattern FROM q)
  UNION ALL SELECT z.rule_type, z.pattern, q.n, CASE WHEN v IS NULL THEN CASE op WHEN 'raise' THEN {_FIRST.replace('rule_type', 'z.rule_type')} WHEN 'belie' THEN -10 END WHEN op = 'raise' AND w THEN {_FIRST.replace('rule_type', 'z.rule_type')} WHEN op = 'raise' THEN least(50, v + {_GAIN.replace('rule_type', 'z.rule_type')}) WHEN op = 'confirm' THEN least(50, v + 2) WHEN op = 'belie' THEN greatest(0, v - 8) WHEN v > 5 THEN v - 5 ELSE v END,
    CASE WHEN v IS NULL OR (op = 'raise' AND w) THEN true WHEN op = 'belie' THEN e AND v > 8 WHEN op = 'lower' THEN e AND v > 5 ELSE e END, CASE WHEN v IS NULL THEN op = 'belie' ELSE w AND op <> 'raise' END,
    c + CASE WHEN v IS NULL THEN CAST(op IN ('raise', 'belie') AS INT) WHEN op = 'belie' OR (op = 'lower' AND v <= 5) THEN 0 ELSE 1 END, CASE WHEN v IS NULL AND op IN ('raise', 'belie') THEN q.created_at ELSE born END, CAST(q.created_at AS TIMESTAMP) FROM z JOIN q ON z.rule_type = q.rule_type AND z.pattern = q.pattern AND q.n = z.n + 1)
  SELECT rule_type, pattern, v AS adjustment_c, e AS enabled, w AS white, c AS learned_from, born AS first_seen, last AS last_seen FROM z WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rule_type, pattern ORDER BY n DESC) = 1"""
_LEARNED = with_views(_FOLD.replace("WITH RECURSIVE", "WITH"), recursive=True)


def _arrivals(spark, sf, given=None):
    lessons = view(spark, sf, "lessons", given)
    named = {"missed_indicators": "missed", "confirmed_indicators": "confirmed", "false_indicators": "belied"}
    return L.arrivals(lessons.select("*", *(F.split(c, "[|]").alias(n) for n, c in named.items())))


@query("learned_rules", _LEARNED)
def learned_rules(spark, sf):
    """All rules after all feedback."""
    return L.learn(_arrivals(spark, sf))


@query("learned_rules_stream", _LEARNED)
def learned_rules_stream(spark, sf):
    """The same rules by a stream over the events, each as its last batch left it."""
    at = sinks.shared_folder(spark)
    events = T.files(spark, f"{sf}/events.parquet", view(spark, sf, "events").schema)
    out = T.drained(L.learn_stream(_arrivals(spark, sf, {"events": events})), f"{at}/out", f"{at}/checkpoint")
    last = out.groupBy("rule_type", "pattern").agg(F.max_by(F.struct(*out.columns), "version").alias("row"))
    return last.select("row.*").drop("version")
