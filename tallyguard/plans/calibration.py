"""Queries of calibration, labels, telemetry and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as C
from ..sources.views import ORACLE_VIEWS, VIEWS, view, with_views
from .registry import query

#: A label and a probability in hundredths that follows the text's length, with its bucket's entity.
VIEWS["predictions"] = """
SELECT l.doc_id AS id, CAST(l.quality AS BIGINT) AS y, CAST(CASE WHEN l.quality = 1 THEN (d.n_chars * 7 + 35) % 66 + 35 ELSE (d.n_chars * 13) % 71 END AS BIGINT) AS p_c, concat('e', CAST(l.doc_id % 5 AS STRING)) AS entity
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id
"""
VIEWS["judgments"] = """
SELECT user_id AS doc_id, event_id AS judgment_id, CASE WHEN value < 40 THEN 'GENUINE' WHEN value < 75 THEN 'FRAUDULENT' ELSE 'INCONCLUSIVE' END AS outcome, CAST(event_id % 3 AS INT) AS n_fraud_types, CAST(event_id % 4 AS INT) AS n_reasons,
  CASE event_id % 5 WHEN 0 THEN 'NONE' WHEN 1 THEN 'WEAK' WHEN 2 THEN 'MODERATE' ELSE 'STRONG' END AS evidence_strength FROM {events}
"""


_PIECES = " ".join(
    f"WHEN p_c / 100.0 <= {x2!r} THEN {y1!r} + (p_c / 100.0 - {x1!r}) / ({x2!r} - {x1!r})::DOUBLE * ({y2!r} - {y1!r})::DOUBLE" for (x1, y1), (x2, y2) in zip(C.BREAKPOINTS, C.BREAKPOINTS[1:], strict=False)
)


@query("calibration_apply", with_views(f"""SELECT id, p_c, CASE WHEN p_c >= 100 THEN 0.97 WHEN p_c <= 0 THEN 0.05 {_PIECES} END AS calibrated,
  CASE WHEN p_c >= 80 THEN 'HIGH' WHEN p_c >= 55 THEN 'MEDIUM' WHEN p_c > 0 THEN 'LOW' ELSE 'NONE' END AS bucket FROM {{predictions}}"""))
def calibration_apply(spark, sf):
    p = F.col("p_c") / 100.0
    return view(spark, sf, "predictions").select("id", "p_c", C.calibrate(p).alias("calibrated"), C.bucket(p).alias("bucket"))


@query("calibration_buckets", with_views("SELECT bin, count(*) AS n, sum(y) / count(*) AS accuracy, CAST(sum(p_c) AS DOUBLE) / count(*) / 100.0 AS confidence FROM (SELECT CAST(ceil(p_c / 10.0) - 1 AS BIGINT) AS bin, y, p_c FROM {predictions} WHERE p_c > 0) GROUP BY bin"))
def calibration_buckets(spark, sf):
    return C.reliability(view(spark, sf, "predictions"))


ORACLE_VIEWS["ece_right"] = "SELECT sum(abs(g)) AS gap, count(*) AS bins FROM (SELECT sum(p_c) - 100 * sum(y) AS g FROM {predictions} WHERE p_c > 0 GROUP BY ceil(p_c / 10.0))"


@query("calibration_ece", with_views("SELECT n, bins, brier, CAST(gap AS DOUBLE) / n / 100.0 AS ece FROM (SELECT count(*) AS n, CAST(sum((p_c - 100 * y) * (p_c - 100 * y)) AS DOUBLE) / count(*) / 10000.0 AS brier FROM {predictions}), {ece_right}"))
def calibration_ece(spark, sf):
    return C.calibration_error(view(spark, sf, "predictions"))


@query("calibration_ece_left", with_views("SELECT n, bins, brier, CAST(gap AS DOUBLE) / n / 100.0 AS ece FROM (SELECT count(*) AS n, CAST(sum((p_c - 100 * y) * (p_c - 100 * y)) AS DOUBLE) / count(*) / 10000.0 AS brier FROM {predictions}), (SELECT sum(abs(g)) AS gap, count(*) AS bins FROM (SELECT sum(p_c) - 100 * sum(y) AS g FROM {predictions} GROUP BY least(p_c // 10, 9)))"))
def calibration_ece_left(spark, sf):
    return C.calibration_error(view(spark, sf, "predictions"), "left")


@query("confusion", with_views("SELECT tp, fp, fn, tn, (tp + tn) / (tp + fp + fn + tn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM (SELECT count(*) FILTER (p_c >= 50 AND y = 1) AS tp, count(*) FILTER (p_c >= 50 AND y = 0) AS fp, count(*) FILTER (p_c < 50 AND y = 1) AS fn, count(*) FILTER (p_c < 50 AND y = 0) AS tn FROM {predictions})"))
def confusion(spark, sf):
    return C.confusion(view(spark, sf, "predictions"))


@query("roc_auc", with_views("SELECT CAST(sum(CASE WHEN a.p_c > b.p_c THEN 2 WHEN a.p_c = b.p_c THEN 1 ELSE 0 END) AS DOUBLE) / (2.0 * count(*)) AS auc FROM (SELECT p_c FROM {predictions} WHERE y = 1) a, (SELECT p_c FROM {predictions} WHERE y = 0) b"))
def roc_auc(spark, sf):
    return C.roc_auc(view(spark, sf, "predictions"))


@query("high_confidence_errors", with_views("SELECT id, p_c FROM {predictions} WHERE y = 0 AND p_c >= 60 ORDER BY p_c DESC, id LIMIT 10"))
def high_confidence_errors(spark, sf):
    return C.high_confidence_errors(view(spark, sf, "predictions"), 60)


ORACLE_VIEWS["ece_now"] = "SELECT entity, CAST(sum(abs(g)) AS DOUBLE) / sum(n) / 100.0 AS ece FROM (SELECT entity, count(*) AS n, sum(p_c) - 100 * sum(y) AS g FROM {predictions} WHERE p_c > 0 AND id % 2 = 0 GROUP BY entity, ceil(p_c / 10.0)) GROUP BY entity"
ORACLE_VIEWS["ece_then"] = ORACLE_VIEWS["ece_now"].replace("id % 2 = 0", "id % 2 = 1")


@query("calibration_regression", with_views("SELECT n.entity, n.ece - t.ece AS change, n.ece - t.ece > 0.02 AS regressed FROM {ece_now} n JOIN {ece_then} t ON n.entity = t.entity"))
def calibration_regression(spark, sf):
    p = view(spark, sf, "predictions").where("p_c > 0").withColumn("bin", C.bin_of(F.col("p_c") / 100.0))

    def ece(rows):
        gaps = rows.groupBy("entity", "bin").agg(F.abs(F.sum("p_c") - 100 * F.sum("y")).alias("gap"), F.count("*").alias("n"))
        return gaps.groupBy("entity").agg((F.sum("gap") / F.sum("n") / 100.0).alias("ece"))

    return C.regressions(ece(p.where("id % 2 = 0")), ece(p.where("id % 2 = 1")))


@query("label_majority", with_views("SELECT doc_id, outcome, votes, CAST(n_judgments AS BIGINT) AS n_judgments, votes / n_judgments AS agreement FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, outcome) AS n, sum(votes) OVER (PARTITION BY doc_id) AS n_judgments FROM (SELECT doc_id, outcome, count(*) AS votes FROM {judgments} GROUP BY ALL)) WHERE n = 1"))
def label_majority(spark, sf):
    return C.majority(view(spark, sf, "judgments"))


@query("annotator_agreement", with_views("SELECT count(*) AS n_docs, count(*) FILTER (most = n) AS unanimous, round(sum(most / n) / count(*), 6) AS mean_agreement FROM (SELECT doc_id, max(votes) AS most, sum(votes) AS n FROM (SELECT doc_id, outcome, count(*) AS votes FROM {judgments} GROUP BY ALL) GROUP BY doc_id) WHERE n > 1"))
def annotator_agreement(spark, sf):
    return C.agreement_by_document(view(spark, sf, "judgments"))


@query("label_constraints", with_views("""SELECT judgment_id, concat_ws(',', CASE WHEN outcome = 'GENUINE' AND n_fraud_types > 0 THEN 'genuine_with_fraud_types' END, CASE WHEN outcome = 'FRAUDULENT' AND n_fraud_types = 0 THEN 'fraudulent_without_fraud_types' END,
  CASE WHEN outcome = 'FRAUDULENT' AND n_reasons < 2 THEN 'fraudulent_with_few_reasons' END, CASE WHEN outcome = 'GENUINE' AND evidence_strength NOT IN ('NONE', 'WEAK') THEN 'genuine_with_strong_evidence' END, CASE WHEN outcome = 'INCONCLUSIVE' AND evidence_strength = 'NONE' THEN 'inconclusive_without_evidence' END) AS violations FROM {judgments}"""))
def label_constraints(spark, sf):
    return C.violations(view(spark, sf, "judgments")).select("judgment_id", "violations")


@query("address_telemetry", with_views("SELECT brand, status, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY brand), 2) AS pct FROM {claims} GROUP BY brand, status"))
def address_telemetry(spark, sf):
    from pyspark.sql import Window as W

    counted = view(spark, sf, "claims").groupBy("brand", "status").agg(F.count("*").alias("n"))
    return counted.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy("brand")), 2))


@query("isotonic_fit")
def isotonic_fit(spark, sf):
    """Breakpoints of an isotonic calibrator of the predictions."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    rows = view(spark, sf, "predictions").select(F.col("y").cast("double").alias("label"), (F.col("p_c") / 100.0).cast("double").alias("p"))
    data = VectorAssembler(inputCols=["p"], outputCol="features").transform(rows)
    model = IsotonicRegression().fit(data)
    pairs = list(zip(map(float, model.boundaries), map(float, model.predictions), strict=True))
    return spark.createDataFrame(pairs, "x double, y double")


@query("forest_train")
def forest_train(spark, sf):
    """Importance of the features of a forest that predicts a claim's status."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    names = ["parts_c", "labor_c", "tax_c", "total_c", "odometer", "year", "labor_hours", "image_count"]
    rows = view(spark, sf, "claims").select((F.col("status") == "Rejected").cast("double").alias("label"), *(F.col(n).cast("double").alias(n) for n in names))
    data = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    model = RandomForestClassifier(numTrees=10, maxDepth=4, seed=7).fit(data)
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, model.featureImportances.toArray(), strict=True)], "feature string, importance double")
