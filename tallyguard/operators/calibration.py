"""Calibration of confidences and quality of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Breakpoints of a calibrator, bucket limits, and constraints of labels.
BREAKPOINTS = ((0.0, 0.05), (0.1, 0.12), (0.2, 0.2), (0.3, 0.31), (0.4, 0.42), (0.5, 0.55), (0.6, 0.66), (0.7, 0.76), (0.8, 0.85), (0.9, 0.92), (1.0, 0.97))
BUCKETS = (("HIGH", 0.8), ("MEDIUM", 0.55))


def calibrate(raw: Column, points=BREAKPOINTS) -> Column:
    """Piecewise-linear calibration, clamped to 0 and 1."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    out = F.when(x >= points[-1][0], points[-1][1]).when(x <= points[0][0], points[0][1])
    for (x1, y1), (x2, y2) in zip(points, points[1:], strict=False):
        out = out.when(x <= x2, y1 + (x - x1) / (x2 - x1) * (y2 - y1))
    return F.when(raw.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), out)))


def bucket(p: Column) -> Column:
    out = F.when(p >= BUCKETS[0][1], BUCKETS[0][0])
    for name, least in BUCKETS[1:]:
        out = out.when(p >= least, name)
    return out.when(p > 0, "LOW").otherwise("NONE")


def bin_of(p: Column, bins: int = 10, closed: str = "right") -> Column:
    """The number of a probability's bin: (lo, hi] drops 0, [lo, hi) closes its last bin."""
    if closed == "right":
        return F.when(p > 0, F.ceil(p * bins) - 1)
    return F.least(F.floor(p * bins), F.lit(bins - 1))


def reliability(scored: DataFrame, closed: str = "right") -> DataFrame:
    """By bin: count, accuracy and mean confidence; ``p_c`` is the probability in hundredths, ``y`` 0 or 1."""
    binned = scored.withColumn("bin", bin_of(F.col("p_c") / 100.0, 10, closed)).where("bin IS NOT NULL")
    n = F.count("*")
    return binned.groupBy("bin").agg(n.alias("n"), (F.sum("y") / n).alias("accuracy"), (F.sum("p_c") / n / 100.0).alias("confidence"))


def calibration_error(scored: DataFrame, closed: str = "right") -> DataFrame:
    """One row: expected calibration error, Brier score and the sizes they come from."""
    n = scored.agg(F.count("*").alias("n"), (F.sum((F.col("p_c") - 100 * F.col("y")) * (F.col("p_c") - 100 * F.col("y"))) / F.count("*") / 10_000.0).alias("brier"))
    gaps = scored.withColumn("bin", bin_of(F.col("p_c") / 100.0, 10, closed)).where("bin IS NOT NULL").groupBy("bin").agg(F.abs(F.sum("p_c") - 100 * F.sum("y")).alias("gap"))
    total = gaps.agg(F.sum("gap").alias("gap"), F.count("*").alias("bins"))
    return n.crossJoin(total).select("n", "bins", "brier", (F.col("gap") / F.col("n") / 100.0).alias("ece"))  # one row each


def confusion(scored: DataFrame, at: int = 50) -> DataFrame:
    """One row: the four counts at a threshold in hundredths, with accuracy, precision, recall and F1."""
    hit, y = F.col("p_c") >= at, F.col("y") == 1
    counts = scored.agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    return counts.select(
        "*", F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"), F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def roc_auc(scored: DataFrame) -> DataFrame:
    """One row: the area under the curve, from rank sums over the distinct probabilities."""
    by = scored.groupBy("p_c").agg(F.sum("y").alias("pos"), (F.count("*") - F.sum("y")).alias("neg"))
    below = F.coalesce(F.sum("neg").over(W.orderBy("p_c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # as many rows as hundredths
    ranked = by.withColumn("wins2", F.col("pos") * (2 * below + F.col("neg")))
    return ranked.agg((F.sum("wins2") / (2.0 * F.sum("pos") * F.sum("neg"))).alias("auc"))


def high_confidence_errors(scored: DataFrame, at: int = 70, limit: int = 10) -> DataFrame:
    return scored.where((F.col("y") == 0) & (F.col("p_c") >= at)).orderBy(F.desc("p_c"), "id").limit(limit).select("id", "p_c")


def regressions(current: DataFrame, previous: DataFrame, most_c: float = 0.02) -> DataFrame:
    """Entities whose calibration error got worse by more than ``most_c``."""
    p = previous.select(F.col("entity").alias("p_entity"), F.col("ece").alias("p_ece"))
    j = current.join(p, current["entity"] == p["p_entity"])
    return j.select("entity", (F.col("ece") - F.col("p_ece")).alias("change"), (F.col("ece") - F.col("p_ece") > most_c).alias("regressed"))


def majority(judgments: DataFrame) -> DataFrame:
    """The outcome that most judgments of a document give, ties by name, and how many agree."""
    votes = judgments.groupBy("doc_id", "outcome").agg(F.count("*").alias("votes"))
    best = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("votes"), "outcome"))
    every = F.sum("votes").over(W.partitionBy("doc_id"))
    ranked = votes.withColumns({"n": best, "n_judgments": every}).where("n = 1")
    return ranked.select("doc_id", "outcome", "votes", "n_judgments", (F.col("votes") / F.col("n_judgments")).alias("agreement"))


def violations(judgments: DataFrame) -> DataFrame:
    """Which constraints a judgment breaks, joined by commas."""
    outcome, types, reasons, strength = F.col("outcome"), F.col("n_fraud_types"), F.col("n_reasons"), F.col("evidence_strength")
    rules = (
        ("genuine_with_fraud_types", (outcome == "GENUINE") & (types > 0)), ("fraudulent_without_fraud_types", (outcome == "FRAUDULENT") & (types == 0)),
        ("fraudulent_with_few_reasons", (outcome == "FRAUDULENT") & (reasons < 2)), ("genuine_with_strong_evidence", (outcome == "GENUINE") & ~strength.isin("NONE", "WEAK")),
        ("inconclusive_without_evidence", (outcome == "INCONCLUSIVE") & (strength == "NONE")),
    )
    return judgments.withColumn("violations", F.array_join(F.array_compact(F.array(*(F.when(c, n) for n, c in rules))), ","))


def agreement_by_document(judgments: DataFrame) -> DataFrame:
    """One row over the documents with several judgments: how many, how many unanimous, mean agreement."""
    several = majority(judgments).where("n_judgments > 1")
    n = F.count("*")
    return several.agg(n.alias("n_docs"), F.count_if(F.col("votes") == F.col("n_judgments")).alias("unanimous"), F.round(F.sum("agreement") / n, 6).alias("mean_agreement"))
