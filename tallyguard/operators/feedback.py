"""Feedback statistics, decisions, and rules learned from feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recent(feedback: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return feedback.where(F.col("created_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def kind(system: Column, correct: Column) -> Column:
    """What the system's verdict was wrong about."""
    return F.when((system != "real") & (correct == "real"), "false_positive").when((system == "real") & (correct != "real"), "false_negative")


def statistics(feedback: DataFrame) -> DataFrame:
    """One row: how many verdicts were right, of which kind the others are, and the accuracy in per cent."""
    n, right = F.count("*"), F.count_if(F.col("system_verdict") == F.col("correct_verdict"))
    wrong = kind(F.col("system_verdict"), F.col("correct_verdict"))
    return feedback.agg(
        n.alias("total"), right.alias("correct"), F.count_if(wrong == "false_positive").alias("false_positives"), F.count_if(wrong == "false_negative").alias("false_negatives"),
        *(F.count_if(F.col("correct_verdict") == v).alias(f"{v}_receipts") for v in ("real", "fake", "suspicious")),
        F.coalesce(F.round(F.try_divide(right, n) * 100, 2), F.lit(0.0)).alias("accuracy"),
    )


def most_missed(feedback: DataFrame, limit: int = 5) -> DataFrame:
    """The indicators most often missed: ``missed_indicators`` is a JSON array; malformed text counts for nothing."""
    one = feedback.select(F.explode(F.from_json("missed_indicators", "array<string>")).alias("indicator"))
    return one.groupBy("indicator").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "indicator").limit(limit)


def decisions(analyses: DataFrame) -> DataFrame:
    """How many decisions each label has, and their mean score."""
    n = F.count("*")
    return analyses.groupBy(F.lower("label").alias("label")).agg(n.alias("n"), (F.sum("score_c") / n / 100.0).alias("avg_score"))


def latest(analyses: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The newest row of every key, as an aggregate: a key's rows are reduced before they are shuffled."""
    newest = F.max_by(F.struct(*analyses.columns), F.struct(time, tie))
    return analyses.groupBy(F.col(key).alias("__key")).agg(newest.alias("row")).select("row.*")


def learn_rules(feedback: DataFrame, *, initial: dict[str, int], step: int = 5, most: int = 50) -> DataFrame:
    """Rules from feedback, in hundredths: (type, pattern) starts at ``initial`` and gains ``step`` with each further row, up to ``most``.

    The fold of the arrivals of a rule has a closed form, so it is a count.
    """
    start = F.create_map(*(F.lit(x) for pair in initial.items() for x in pair))[F.col("rule_type")]
    rules = feedback.groupBy("rule_type", "pattern").agg(F.count("*").alias("learned_from"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))
    return rules.withColumn("adjustment", F.least(F.lit(most), start + step * (F.col("learned_from") - 1)) / 100.0)


def apply_rules(documents: DataFrame, rules: DataFrame, cap: int = 40) -> DataFrame:
    """The learned adjustment of every document: each enabled (type, pattern) once, their sum capped, in hundredths."""
    enabled = rules.where("enabled").groupBy("rule_type", "pattern").agg(F.max("adjustment_c").alias("adjustment_c"))
    hits = documents.join(enabled, F.col("indicator") == F.col("pattern"), "left")
    per = hits.groupBy("doc_id").agg(F.coalesce(F.sum("adjustment_c"), F.lit(0)).alias("sum_c"), F.count("pattern").alias("n_rules"))
    return per.select("doc_id", "n_rules", (F.least(F.lit(cap), "sum_c") / 100.0).alias("adjustment"))
