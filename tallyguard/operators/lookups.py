"""Joins with small tables and with logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Currency, country. Each is a primary one, of weight 1.
CURRENCY_COUNTRIES = (
    ("INR", "IN"), ("USD", "US"),
    ("EUR", "DE"), ("EUR", "FR"), ("EUR", "IT"), ("EUR", "ES"), ("EUR", "NL"), ("EUR", "BE"),
    ("EUR", "AT"), ("EUR", "PT"), ("EUR", "IE"), ("EUR", "FI"), ("EUR", "GR"),
    ("GBP", "UK"), ("CAD", "CA"), ("AUD", "AU"), ("SGD", "SG"), ("AED", "AE"),
    ("KES", "KE"), ("NGN", "NG"), ("ZAR", "ZA"), ("TZS", "TZ"), ("UGX", "UG"),
    ("JPY", "JP"), ("KRW", "KR"), ("CNY", "CN"),
    ("BRL", "BR"), ("MXN", "MX"), ("SAR", "SA"),
)


def currency_countries(spark: SparkSession, more=()) -> DataFrame:
    """The currency map; ``more`` adds rows (currency, country, is_primary, weight)."""
    rows = [(c, k, True, 1.0) for c, k in CURRENCY_COUNTRIES] + list(more)
    return spark.createDataFrame(rows, "currency string, country_code string, is_primary boolean, weight double")


def countries_of(rows: DataFrame, countries: DataFrame) -> DataFrame:
    """``rows`` with the countries of their currency: primary ones first, then by weight, then by code.

    A currency that is null or unknown has no countries, and its row stays.
    """
    order = F.array_sort(F.collect_list(F.struct((~F.col("is_primary")).alias("p"), (-F.col("weight")).alias("w"), "country_code")))
    ranked = countries.groupBy("currency").agg(F.transform(order, lambda x: x["country_code"]).alias("countries"))
    return rows.join(ranked, "currency", "left")


def users_with_roles(users: DataFrame, roles: DataFrame) -> DataFrame:
    """Users with the name and permissions of their role; a user without one stays."""
    named = roles.select(F.col("id").alias("role_id"), F.col("name").alias("role_name"), F.col("permissions").alias("role_permissions"))
    return users.join(named, "role_id", "left")


def feedback_with_decisions(feedback: DataFrame, decisions: DataFrame) -> DataFrame:
    """Feedback joined to decisions on the analysed path; names that clash get a suffix."""
    clash = set(feedback.columns) & set(decisions.columns)
    left = feedback.select(*(F.col(c).alias(f"{c}_feedback" if c in clash else c) for c in feedback.columns))
    right = decisions.select(*(F.col(c).alias(f"{c}_analysis" if c in clash else c) for c in decisions.columns))
    return left.join(right, left["analysis_ref"] == right["file_path"])


def first_decision(analyses: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each analysis with the label and score of the first logged decision on its path.

    A decision without a score counts as 0; an analysis without a decision has neither.

    The log is reduced to one row for each path before it is joined, so a path that is logged often costs no more.
    """
    first = decisions.groupBy("file_path").agg(F.min_by(F.struct("label", "score"), "position").alias("d"))
    first = first.select(F.col("file_path").alias("analysis_id"), F.col("d.label").alias("engine_label"), F.coalesce("d.score", F.lit(0.0)).alias("engine_score"))
    return analyses.join(first, "analysis_id", "left")


def feedback_summary(claims: DataFrame, matches: DataFrame, feedback: DataFrame) -> DataFrame:
    """Counts (measure, value, n): claims, claims with a duplicate, feedback by verdict."""
    total = claims.agg(F.lit("claims").alias("measure"), F.lit(None).cast("string").alias("value"), F.count("*").alias("n"))
    doubled = matches.agg(F.lit("claims_with_duplicates").alias("measure"), F.lit(None).cast("string").alias("value"), F.countDistinct("claim_id_1").alias("n"))
    verdicts = feedback.groupBy(F.col("verdict").alias("value")).agg(F.count("*").alias("n")).select(F.lit("feedback").alias("measure"), "value", "n")
    return total.unionByName(doubled).unionByName(verdicts)
