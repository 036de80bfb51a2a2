"""Dashboard queries over claims, risks, signals and duplicate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_duplicates(matches: DataFrame) -> DataFrame:
    """The distinct claims of either side of a pair."""
    return matches.select(F.col("claim_id_1").alias("dup_id")).union(matches.select("claim_id_2")).distinct()


def overview(claims: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: totals by triage, suspicious claims, mean risk, claims in duplicates."""
    counts = claims.agg(
        F.count("*").alias("total_claims"),
        *(F.count_if(F.col("triage_class") == t).alias(t.lower()) for t in ("AUTO_APPROVE", "REVIEW", "INVESTIGATE")),
        F.count_if("is_suspicious").alias("suspicious"),
        F.coalesce(F.sum(F.round(F.col("risk_score") * 10).cast("long")) / F.count("*") / 10.0, F.lit(0.0)).alias("avg_risk"),
    )
    return counts.crossJoin(in_duplicates(matches).agg(F.count("*").alias("claims_with_duplicates")))  # one row each


def by_group(claims: DataFrame, key: Column, name: str, limit: int | None = None) -> DataFrame:
    """Count, mean and sum of amounts, mean risk and suspicious claims of every group, largest first."""
    n = F.count("*")
    out = claims.groupBy(key.alias(name)).agg(
        n.alias("n_claims"), (F.sum("total_c") / n / 100.0).alias("avg_amount"), F.sum("total_c").alias("sum_c"),
        (F.sum(F.round(F.col("risk_score") * 10).cast("long")) / n / 10.0).alias("avg_risk"), F.count_if("is_suspicious").alias("suspicious"),
    )
    ordered = out.orderBy(F.desc("n_claims"), F.asc_nulls_first(name))
    return ordered.limit(limit) if limit else ordered


def monthly_trend(claims: DataFrame) -> DataFrame:
    month = F.substring("claim_date", 1, 7)
    rows = claims.where(F.length("claim_date") >= 7).groupBy(month.alias("month"))
    return rows.agg(F.count("*").alias("n_claims"), F.count_if("is_suspicious").alias("suspicious"), F.sum("total_c").alias("sum_c"))


def drilldown(claims: DataFrame, matches: DataFrame, *, filters: dict | None = None, suspicious: bool | None = None, duplicates_only: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of the claims that fit all filters, newest first, with how many fit."""
    rows = claims
    for column, value in (filters or {}).items():
        rows = rows.where(F.col(column) == value)
    if suspicious is not None:
        rows = rows.where(F.col("is_suspicious") == suspicious)
    if duplicates_only:
        rows = rows.join(in_duplicates(matches), rows["id"] == F.col("dup_id"), "left_semi")
    fit = rows.agg(F.count("*").alias("n_fit"))
    page = rows.orderBy(F.desc("claim_date"), F.desc("id")).offset(offset).limit(limit)
    return page.select("id", "dealer_id", "brand", "issue", "claim_date", "total_c", "risk_score", "triage_class").crossJoin(fit)  # fit: one row


def signal_frequency(signal_json: DataFrame) -> DataFrame:
    """How often each signal and severity is in ``signals``, a column of JSON arrays.

    Text that is no array counts for nothing; a missing type is UNKNOWN, a
    missing severity LOW.
    """
    parsed = F.from_json("signals", "array<struct<signal_type:string,severity:string>>")
    one = signal_json.select(F.explode(F.coalesce(parsed, F.array().cast("array<struct<signal_type:string,severity:string>>"))).alias("s"))
    named = one.select(F.coalesce("s.signal_type", F.lit("UNKNOWN")).alias("signal_type"), F.coalesce("s.severity", F.lit("LOW")).alias("severity"))
    return named.groupBy("signal_type", "severity").agg(F.count("*").alias("n"))


def duplicates_by_type(matches: DataFrame) -> DataFrame:
    n = F.count("*")
    return matches.groupBy("match_type").agg(n.alias("n_pairs"), (F.sum(F.round(F.col("similarity") * 100).cast("long")) / n / 100.0).alias("avg_similarity"))


def most_duplicated(matches: DataFrame, limit: int = 10) -> DataFrame:
    """The claims in most pairs, from both sides."""
    sides = matches.select(F.explode(F.array("claim_id_1", "claim_id_2")).alias("claim_id"))
    return sides.groupBy("claim_id").agg(F.count("*").alias("n_matches")).orderBy(F.desc("n_matches"), "claim_id").limit(limit)


def duplicate_audit(claims: DataFrame, matches: DataFrame) -> DataFrame:
    """For each claim and each other claim that it matches: reasons, the greatest similarity and the other's details."""
    a = matches.select(F.col("claim_id_1").alias("claim_id"), F.col("claim_id_2").alias("other_id"), "match_type", "similarity")
    b = matches.where("claim_id_1 <> claim_id_2").select(F.col("claim_id_2").alias("claim_id"), F.col("claim_id_1").alias("other_id"), "match_type", "similarity")
    grouped = a.union(b).groupBy("claim_id", "other_id").agg(
        F.count("*").alias("n_reasons"), F.max("similarity").alias("max_similarity"), F.array_join(F.sort_array(F.collect_set("match_type")), ",").alias("reason_types")
    )
    details = claims.select(F.col("id").alias("d_id"), "vin", "dealer_id", "issue", "claim_date", "total_c", "status")
    return grouped.join(details, grouped["other_id"] == F.col("d_id"), "left").drop("d_id")
