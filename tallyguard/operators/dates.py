"""Dates of whole documents, and the conflict between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D


def scanned(documents: DataFrame, text: str = "full_text") -> DataFrame:
    """``documents`` with ``first_date``, ``all_dates`` (an array), ``date_span`` and ``first_time``, in one pass.

    A null or empty text has no date, no time and an empty array. Columns of these names are replaced. The result is
    a generated row, so no filter on it takes the text apart a second time.
    """
    body = F.coalesce(F.col(text), F.lit(""))

    def listed(found: Column) -> Column:
        return D.once(D.every(found), lambda dates: F.struct(D.first(found).alias("first_date"), dates.alias("all_dates"), D.span(dates).alias("date_span"), D.time(body).alias("first_time")))

    kept = documents.drop("first_date", "all_dates", "date_span", "first_time")
    return kept.select("*", F.inline(F.array(D.once(D.found(body), listed))))


def conflicts(dated: DataFrame, subtype: str = "doc_subtype") -> DataFrame:
    """``R_DATE_CONFLICT`` of rows of ``scanned`` whose dates lie too far apart: id, days, severity and hundredths."""
    pos = F.upper(F.coalesce(F.col(subtype), F.lit(""))).startswith("POS_")
    far = dated.where(F.col("date_span") > D.CONFLICT_DAYS)
    weight = F.when(pos, D.POS_HUNDREDTHS).otherwise(D.OTHER_HUNDREDTHS)
    return far.select("id", F.lit("R_DATE_CONFLICT").alias("rule_id"), F.size("all_dates").alias("n_dates"), "date_span", F.lit("CRITICAL").alias("severity"), weight.alias("hundredths"))
