"""Counters of address results: what was found, how often it was held back, and what comes together.

A document raises a set of named counters by one; counters of parts of the data add up, so batches, partitions and
streams give the same table. Shares are per cent of all documents, taken at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from . import consistency as K
from . import profiles as Q

# Limits of scores and confidences, kinds of invoice, the length of a text that may be an address, and the form of a PO box.
STRONG, PLAUSIBLE, WEAK = 6, 4, 1
HIGH, MEDIUM = 0.8, 0.5
SURE_DOCUMENT, SURE_MERCHANT = 0.55, 0.6
INVOICES = ("INVOICE", "TAX_INVOICE", "VAT_INVOICE")
SHORT = 10
PO_BOX = r"(?i)\b(p\.?\s*o\.?\s*box)\b"
ALL = "documents"


def address_results(documents: DataFrame) -> DataFrame:
    """What the address operators say of ``documents`` (id, merchant, address, merchant_conf, profile_conf, doc_subtype).

    A null address is an empty one. One row per document.
    """
    text = F.coalesce("address", F.lit(""))
    score = X.address_score(text)
    kind = F.when(F.length(text) < SHORT, "UNKNOWN").when(text.rlike(PO_BOX), "PO_BOX").otherwise("STANDARD")
    rows = documents.withColumns({"address_score": score, "address_class": X.address_class(score), "address_type": kind})
    status, fit = K.merchant_fit()
    own = rows.select("id", "address", "address_score", "address_class", "address_type", "merchant_conf", "profile_conf", "doc_subtype", status.alias("consistency"), fit.alias("consistency_score"))
    counted = Q.multi_address(own, "id", "address", keep=[c for c in own.columns if c != "address"])
    return counted.withColumnRenamed("status", "multi_status")


def raised(results: DataFrame) -> DataFrame:
    """A row for each counter that a document raises: ``counter``."""
    score, n, fit = F.col("address_score"), F.col("n_addresses"), F.col("consistency_score")
    multi, status = F.coalesce("multi_status", F.lit("UNKNOWN")), F.coalesce("consistency", F.lit("UNKNOWN"))
    unsure = F.coalesce(F.col("profile_conf"), F.lit(0.0)) < SURE_DOCUMENT
    unnamed = F.coalesce(F.col("merchant_conf"), F.lit(0.0)) < SURE_MERCHANT
    several, off, invoice = multi == "MULTIPLE", status.isin("WEAK_MISMATCH", "MISMATCH"), F.coalesce(F.col("doc_subtype").isin(*INVOICES), F.lit(False))

    def name(prefix: str, value: Column) -> Column:
        return F.concat(F.lit(prefix), value)

    names = F.array_compact(F.array(
        F.lit(ALL),
        name("address_classification.", F.coalesce("address_class", F.lit("UNKNOWN"))), name("address_type.", F.coalesce("address_type", F.lit("UNKNOWN"))),
        name("address_score.", F.when(score >= STRONG, "strong").when(score >= PLAUSIBLE, "plausible").when(score >= WEAK, "weak").otherwise("none")),
        F.when(F.col("address_class").isin("PLAUSIBLE_ADDRESS", "STRONG_ADDRESS"), "address_quality.high"), F.when(F.col("address_type") == "PO_BOX", "address_special.po_box"),
        name("multi_address.status.", multi), name("multi_address.count.", F.when(n >= 3, "three_plus").when(n == 2, "two").when(n == 1, "single").otherwise("zero")),
        F.when((multi == "UNKNOWN") & unsure, "multi_address.gated.low_doc_confidence"), F.when(several, "multi_address.detected"),
        name("consistency.status.", status), name("consistency.score.", F.when(fit >= HIGH, "high").when(fit >= MEDIUM, "medium").when(fit > 0, "low").otherwise("zero")),
        F.when((status == "UNKNOWN") & unsure, "consistency.gated.low_doc_confidence").when((status == "UNKNOWN") & unnamed, "consistency.gated.low_merchant_confidence"),
        F.when(off, "consistency.mismatch_detected"),
        F.when(several & off, "overlap.multi_and_mismatch"), F.when(several & invoice, "overlap.multi_and_invoice"), F.when(off & invoice, "overlap.mismatch_and_invoice"),
        F.when(several & off & invoice, "overlap.multi_and_mismatch_and_invoice"),
    ))
    # the outer form, as the inner one asks for the array's size first and so makes it twice; no document is without a counter
    return results.select(F.explode_outer(names).alias("counter"))


def counters(results: DataFrame) -> DataFrame:
    """``counter``, ``n``: of a batch, or running ones of a stream in complete mode."""
    return raised(results).groupBy("counter").agg(F.count("*").alias("n"))


def merged(*parts: DataFrame) -> DataFrame:
    """Counters of several parts as one table."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("counter").agg(F.sum("n").alias("n"))


def shares(counted: DataFrame) -> DataFrame:
    """Counters with ``pct``, per cent of all documents; a counter's table has a few dozen rows, whatever it counts."""
    total = F.max(F.when(F.col("counter") == ALL, F.col("n"))).over(W.partitionBy(F.lit(0)))
    return counted.select("counter", "n", F.round(100.0 * F.col("n") / total, 2).alias("pct"))
