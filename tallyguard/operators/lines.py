"""A document's lines as rows: order of sections, labels and the lines next to them, merchants near the top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

# Words of titles that are no merchant, and of document types.
TITLES = ("invoice", "receipt", "bill", "tax", "date", "phone", "gstin", "total", "cash memo")
RECEIPT_WORDS, INVOICE_WORDS, TAX_INVOICE_WORDS = ("receipt", "cash", "thank you"), ("invoice", "bill to", "due date"), ("tax invoice", "gstin", "cgst")


def lines(documents: DataFrame, key: str = "id", text: str = "full_text") -> DataFrame:
    """``key``, ``line_no`` from 0 and ``line``."""
    return documents.select(key, F.posexplode(X.lines(F.coalesce(F.col(text), F.lit("")))).alias("line_no", "line"))


def structure_order(documents: DataFrame, key: str = "id", text: str = "full_text") -> DataFrame:
    """Where the first total and the first item stand, and whether a total comes before two items or more of a text of five lines."""
    rows = lines(documents, key, text).where(F.trim("line") != "")
    is_total = X.has_any(F.col("line"), X.TOTAL_WORDS) & ~X.has_any(F.col("line"), X.SUBTOTAL_WORDS)
    is_item = F.size(X.item_amounts(F.array("line"))) > 0
    found = rows.groupBy(key).agg(
        F.count("*").alias("n_lines"), F.min(F.when(is_total, F.col("line_no"))).alias("first_total"), F.min(F.when(is_item, F.col("line_no"))).alias("first_item"), F.count_if(is_item).alias("n_items")
    )
    wrong = (F.col("n_lines") >= 5) & (F.col("n_items") >= 2) & (F.col("first_total") < F.col("first_item"))
    return found.withColumn("out_of_order", F.coalesce(wrong, F.lit(False)))


def labelled_values(documents: DataFrame, label: str, key: str = "id", text: str = "full_text") -> DataFrame:
    """The value of a label: what follows its colon or, where nothing does, the next line."""
    order = W.partitionBy(key).orderBy("line_no")
    rows = lines(documents, key, text).withColumn("below", F.lead("line").over(order))
    hit = rows.where(F.lower("line").startswith(label.lower()))
    own = F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))
    return hit.select(key, "line_no", F.when(own != "", own).otherwise(F.trim("below")).alias("value"), (own == "").alias("from_below"))


def merchant_guess(documents: DataFrame, key: str = "id", text: str = "full_text", zone: int = 10) -> DataFrame:
    """The best line of the first ``zone``: letters, position and company words speak for it, digits and titles against; with its lead over the second."""
    rows = lines(documents, key, text).where((F.col("line_no") < zone) & (F.trim("line") != ""))
    letters, digits = X.count_of(F.col("line"), r"\p{L}"), X.count_of(F.col("line"), "0-9")
    company = F.lower("line").rlike(r"\b(ltd|llc|inc|gmbh|store|stores|motors|market|supplier)\b|supplier#")
    score = F.when(letters >= 3, 4).otherwise(0) + (zone - F.col("line_no")) + F.when(company, 6).otherwise(0) - F.when(digits > letters, 5).otherwise(0) - F.when(X.has_any(F.col("line"), TITLES), 8).otherwise(0)
    scored = rows.withColumn("score", score.cast("int"))
    order = W.partitionBy(key).orderBy(F.desc("score"), "line_no")
    ranked = scored.withColumns({"n": F.row_number().over(order), "second": F.lead("score").over(order)}).where("n = 1")
    return ranked.select(key, F.trim("line").alias("merchant"), "score", (F.col("score") - F.coalesce("second", F.lit(0))).alias("margin"))


def document_type(text: Column) -> Column:
    """Tax invoice, invoice, receipt, or ambiguous where words of several speak."""
    receipt, invoice, tax = (X.has_any(text, w) for w in (RECEIPT_WORDS, INVOICE_WORDS, TAX_INVOICE_WORDS))
    return F.when(tax & ~receipt, "tax_invoice").when(invoice & receipt, "ambiguous").when(invoice, "invoice").when(receipt, "receipt").otherwise("unknown")
