"""Unified signals: one status and confidence for each registered name and document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GATE = 0.55
# Subtypes that call for an amount and a date.
TRANSACTIONAL = ("POS_RETAIL", "POS_RESTAURANT", "TAX_INVOICE", "COMMERCIAL_INVOICE", "FUEL")
# Producers that make or edit receipts.
PRODUCERS = (
    "canva", "photoshop", "adobe photoshop", "wps", "fotor", "ilovepdf", "sejda", "smallpdf", "pdfescape", "dochub", "foxit",
    "tcpdf", "fpdf", "dompdf", "wkhtmltopdf", "conta.com", "invoice generator", "receipt maker", "fake receipt", "invoice maker",
)


@dataclass(frozen=True)
class SignalSpec:
    name: str
    trigger: Column
    confidence: Column
    gated: bool = False


def registry(as_of: str) -> list[SignalSpec]:
    c, today = F.col, F.lit(as_of).cast("date")
    transactional, gap = c("doc_subtype").isin(*TRANSACTIONAL), F.datediff("creation_date", "receipt_date")
    strong = c("address_class")
    made = F.lower("producer").rlike("|".join(x.replace(".", r"\.") for x in PRODUCERS))
    num = lambda hit, yes, no: F.when(hit, yes).otherwise(no)
    return [
        SignalSpec("addr.structure", strong.isin("PLAUSIBLE_ADDRESS", "STRONG_ADDRESS"), F.when(strong == "STRONG_ADDRESS", 0.9).when(strong == "PLAUSIBLE_ADDRESS", 0.6).when(strong == "WEAK_ADDRESS", 0.3).otherwise(0.0)),
        SignalSpec("amount.total_mismatch", F.abs(c("total") - c("items_sum")) > 1.0, F.lit(0.8), True),
        SignalSpec("amount.missing", c("total").isNull() & transactional, num(c("total").isNull() & transactional, 0.7, 0.9), True),
        SignalSpec("template.pdf_producer_suspicious", made, num(made, 0.6, 0.8)),
        SignalSpec("merchant.extraction_weak", c("merchant").isNull(), F.lit(0.9), True),
        SignalSpec("date.missing", c("receipt_date").isNull() & transactional, F.lit(0.7), True),
        SignalSpec("date.future", F.datediff("receipt_date", today) > 1, F.lit(0.8), True),
        SignalSpec("date.gap_suspicious", (gap < 0) | (gap > 365), num(gap < 0, 0.9, 0.7), True),
        SignalSpec("ocr.confidence_low", c("ocr_conf") < 0.7, F.when(c("ocr_conf") < 0.7, 1.0 - c("ocr_conf")).otherwise(c("ocr_conf"))),
        SignalSpec("ocr.text_sparse", c("num_lines") < 10, F.lit(0.8), True),
    ]


def emit(records: DataFrame, specs: list[SignalSpec], profile: str = "profile_conf") -> DataFrame:
    """A row for each record and signal: TRIGGERED, NOT_TRIGGERED, UNKNOWN (its inputs are null) or GATED (the profile is too unsure)."""

    def one(s: SignalSpec) -> Column:
        gated = (F.col(profile) < GATE) if s.gated else F.lit(False)
        status = F.when(gated, "GATED").when(s.trigger.isNull(), "UNKNOWN").when(s.trigger, "TRIGGERED").otherwise("NOT_TRIGGERED")
        return F.struct(F.lit(s.name).alias("signal"), status.alias("status"), F.when(gated, 0.0).otherwise(F.coalesce(s.confidence, F.lit(0.0))).alias("confidence"))

    return records.select("id", F.explode(F.array(*(one(s) for s in specs))).alias("s")).select("id", "s.*")


def contract(labelled: DataFrame, events: DataFrame) -> DataFrame:
    """The export for training: label, score, and the ids of the rules that fired, each once, in order."""
    fired = events.select("id", F.array_join(F.array_distinct(F.transform("events", lambda e: e["rule_id"])), ",").alias("signals_emitted"), F.size("events").cast("long").alias("n_events"))
    f = fired.withColumnRenamed("id", "f_id")
    return labelled.join(f, labelled["id"] == f["f_id"]).select("id", "label", "score", "signals_emitted", "n_events")
