"""Scans: logs, feedback files, labels, databases, packs and documents' bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of a decision log and of feedback metadata, and the fields of a claim's text.
DECISIONS = "filename string, label string, score double, timestamp_utc string, file_num_pages int, text_total_amount double, text_num_lines int, layout_num_lines int, forensic_uppercase_ratio double"
FEEDBACK = "feedback_id string, image_path string, status string, created_at string, model_version string"
JUDGMENTS = "doc_id string, source_batch string, annotator_judgments array<struct<doc_outcome:string,fraud_types:array<string>,decision_reasons:array<string>,evidence_strength:string>>, _corrupt string"
CLAIM_FIELDS = {
    "claim_id": r"Claim\s*ID[:\s]*([A-Z0-9]{6,})", "brand": r"(?:Brand|Make|Manufacturer)[:\s]*([A-Za-z]+)", "year": r"Year[:\s]*(\d{4})", "vin": r"VIN[:\s]*([A-HJ-NPR-Z0-9]{17})",
    "odometer": r"(?:Odometer|Mileage)[:\s]*([\d,]+)", "issue_description": r"Issue\s*Description[:\s]*([^\n]+)", "claim_date": r"Claim\s*Date[:\s]*(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})",
    "parts_cost": r"Parts?\s*Cost[:\s]*\$?([\d,]+\.?\d*)", "labor_cost": r"Labor\s*Cost[:\s]*\$?([\d,]+\.?\d*)", "tax": r"Tax(?:es)?[:\s]*\$?([\d,\-]+\.?\d*)", "status": r"Claim\s*Status[:\s]*(Pending|Approved|Rejected)",
}
_NUMBERS = {"year": "int", "odometer": "int", "parts_cost": "double", "labor_cost": "double", "tax": "double"}


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """A decision log: CSV with a header, by a fixed schema; a row that doesn't fit has its text in ``_corrupt``."""
    reader = spark.read.schema(DECISIONS + ", _corrupt string").option("header", True).option("mode", "PERMISSIVE")
    return reader.option("columnNameOfCorruptRecord", "_corrupt").csv(path)


def feedback(spark: SparkSession, path: str, status: str = "pending_training", least: int = 100) -> DataFrame:
    """Feedback metadata, one JSON file each, of a status; empty where there are fewer than ``least``."""
    rows = spark.read.schema(FEEDBACK).option("multiLine", True).json(path).where(F.col("status") == status)
    enough = rows.agg((F.count("*") >= least).alias("enough")).where("enough")
    return rows.crossJoin(enough).drop("enough")  # one row or none


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Document labels, a JSON line each; a line that isn't one has its text in ``_corrupt``."""
    return spark.read.schema(JUDGMENTS).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def documents(spark: SparkSession, path: str, pattern: str = "*.{pdf,png,jpg,jpeg}") -> DataFrame:
    """Bytes of documents with path, size and time, for partition-wise ingest."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def database(spark: SparkSession, url: str, table: str, *, column: str | None = None, lower: int = 0, upper: int = 0, partitions: int = 8, **options: str) -> DataFrame:
    """A table behind JDBC, read in ranges of ``column`` if there is one."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column:
        reader = reader.options(partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions))
    return reader.load()


def packs(spark: SparkSession, path: str, parse) -> DataFrame:
    """Packs of whole text files (language or domain packs): ``parse`` turns a text to (id, json)."""
    files = spark.read.text(path, wholetext=True)

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([parse(v) for v in batch["value"]], columns=["id", "body"])

    return files.mapInPandas(run, "id string, body string")


def claim_fields(text: Column) -> dict[str, Column]:
    """The fields of a claim's text, with numbers cast and null for what isn't there."""
    out = {}
    for name, pattern in CLAIM_FIELDS.items():
        found = F.nullif(F.trim(F.regexp_extract(text, "(?im)" + pattern, 1)), F.lit(""))
        out[name] = F.replace(found, F.lit(",")).try_cast(_NUMBERS[name]) if name in _NUMBERS else found
    return out


def annotated_receipts(spark: SparkSession, boxes: str, entities: str) -> DataFrame:
    """Receipts as texts of their boxes' lines, with company, date, address and total where a file of entities has them.

    A line of a box file is eight coordinates and a text, separated by commas,
    or a text without any comma; other lines and empty texts are left out, and
    receipts without a line too. An entity file is one JSON object; one that
    isn't leaves its receipt without entities.
    """
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1).alias("receipt_id")
    files = lambda path: spark.read.text(path, wholetext=True).select(name, "value")
    parts = lambda x: F.split(F.trim(x), ",", 9)
    texts = F.transform(F.split("value", r"\r?\n", -1), lambda x: F.when(F.size(parts(x)) == 9, F.trim(F.get(parts(x), 8))).when(F.size(parts(x)) == 1, F.trim(x)))
    lines = files(boxes).select("receipt_id", F.array_join(F.filter(texts, lambda x: x != ""), "\n").alias("full_text")).where("full_text <> ''")
    found = F.from_json("value", "company string, date string, address string, total string").alias("e")
    total = F.replace(F.regexp_extract("e.total", r"[\d,.]+", 0), F.lit(","), F.lit("")).try_cast("double").alias("total")
    return lines.join(files(entities).select("receipt_id", found).select("receipt_id", "e.company", "e.date", "e.address", total), "receipt_id", "left")
