"""Streams: the duplicate registry with keyed state, and running trends.

State is one representative for each fuzzy key. In a stream that never ends it
expires after a time without arrivals, so it is bounded by the keys of that
time; a run over what is there (availableNow) needs no expiry, and with one
would wait for it forever.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

OUT = "id long, status string, duplicate_of long"
STATE = "of long, exact_fp string"


def duplicates(stream: DataFrame, keep_days: int | None = None) -> DataFrame:
    """``stream`` has ``id``, ``exact_fp``, ``fuzzy_fp``; each row comes out once with what the registry said.

    A key without arrivals for ``keep_days`` is forgotten; None keeps all.
    """

    def register(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Arrivals of one fuzzy key, in order of id, against its representative."""
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("id")
        of, exact = state.get if state.exists else (int(rows["id"].iloc[0]), rows["exact_fp"].iloc[0])
        status = ["new" if i == of else "exact" if fp == exact else "fuzzy" for i, fp in zip(rows["id"], rows["exact_fp"], strict=True)]
        state.update((of, exact))
        if keep_days is not None:
            state.setTimeoutDuration(keep_days * 24 * 3600 * 1000)
        yield pd.DataFrame({"id": rows["id"].to_numpy(), "status": status, "duplicate_of": pd.array([None if s == "new" else of for s in status], "Int64")})

    expiry = GroupStateTimeout.NoTimeout if keep_days is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.groupBy("fuzzy_fp").applyInPandasWithState(register, OUT, STATE, "append", expiry)


def monthly(stream: DataFrame) -> DataFrame:
    """Running counts by calendar month and type: months aren't fixed windows, so they are grouped by their first day."""
    return stream.groupBy(F.trunc("ts", "MM").alias("month"), "event_type").agg(F.count("*").alias("n"), F.sum("value_c").alias("value_c"))


def windowed(stream: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Counts by window and type that are final once the watermark has passed."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))


def rolling(events: DataFrame, days: int = 30) -> DataFrame:
    """Counts over sliding windows of ``days``, a step a day."""
    return events.groupBy(F.window("ts", f"{days} days", "1 day"), "event_type").agg(F.count("*").alias("n"))


def files(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stream over the Parquet files of a folder, or over one file."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000)
    if at.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")  # a stream's path is a folder
    return reader.option("pathGlobFilter", name).parquet(folder)


def drained(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into Parquet, and read what it wrote.

    In complete mode each batch's whole result replaces the one before.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        running = writer.format("parquet").start(out)
    else:
        running = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    running.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
