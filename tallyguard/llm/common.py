"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every operator here counts it: no space and none of \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by whatever file system the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    In local mode, where nothing has set it (tests), a temporary folder is made
    once and set as the checkpoint folder of the context; a cluster without
    one is an error, since its executors could not read what others wrote.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyguard-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables that one run writes to the shared folder to cut lineage, in a folder of their own.

    A lost executor then costs a re-read, not a recomputation.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame, name: str, **options: object) -> DataFrame:
        """Write ``df`` as Parquet, with ``options`` of the writer, and read it back."""
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.remove()

    def remove(self) -> None:
        """Delete the run's tables: what still reads them must have been written elsewhere."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a table that outlives the call."""
    return Scratch(df.sparkSession, name)(df, "table")


def own(df: DataFrame, name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return df["`" + name.replace("`", "``") + "`"]


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1 and so on, which every API takes."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def marks(hashes: DataFrame, bits: int = 24) -> Callable[[Column], Column]:
    """A test that is true of every 64-bit hash in the one column of ``hashes`` and of few others, for a filter ahead of a shuffle.

    It is a bit map of ``2 ** bits`` bits, set in a distributed aggregate and
    broadcast: 2 MB at 24, whatever the input. The more hashes, the more others
    pass; none of ``hashes`` is ever missed.
    """
    slot = hashes.select((F.col(hashes.columns[0]).bitwiseAND(F.lit((1 << bits) - 1))).alias("s"))
    words = slot.groupBy(F.shiftright("s", 6).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 AS int)))").alias("bits")).toPandas()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words["w"].to_numpy()] = words["bits"].to_numpy()
    shared = hashes.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def marked(h: pd.Series) -> pd.Series:
        s = h.to_numpy() & ((1 << bits) - 1)
        return pd.Series((shared.value[s >> 6] >> (s & 63)) & 1 == 1)

    return marked


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once for a row.

    Array functions read their argument once for each element of another
    array; a lambda variable keeps that a lookup rather than a recomputation.
    """
    return F.transform(F.array(value), body)[0]
