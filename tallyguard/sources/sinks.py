"""Sinks: append, upsert, delete, split export and flattened logs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def flatten(decisions: DataFrame, groups: tuple[str, ...] = ("file", "text", "layout", "forensic")) -> DataFrame:
    """Nested feature structs as columns with their group's name before them; other columns stay."""
    plain = [F.col(c) for c in decisions.columns if c not in groups]
    nested = [F.col(f"{g}.{f.name}").alias(f"{g}_{f.name}") for g in groups if g in decisions.columns for f in decisions.schema[g].dataType.fields]
    return decisions.select(*plain, *nested)


def append(rows: DataFrame, path: str, form: str = "parquet") -> None:
    writer = rows.write.mode("append")
    (writer.option("header", True).csv if form == "csv" else writer.format(form).save)(path)


def upserted(current: DataFrame, changes: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Both tables' rows with the latest of every key; of equal times the change wins."""
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    latest = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(time), F.desc("__new")))
    return both.withColumn("__n", latest).where("__n = 1").drop("__n", "__new")


def deleted(current: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key is not in ``keys``."""
    return current.join(keys, keys.columns, "left_anti")


def replace(rows: DataFrame, path: str) -> None:
    """Write to a sibling folder, then swap by two renames: no reader sees half a table, and no crash loses both.

    The old table is beside the new one, as ``path.old``, until that is in place.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(path + ".next")
    jvm = spark.sparkContext._jvm
    target, fresh, old = (jvm.org.apache.hadoop.fs.Path(path + x) for x in ("", ".next", ".old"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        fs.delete(old, True)
        if not fs.rename(target, old):
            raise OSError(f"could not move {path} away")
    if not fs.rename(fresh, target):
        raise OSError(f"could not move {path}.next to its place; the old table is in {path}.old")
    fs.delete(old, True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, in ``spark.checkpoint.dir``; a local one in local mode alone."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = base or (own.get() if own.isDefined() else None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or 'file://' + tempfile.mkdtemp(prefix='tallyguard-')).rstrip('/')}/tables/{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` written to a shared folder and read back, for frames that a plan needs several times."""
    path = shared_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def export(rows: DataFrame, path: str, key: str = "feedback_id", train: int = 80) -> None:
    """JSON by split: a hash of the key puts ``train`` per cent into training."""
    split = F.when(F.pmod(F.xxhash64(key), F.lit(100)) < train, "train").otherwise("validation")
    rows.withColumn("split", split).write.mode("overwrite").partitionBy("split").json(path)


def compact(spark: SparkSession, path: str, files: int) -> DataFrame:
    """A table's rows in ``files`` even files, for folders of small appends."""
    return spark.read.parquet(path).repartition(files)
