"""Connected components of an edge list, in DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, written: Scratch, name: str = "components") -> DataFrame:
    """``node`` and ``root`` (the component's least node) of every node of ``edges`` (a, b).

    Each round maps a node to the least of itself and its neighbours and
    contracts the edges along that map. Stars vanish in one round; a path
    shrinks by a factor where its ids are in no order along it, as digests are,
    but by one node a round where they ascend: give hashed ids. Nothing is
    collected but a count; each round's tables go to ``written``. Self loops give lone nodes; nulls are
    dropped; an empty list gives no rows.
    """
    pairs = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    left = written(pairs.where("a <> b").distinct(), f"{name}-edges")
    mapped = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    mapped = written(mapped.select("node", F.col("node").alias("root")), f"{name}-map")
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b"))
        least = written(least.select(F.col("a").alias("at"), F.least("a", "b").alias("to")), f"{name}-least")
        mapped = written(
            mapped.join(least, mapped["root"] == least["at"], "left").select("node", F.coalesce("to", "root").alias("root")),
            f"{name}-map",
        )
        first = left.join(least, left["a"] == least["at"]).select(F.col("to").alias("a"), "b")
        moved = first.join(least, first["b"] == least["at"]).select("a", F.col("to").alias("b"))
        left = written(
            moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
            f"{name}-edges",
        )
    return mapped
