"""Mixing sources to target weights, in DataFrame functions alone.

Each document gets a hash-random key. Within its source, documents are taken
in the order of their keys: the key's leading digits name a range, token counts
are summed by range and ranges are prefix-summed. A source's target gives whole
epochs and a rest; every document is taken once for each epoch and, up to the
exact word of the rest, once more. All ranges but the one in which the rest
ends are taken whole or not at all, so only that one is sorted by key and
prefix-summed by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Scratch, own, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Hex digits of the key that name a range: 4096 ranges for each source.
RANGE_DIGITS = 3
#: Sources, of some hundred bytes each, whose budgets may be broadcast.
FEW_SOURCES = 50_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, text: Column, seed: str) -> Column:
    """A hash of the row in hex digits: the same in every run, unrelated to order."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The target of every source: ``source``, ``source_size``, ``target``.

    ``sizes`` has one row for each source: ``source``, ``source_size``. Sources
    by code point, nulls last, take ``weights`` in turn. A target is weight
    times a level, or ``max_epochs`` times the size where that is less; the
    level is such that the targets sum to all sizes. Sorted by the level at
    which they are full, the full sources are a prefix, so the level follows
    from two running sums: what sharing and resharing come to.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.array(*map(F.lit, weights))[turn].cast("long"))
    weighed = weighed.withColumn("full", (F.col("source_size") * max_epochs).cast("long"))
    by_level = W.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    ranked = weighed.withColumns(
        {
            "total": F.sum("source_size").over(W.partitionBy()),
            "filled": F.coalesce(F.sum("full").over(before), F.lit(0)),
            "open": F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    # A source stays under its limit at the level that it and all after it would share.
    fits = F.col("full") * F.col("open") >= (F.col("total") - F.col("filled")) * F.col("weight")
    level = F.min(F.when(fits, F.struct(F.col("full") / F.col("weight"), F.col("source").isNull(), "source", (F.col("total") - F.col("filled")).alias("rest"), "open"))).over(W.partitionBy())
    return (
        ranked.withColumn("at", level)
        .withColumn("shared", F.col("weight") * F.col("at")["rest"] / F.col("at")["open"])
        .select("source", "source_size", F.when(F.col("at").isNull(), F.col("full").cast("double")).otherwise(F.least(F.col("full").cast("double"), "shared")).alias("target"))
    )


def _cuts(rows: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """For each source where its budget ends: ``s``, ``source_size``, ``target``, ``epochs``, ``cut``, ``rest``.

    ``rows`` have ``source``, ``range``, ``size``. In the last epoch the ranges
    before ``cut`` are taken whole and those after it not at all; ``cut`` itself
    has ``rest`` words left. Up to ``FEW_SOURCES`` sources are broadcast.
    """
    run = Scratch(rows.sparkSession, "mix-ranges")
    ranges = run(rows.groupBy("source", "range").agg(F.sum("size").alias("words")), "ranges")
    goals = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    before = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0)))
    starts = starts.join(goals.withColumnRenamed("source", "g"), F.col("source").eqNullSafe(F.col("g")))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    starts = starts.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size") - F.col("base"))
    ends = F.min(F.when(F.col("rest") < F.col("words"), F.struct("range", "rest")))
    found = starts.groupBy("source", "source_size", "target", "epochs").agg(ends.alias("end"))
    out = written(found.select(F.struct("source").alias("s"), "source_size", "target", "epochs", F.col("end.range").alias("cut"), F.greatest(F.col("end.rest"), F.lit(0)).alias("rest")), "mix-cuts")
    run.remove()
    return F.broadcast(out) if out.count() <= FEW_SOURCES else out


def _numbered(groups: DataFrame) -> DataFrame:
    """``n`` rows of each of ``groups``, numbered from 0 by ``nth``."""
    step = 1 << 16
    blocks = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / step))))
    inside = F.sequence(F.lit(0).cast("long"), F.least(F.lit(step), F.col("n") - F.col("block") * step) - 1)
    return blocks.withColumn("inner", F.explode(inside)).withColumn("nth", F.col("block") * step + F.col("inner")).drop("block", "inner", "n")


def mix(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = "mix-1",
    range_digits: int = RANGE_DIGITS,
) -> DataFrame:
    """One row for each document with the words that the mix takes of it.

    Columns: ``doc_id``; ``key``, the random key; ``size``, its words;
    ``source``; ``source_size``; ``target``, in words; ``taken``, the words
    taken, repeats counted: whole epochs of the document and, in the last
    epoch, as many words as the source's budget still has. A source's ``taken``
    sum to its target, cut to a whole word; no document exceeds ``max_epochs``
    times its size.

    Null texts have size 0 and null sources are one source, the last. Sources
    without words have target 0. Repeated rows count as often as they come and
    share a key; their order cannot be told apart, and they are counted before
    any sort. Extra columns are ignored; an empty table gives no rows. A source
    of any share of the rows is dealt over ``16 ** range_digits`` ranges.
    """
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        docs["source"].cast("string").alias("source"),
        n_words(docs["text"]).alias("size"),
        random_key(docs["doc_id"], docs["text"], seed).alias("key"),
    )
    rows = written(rows.withColumn("range", F.substring("key", 1, range_digits)), "mix-sizes")
    placed = rows.withColumn("s", F.struct("source")).join(_cuts(rows, weights, max_epochs), "s")
    at_cut, ends = F.coalesce(F.col("range") == F.col("cut"), F.lit(False)), ["doc_id", "key", "size", "source", "source_size", "target"]
    plain = placed.where(~at_cut).withColumn("taken", F.col("size") * (F.col("epochs") + F.when(F.col("range") < F.col("cut"), 1).otherwise(0)))
    groups = placed.where(at_cut).groupBy(*ends, "s", "epochs", "rest").agg(F.count("*").alias("n"))
    before = W.partitionBy("s").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    cut = _numbered(groups.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("size")).over(before), F.lit(0))))
    left = F.col("rest") - F.col("before") - F.col("nth") * F.col("size")
    cut = cut.withColumn("taken", F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left)))
    return plain.unionByName(cut, allowMissingColumns=True).select(*ends, F.col("taken").cast("long").alias("taken"))


def apply_mix(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = "mix-1",
    range_digits: int = RANGE_DIGITS,
) -> DataFrame:
    """``docs`` as the mix takes them, all columns.

    A document comes once for each whole epoch and, where the budget ends
    within it, once more with its first words only (``n_chars`` counted anew).
    Documents of which nothing is taken go; those without words (null, empty,
    blank) stay once. Null sources are one source; null doc_ids are ids like
    others; repeated rows are taken one after the other. Extra columns,
    whatever their names, come along; an empty table stays empty; texts of any
    length are counted, and cut, whole. A row that isn't in its source's last
    range stays where it is read: nothing but its source's budget is joined to it.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    row = F.struct(*(own(docs, c).alias(n) for n, c in zip(names, docs.columns, strict=True)))
    its = {c: f"row.{n}" for n, c in zip(names, docs.columns, strict=True)}
    key = random_key(docs["doc_id"], docs["text"], seed)
    rows = docs.select(docs["source"].cast("string").alias("source"), n_words(docs["text"]).alias("size"), F.substring(key, 1, range_digits).alias("range"))
    rows = written(rows.groupBy("source", "range").agg(F.sum("size").alias("size")), "mix-sizes")
    named = docs.select(row.alias("row"), key.alias("key"), F.substring(key, 1, range_digits).alias("range"), F.struct(docs["source"].cast("string").alias("source")).alias("s"))
    placed = named.join(_cuts(rows, weights, max_epochs), "s")
    worded, at_cut = F.coalesce(F.col(its["text"]).rlike(WORD), F.lit(False)), F.coalesce(F.col("range") == F.col("cut"), F.lit(False))
    times = F.when(worded, F.col("epochs") + F.when(F.col("range") < F.col("cut"), 1).otherwise(0)).otherwise(1).cast("int")
    plain = placed.where(~at_cut).select(F.explode(F.array_repeat("row", times)).alias("row"))

    groups = placed.where(at_cut).groupBy("row", "key", "s", "epochs", "rest").agg(F.count("*").alias("n")).withColumn("size", n_words(F.col(its["text"])))
    before = W.partitionBy("s").orderBy("key", F.xxhash64("row")).rowsBetween(W.unboundedPreceding, -1)
    cut = _numbered(groups.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("size")).over(before), F.lit(0))))
    left = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("nth") * F.col("size")))
    full = F.col("epochs") + F.when(left == F.col("size"), 1).otherwise(0)
    wholes = F.array_repeat(F.lit(-1).cast("long"), F.when(F.col("size") == 0, 1).otherwise(full).cast("int"))
    pieces = F.when((left > 0) & (left < F.col("size")), F.array(left.cast("long"))).otherwise(F.array().cast("array<long>"))
    cut = cut.select("row", F.explode(F.concat(wholes, pieces)).alias("most"))
    found = F.regexp_extract_all(its["text"], F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), F.lit(0))
    head = F.array_join(F.slice(found, 1, F.greatest(F.col("most"), F.lit(0)).cast("int")), "")
    short = cut.withColumn("head", F.when(F.col("most") >= 0, head))
    changed = {"text": F.coalesce("head", its["text"])}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.coalesce(F.length("head"), its["n_chars"]).cast(docs.schema["n_chars"].dataType)
    short = short.select(F.struct(*(changed.get(c, F.col(its[c])).alias(n) for n, c in zip(names, docs.columns, strict=True))).alias("row"))
    return plain.union(short).select("row.*").toDF(*docs.columns)
