"""N-gram Jaccard join by MinHash banding.

1. One pass over the texts gives each document's set of word n-grams (64-bit
   hashes), a digest of the set, and the band hashes of its MinHash signature.
   Rows and bands follow from the threshold and the target recall.
2. Documents of equal sets fold into one representative with a count, so
   groups of copies never meet in a task.
3. The band hashes are shuffled: every bucket of two or more names a star of
   candidate links to its least member, and connected stars are the candidate
   groups. Pairs are not written out anywhere.
4. The candidates' texts alone are fetched (a bit map keeps most others out of
   the shuffle), and the full n-gram sets of all
   pairs of a unit are compared as a matrix product. A unit is a candidate group
   or, where that is less work, each bucket of the group by itself: a large
   group that few links chain together has far more pairs than its buckets. A
   pair that shares several buckets counts in the first band of them only.
   Units too large for a task are split by set size (a pair's sizes differ by
   the threshold's factor at most, so only neighbouring sizes meet) and then by
   hash, and each pair of blocks is a task.
5. A task returns one row for each member: how many documents it is linked to
   and the least member of its linked part. Components over these give classes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, marks, own
from .components import components

N_WORDS, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.9999, 6
#: Documents and n-grams of one block of a unit of comparison.
BLOCK_DOCS, BLOCK_GRAMS = 128, 2_000_000

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SYMBOLS = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=_U64) * _U64(2) + _U64(1)
_powers = [np.ones(1, _U64), np.ones(1, _U64)]


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """Bands of ``rows`` rows by which a pair at the threshold meets with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def _grown(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, ``n`` of each at least."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 4096)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, _U64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def grams(text: str | None, n_words: int = N_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams.

    A text of fewer words than ``n_words`` is one n-gram, one without words
    has none.
    """
    words = (text or "").encode("utf-8", "replace").split()
    if not words:
        return np.empty(0, _U64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    power, inverse = _grown(len(data) + 1)
    total = np.zeros(len(data) + 1, _U64)
    np.cumsum(_SYMBOLS[data] * power[: len(data)], out=total[1:])
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(n_words, len(words))
    s, e = starts[: len(words) - k + 1], ends[k - 1 :]
    h = (total[e] - total[s]) * inverse[s]
    h ^= h >> _U64(29)
    h *= _U64(0xBF58476D1CE4E5B9)
    h ^= h >> _U64(32)
    return np.unique(h)


class Signer:
    """Band hashes of a set's MinHash signature."""

    def __init__(self, rows: int, bands: int, seed: int = 11):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.rows, self.bands = rows, bands
        self.mul = rng.integers(0, 1 << 31, rows * bands, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
        self.add = rng.integers(0, 1 << 32, rows * bands, dtype=np.uint32)[:, None]
        self.mix = rng.integers(0, 1 << 63, rows, dtype=_U64) * _U64(2) + _U64(1)
        self.salt = rng.integers(0, 1 << 63, bands, dtype=_U64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        low = (hashes >> _U64(32)).astype(np.uint32)
        least = np.full(self.rows * self.bands, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), 512):
            np.minimum(least, (self.mul * low[None, at : at + 512] + self.add).min(1), out=least)
        band = (least.reshape(self.bands, self.rows).astype(_U64) * self.mix).sum(1, dtype=_U64) + self.salt
        band ^= band >> _U64(31)
        band *= _U64(0x94D049BB133111EB)
        band ^= band >> _U64(30)
        return band.view(np.int64)


def _sketches(docs: DataFrame, n_words: int, rows: int, bands: int) -> DataFrame:
    """doc_id, th (hash of the text), dig (digest of the set), n (its size), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(rows, bands)
        for batch in batches:
            digests, sizes, found = [], [], []
            for value in batch.column(2):
                hashes = grams(value.as_py(), n_words)
                digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).hexdigest())
                sizes.append(len(hashes))
                found.append(signer(hashes) if len(hashes) else np.empty(0, np.int64))
            offsets = np.cumsum([0, *map(len, found)])
            flat = pa.array(np.concatenate(found) if found else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)],
                names=["doc_id", "th", "dig", "n", "bands"],
            )

    return docs.mapInArrow(run, "doc_id long, th long, dig string, n long, bands array<long>")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b``."""
    out = np.zeros((len(a), len(b)), np.float32)
    same = a is b
    sets = a if same else [*a, *b]
    values = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    values, who = values[order], who[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    who, column = who[keep], (np.cumsum(shared) - 1)[column[keep]]
    step = max(256, min(8192, (1 << 24) // (4 * len(sets))))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        lo, hi = np.searchsorted(column, (at, at + step))
        x = np.zeros((len(sets), step), np.float32)
        x[who[lo:hi], column[lo:hi] - at] = 1
        out += x[: len(a)] @ (x if same else x[len(a) :]).T
    return out


def _links(threshold: float, n_words: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("dig").sort_values("dig", ignore_index=True)
        sets = [grams(t, n_words) for t in pdf["text"]]
        side, sizes, counts = pdf["side"].to_numpy(), np.array([len(s) for s in sets], float), pdf["cnt"].to_numpy()
        m = len(pdf)
        linked = np.zeros((m, m), bool)
        within = (side < 0).all()  # all pairs of one block; else side 0 with side 1
        left, right = (np.arange(m), np.arange(m)) if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        a = [sets[i] for i in left]
        both = overlaps(a, a if within else [sets[i] for i in right]) if len(left) and len(right) else np.zeros((len(left), len(right)))
        union = sizes[left][:, None] + sizes[right][None, :] - both
        linked[np.ix_(left, right)] = both >= threshold * union - 1e-9
        if len(pdf) and (band := int(pdf["band"].iloc[0])) > 0:  # the unit is a bucket: pairs that share one of an earlier band count there
            signed = np.stack(pdf["bands"].to_list())
            for k in range(band):
                linked &= signed[:, k][:, None] != signed[:, k][None, :]
        linked |= linked.T
        np.fill_diagonal(linked, False)
        root = np.arange(m)
        while True:
            near = np.where(linked, root[None, :], m).min(1) if m else root
            new = np.minimum(root, near)
            new = new[new]
            if (new == root).all():
                break
            root = new
        digs = pdf["dig"].to_numpy()
        return pd.DataFrame({"dig": digs, "links": linked @ counts, "root": digs[root]})

    return run


def near_duplicates(
    docs: DataFrame,
    *,
    n_words: int = N_WORDS,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    rows: int = ROWS,
    block_docs: int = BLOCK_DOCS,
    block_grams: int = BLOCK_GRAMS,
) -> DataFrame:
    """One row for each document with its class and its number of links.

    Two documents are linked if the Jaccard similarity of their word n-gram
    sets is ``threshold`` or more. Columns: ``doc_id``; ``th``, xxhash64 of
    the text; ``class_id``, the least doc_id of the documents that links
    connect; ``n_links``, how many other documents it is linked to; ``copy_of``,
    the least doc_id of an equal set; ``first``, whether it is its class's
    least (doc_id, th), the one to keep.

    Null, empty and blank texts have no n-grams and no links: each is a class
    of its own. Texts of fewer words than ``n_words`` are one n-gram. Null
    doc_ids are rows like others, but name a class only if it has no other.
    Repeated rows count as documents of an equal set. Extra columns are
    ignored; an empty table gives no rows.
    """
    with Scratch(docs.sparkSession, "jaccard") as run:
        return _near_duplicates(docs, run, Scratch(docs.sparkSession, "jaccard-out"), n_words, threshold, bands_for(threshold, recall, rows), rows, block_docs, block_grams)


def _near_duplicates(docs: DataFrame, run: Scratch, out: Scratch, n_words: int, threshold: float, bands: int, rows: int, block_docs: int, block_grams: int) -> DataFrame:
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("th"), docs["text"].cast("string").alias("text"))
    sketches = run(_sketches(texts, n_words, rows, bands), "sketches")
    seen = out(sketches.select("doc_id", "th", F.when(F.col("n") > 0, F.col("dig")).alias("dig")), "seen")
    short = F.xxhash64("dig").alias("sid")  # of candidates only: what it mistakes for another is compared in vain
    sets = run(
        sketches.where("n > 0").groupBy("dig").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.min("doc_id").alias("copy_of"), F.count("*").alias("cnt"), F.first("n").alias("n"), F.first("bands").alias("bands")).withColumn("sid", short),
        "sets",
    )

    zero = F.lit(0)
    in_bands = sets.select("sid", F.explode("bands").alias("bucket"))
    stars = in_bands.groupBy("bucket").agg(F.min("sid").alias("b"), F.count("*").alias("c")).where("c > 1")
    stars = run(stars, "stars")
    links = run(in_bands.join(stars.select("bucket", "b"), "bucket").select(F.col("sid").alias("a"), "b").distinct(), "candidates")
    groups = components(links, run, "groups")

    # Pairs of a group as a whole, and pairs of its buckets.
    joined = groups.select(F.col("node").alias("sid"), F.col("root").cast("string").alias("grp"))
    of_buckets = stars.join(joined.withColumnRenamed("sid", "b"), "b").groupBy("grp").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("chained"))
    of_groups = joined.groupBy("grp").agg(F.count("*").cast("double").alias("m")).join(of_buckets, "grp")
    by_bucket = run(of_groups.select("grp", ((F.col("m") > block_docs) & (F.col("chained") < F.col("m") * F.col("m"))).alias("by_bucket")), "units")
    members = run(joined.join(by_bucket, "grp").join(sets.select("sid", "dig", "rep", "cnt", "n", "bands"), "sid"), "members")
    whole = members.where("NOT by_bucket").select(F.col("grp").alias("unit"), F.lit(-1).alias("band"), "dig", "rep", "cnt", "n", F.lit(None).cast("array<long>").alias("bands"))
    apart = members.where("by_bucket").select("dig", "rep", "cnt", "n", "bands", F.posexplode("bands").alias("band", "bucket"))
    apart = apart.join(stars.select("bucket"), "bucket").select(F.concat(F.lit("b"), F.col("bucket").cast("string")).alias("unit"), "band", "dig", "rep", "cnt", "n", "bands")
    members = run(whole.unionByName(apart), "unit-members")

    parts = F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n") / block_grams)).cast("int")
    sizes = run(members.groupBy("unit").agg((parts > 1).alias("large")), "unit-sizes")  # a table, so that a large unit's rows can be split
    members = members.join(sizes, "unit")
    members = members.withColumn("lb", F.when(F.col("large"), F.floor(F.log("n") / math.log(1 / threshold)).cast("int")).otherwise(0))
    cells = members.where("large").groupBy("unit", "lb").agg(parts.alias("k"))
    members = run(members, "sized-members")
    cells = run(cells, "cells")
    for name, by in (("k", 0), ("k_up", 1), ("k_down", -1)):
        at = cells.select("unit", (F.col("lb") - by).alias("lb"), F.col("k").alias(name))
        members = members.join(at, ["unit", "lb"], "left")
    sub = F.pmod(F.xxhash64("dig"), F.col("k")).cast("int")
    lb = F.col("lb")

    def task(other, low, low_sub, high, high_sub, side):
        return F.transform(F.sequence(F.lit(0), other - 1), lambda j: F.struct(F.concat_ws("/", "unit", low, low_sub(j), high, high_sub(j)).alias("task"), side(j).alias("side")))

    none = F.array().cast("array<struct<task:string,side:int>>")
    tasks = F.when(~F.col("large"), F.array(F.struct(F.col("unit").alias("task"), F.lit(-1).alias("side")))).otherwise(
        F.concat(
            task(F.col("k"), lb, lambda j: F.least(sub, j), lb, lambda j: F.greatest(sub, j), lambda j: F.when(sub > j, 1).when(sub < j, 0).otherwise(-1)),
            F.coalesce(task(F.col("k_up"), lb, lambda j: sub, lb + 1, lambda j: j, lambda j: zero), none),
            F.coalesce(task(F.col("k_down"), lb - 1, lambda j: j, lb, lambda j: sub, lambda j: F.lit(1)), none),
        )
    )
    wanted = members.select("dig", "cnt", "band", "bands", tasks.alias("tasks"))
    of_sets = F.struct(F.col("rep.doc_id").alias("doc_id"), F.col("rep.th").alias("th"))
    named_rows = run(members.select("dig", of_sets.alias("key")).distinct(), "fetched-keys")
    likely = texts.where(marks(named_rows.select("key.th"))(F.col("th")))
    fetched = likely.select(F.struct("doc_id", "th").alias("key"), "text").join(named_rows.hint("merge"), "key")  # alike at every size: both sides grow
    fetched = run(fetched.groupBy("dig").agg(F.first("text").alias("text")), "texts")  # repeated rows fold before they are shuffled
    blocks = fetched.join(wanted.withColumn("t", F.explode("tasks")), "dig").select("dig", "cnt", "text", "band", "bands", "t.task", "t.side")
    found = run(blocks.groupBy("task").applyInPandas(_links(threshold, n_words), "dig string, links long, root string"), "links")

    roots = components(found.where("links > 0").select(F.col("dig").alias("a"), F.col("root").alias("b")), run, "classes")
    links = found.groupBy("dig").agg(F.sum("links").alias("links"))
    named = (
        sets.select("dig", "rep", "copy_of", "cnt")
        .join(links, "dig", "left")
        .join(roots.withColumnRenamed("node", "dig"), "dig", "left")
        .select("dig", "rep", "copy_of", (F.coalesce("links", zero) + F.col("cnt") - 1).alias("n_links"), F.coalesce("root", "dig").alias("root"))
    )
    named = run(named, "named")
    classes = run(named.groupBy("root").agg(F.min("copy_of").alias("class_id"), F.min("rep").alias("least")), "least")
    named = out(named.join(classes, "root").drop("root", "rep"), "named")
    alone = F.col("least").isNull()
    return seen.select("doc_id", "th", "dig").join(named, "dig", "left").select(
        "doc_id",
        "th",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", zero).cast("long").alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        (alone | (F.struct("doc_id", "th") == F.col("least"))).alias("first"),
    )


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class of near-duplicates, all columns.

    The least (doc_id, text hash) of a class stays, once, of rows that repeat
    any one; documents without words (null, empty, blank) stay all, with all
    their repeats. Null doc_ids are ids like others. Extra columns, whatever
    their names, stay as they are; an empty table stays empty; texts of any
    length are compared whole.
    """
    found = near_duplicates(docs, **options)
    columns = [own(docs, c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    key = F.struct(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("th"))
    rows = docs.select(key.alias("key"), F.coalesce(docs["text"].cast("string").rlike(WORD), F.lit(False)).alias("worded"), *columns)
    rows = rows.withColumn("many", marks(found.where("n_links > 0").select("th"))(F.col("key.th")) & F.col("worded"))  # all that have a link or a copy
    names = [f"c{i}" for i in range(len(columns))]
    linked = found.where("n_links > 0").select(F.struct("doc_id", "th").alias("key"), F.col("first").cast("int").alias("first"))
    linked = linked.groupBy("key").agg(F.max("first").alias("first"))
    many = rows.where("many").join(linked.hint("merge"), "key", "left").where("first IS NULL OR first = 1")
    single = many.where("first IS NULL").select(*names)  # passed the bit map by chance
    once = many.where("first = 1").groupBy("key").agg(F.first(F.struct(*names)).alias("row")).select("row.*")
    return rows.where("NOT many").select(*names).union(single).union(once).toDF(*docs.columns)
