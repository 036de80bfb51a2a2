"""Embedding near-duplicates by PCA-ordered tiled comparison.

1. Equal vectors of a label fold into one row with a count.
2. Principal directions come from a bounded sample; they only order the work, as
   any rotation keeps cosines. Rows are sorted by label, by cell (leading two
   directions cut at the greatest distance of a linked pair) and by finer
   leading directions, and cut into tiles of bounded size.
3. Tiles of a cell and of the cells around it meet as summaries: middle, angle
   to the farthest member, count. Of two tiles apart by more than the threshold
   allows no pair is linked; of two so close that it allows no gap, all pairs
   are, and their counts are added without a comparison. A large group of near
   copies is mostly of the second kind.
4. Each remaining pair of tiles is a task: leading directions are multiplied
   first, the rest is bounded by the product of the suffix norms, and rows,
   columns and then pairs that cannot reach the threshold stop there.
5. A task gives each row its links and the least member of its linked part;
   components over these are the classes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

THRESHOLD, TILE = 0.93, 1024
#: Rows of the sample that gives the directions; it has no part in what is linked.
SAMPLE_ROWS = 4096
#: What bounds leave for rounding.
SLACK = 1e-7
#: Pairs that are compared one by one at once, and the share of a tile pair from which on they are.
PAIRS, SPARSE = 1 << 16, 0.05

_ROW = "vec_id long, label string, dig string, v array<double>"
_TILED = "dig string, cnt long, label string, d int, c1 int, c2 int, tile string, v array<double>, middle array<double>, angle double, docs long, head string"


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; the greatest component is divided out first, so that no square leaves a double."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _named(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, dig (a digest of label and vector; null for what links with nothing), vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, found = batch.column(1).to_pylist(), []
            for label, v in zip(labels, batch.column(2), strict=True):
                x = v.values.to_numpy(zero_copy_only=False) if v.is_valid and label is not None else np.empty(0)
                good = len(x) and np.isfinite(x).all() and x.any()  # nulls are NaN
                found.append(hashlib.blake2b(f"{len(x)}:{label}:".encode() + (x + 0.0).tobytes(), digest_size=16).hexdigest() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), batch.column(2)], names=["vec_id", "label", "dig", "v"])

    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].cast("string").alias("label"), vectors[vector_col].cast("array<double>").alias("v"))
    return rows.mapInArrow(run, _ROW)


def _directions(sets: DataFrame, sample_rows: int) -> dict[int, np.ndarray]:
    """Principal directions by vector length, from about ``sample_rows`` rows chosen by hash. A length that the sample lacks keeps its own axes."""
    share = max(1, sets.count() // sample_rows)
    sample = sets.where(F.pmod(F.xxhash64("dig"), F.lit(share)) == 0).select("v").collect()
    by: dict[int, list] = {}
    for r in sample:
        by.setdefault(len(r["v"]), []).append(r["v"])
    out = {}
    for d, rows in by.items():
        u = _unit(np.array(rows, float))
        values, axes = np.linalg.eigh(u.T @ u)
        out[d] = np.ascontiguousarray(axes[:, np.argsort(-values)])
    return out


def _placed(sets: DataFrame, axes: dict[int, np.ndarray], width: float) -> DataFrame:
    """Adds d (length), the cell c1, c2 and f, a finer place along the leading directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            c, fine = np.zeros((len(lengths), 2), np.int32), np.zeros(len(lengths), np.int64)
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                y = _unit(_matrix(batch.column(3).take(pa.array(at)), int(d)))
                y = y @ axes[int(d)][:, :8] if int(d) in axes else y[:, :8]
                c[at, : y.shape[1]] = np.floor(y[:, :2] / width)
                for k in range(y.shape[1]):  # signs first, then halves: near vectors get near places
                    fine[at] |= (y[:, k] > 0).astype(np.int64) << (40 - k)
                for k in range(min(4, y.shape[1])):
                    fine[at] |= np.clip((y[:, k] + 1) * 128, 0, 255).astype(np.int64) << (24 - 8 * k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths, pa.int32()), pa.array(c[:, 0], pa.int32()), pa.array(c[:, 1], pa.int32()), pa.array(fine)], names=["dig", "cnt", "label", "v", "d", "c1", "c2", "f"])

    return sets.select("dig", "cnt", "label", "v").mapInArrow(run, "dig string, cnt long, label string, v array<double>, d int, c1 int, c2 int, f long")


def _tiles(placed: DataFrame, tile: int) -> DataFrame:
    """Rows of a sorted partition with the tile that each is in; the first of a tile has its summary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        place = None

        def out() -> pa.RecordBatch:
            nonlocal serial
            serial += 1
            n, (label, d, c1, c2) = len(held), place
            u = _unit(np.array([h[2] for h in held]))
            middle = u.mean(0)
            norm = np.linalg.norm(middle)
            middle = middle / norm if norm > 1e-9 else u[0]
            angle = float(np.arccos(np.clip(u @ middle, -1, 1)).max())
            first = lambda x: [x] + [None] * (n - 1)
            cols = [[h[0] for h in held], [h[1] for h in held], [label] * n, [d] * n, [c1] * n, [c2] * n, [f"{part}-{serial}"] * n, [h[2] for h in held], first(middle.tolist()), first(angle), first(sum(h[1] for h in held)), first(min(h[0] for h in held))]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.string()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _TILED.split(", ")])

        for batch in batches:
            at = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("dig", "cnt", "label", "d", "c1", "c2")}
            for i, v in enumerate(batch.column(batch.schema.get_field_index("v"))):
                now = (at["label"][i], at["d"][i], at["c1"][i], at["c2"][i])
                if held and (now != place or len(held) >= tile):
                    yield out()
                place = now
                held.append((at["dig"][i], at["cnt"][i], v.values.to_numpy(zero_copy_only=False)))
        if held:
            yield out()

    order = ["label", "d", "c1", "c2", "f", "dig"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _TILED)


def _tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """Pairs of tiles (a <= b) that can hold a link, and whether all their pairs are links."""
    side = tiles.where("middle IS NOT NULL").select("label", "d", "c1", "c2", "tile", "middle", "angle", "docs", "head")
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    left = side.select("label", "d", "c1", "c2", *(F.col(c).alias(f"{c}_a") for c in ("tile", "middle", "angle", "docs", "head")))
    right = side.withColumn("o", around).select("label", "d", (F.col("c1") + F.col("o.i")).alias("c1"), (F.col("c2") + F.col("o.j")).alias("c2"), *(F.col(c).alias(f"{c}_b") for c in ("tile", "middle", "angle", "docs", "head")))
    met = left.join(right.hint("merge"), ["label", "d", "c1", "c2"]).where("tile_a <= tile_b")
    product: Column = F.aggregate(F.zip_with("middle_a", "middle_b", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    apart = F.when(F.col("tile_a") == F.col("tile_b"), 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), product))))
    reach, most = F.col("angle_a") + F.col("angle_b"), math.acos(threshold)
    met = met.select("tile_a", "tile_b", "docs_a", "docs_b", "head_a", "head_b", apart.alias("apart"), reach.alias("reach"))
    slack = 1e-5  # an arc cosine near 1 has half of a double's digits
    return met.where(F.col("apart") - F.col("reach") <= most + slack).select("tile_a", "tile_b", "docs_a", "docs_b", "head_a", "head_b", (F.col("apart") + F.col("reach") < most - slack).alias("all"))


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit rows of ``x`` and ``y``, given along the principal directions, whose product is the threshold or more."""
    d = x.shape[1]
    rows, cols = np.arange(len(x)), np.arange(len(y))
    total, at, step = np.zeros((len(x), len(y))), 0, max(4, d // 8)
    left = np.ones((len(x), len(y)), bool)
    while at < d:
        to = min(d, at + step)
        total += x[rows, at:to] @ y[cols, at:to].T
        rest = np.sqrt((x[rows, to:] ** 2).sum(1))[:, None] * np.sqrt((y[cols, to:] ** 2).sum(1))[None, :]  # suffix norms
        left = total + rest >= threshold - (SLACK if to < d else 0)
        at, step = to, 2 * step
        r, c = left.any(1), left.any(0)
        if not (r.all() and c.all()):
            rows, cols, total, left = rows[r], cols[c], total[np.ix_(r, c)], left[np.ix_(r, c)]
        if not len(rows) or left.mean() < SPARSE:
            break
    i, j = np.nonzero(left)
    if at < d and len(i):
        dots = np.empty(len(i))
        for k in range(0, len(i), PAIRS):
            p, q = i[k : k + PAIRS], j[k : k + PAIRS]
            dots[k : k + PAIRS] = total[p, q] + np.einsum("ij,ij->i", x[rows[p], at:], y[cols[q], at:])
        i, j = i[dots >= threshold], j[dots >= threshold]
    return rows[i], cols[j]


def _compare(axes: dict[int, np.ndarray], threshold: float):
    def run(table: pa.Table) -> pa.Table:
        pdf = table.select(["dig", "cnt", "side"]).to_pandas()
        d = len(table.column("v")[0])
        y = _unit(_matrix(table.column("v").combine_chunks(), d))
        y = y @ axes[d] if d in axes else y
        side, cnt, dig = pdf["side"].to_numpy(), pdf["cnt"].to_numpy(), pdf["dig"].to_numpy()
        one = np.flatnonzero(side <= 0)
        two = one if (side < 0).all() else np.flatnonzero(side == 1)
        i, j = linked(y[one], y[two], threshold)
        i, j = one[i], two[j]
        if two is one:  # a tile with itself gives both directions
            i, j = i[i != j], j[i != j]
            both_i, both_j = i, j
        else:
            both_i, both_j = np.concatenate([i, j]), np.concatenate([j, i])
        links = np.bincount(both_i, cnt[both_j], len(y)).astype(np.int64)
        order = np.argsort(dig)  # roots by digest
        root = np.empty(len(y), np.int64)
        root[order] = np.arange(len(y))
        while True:
            new = root.copy()
            np.minimum.at(new, both_i, root[both_j])
            new = new[order[new]]
            if (new == root).all():
                break
            root = new
        got = np.flatnonzero(links)
        return pa.Table.from_pandas(pd.DataFrame({"dig": dig[got], "links": links[got], "root": dig[order[root[got]]]}), pa.schema([("dig", pa.string()), ("links", pa.int64()), ("root", pa.string())]), preserve_index=False)

    return run


def link_vectors(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    tile: int = TILE,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row for each vector with its links and its class.

    Two vectors are linked if their labels are equal and not null and their
    cosine is ``threshold`` (over 0.5) or more. Columns: ``vec_id``;
    ``n_links``, how many other vectors it is linked to; ``component_id``, the
    least vec_id that links reach, its own included; ``kept``, whether that is
    its own.

    Vectors that are null, empty or zero or hold a null or non-finite component,
    and those of a null label, link with nothing; vectors of different lengths
    are not compared. Repeated rows are vectors of their own, linked to each
    other. A null vec_id names a class only if it has no other. Extra columns
    are ignored; an empty table gives no rows. No pair is left out: bounds only
    skip what they decide.
    """
    spark = vectors.sparkSession
    with Scratch(spark, "vector-links") as run:
        return _linked(_named(vectors, id_col, vector_col, label_col), run, Scratch(spark, "vector-links-out"), threshold, tile, sample_rows)


def _linked(named_rows: DataFrame, run: Scratch, out: Scratch, threshold: float, tile: int, sample_rows: int) -> DataFrame:
    valid = run(named_rows, "valid")
    seen = out(valid.select("vec_id", "dig"), "seen")
    groups = valid.where("dig IS NOT NULL").groupBy("dig").agg(F.min("vec_id").alias("rep"), F.count("*").alias("cnt"), F.first("label").alias("label"), F.first("v").alias("v"))
    sets = run(groups, "sets")
    axes = _directions(sets, sample_rows)
    tiles = run(_tiles(_placed(sets, axes, math.sqrt(2 - 2 * threshold) + SLACK), tile), "tiles")
    pairs = run(_tile_pairs(tiles, threshold), "pairs")

    # Pairs of tiles all of whose pairs are links: counts by tile, one star for each tile and a link between the two.
    sure = pairs.where("all")
    more = sure.select(F.col("tile_a").alias("tile"), F.col("docs_b").alias("docs")).unionByName(sure.where("tile_a <> tile_b").select(F.col("tile_b").alias("tile"), F.col("docs_a").alias("docs")))
    own = sure.where("tile_a = tile_b").select(F.col("tile_a").alias("tile"), F.lit(True).alias("own"))
    by_tile = run(more.groupBy("tile").agg(F.sum("docs").alias("docs")).join(own, "tile", "left"), "sure")
    heads = tiles.where("head IS NOT NULL").select("tile", "head")
    at_once = tiles.select("tile", "dig", "cnt").join(by_tile, "tile").join(heads, "tile")
    at_once = run(at_once.select("dig", (F.col("docs") - F.when(F.col("own"), F.col("cnt")).otherwise(0)).alias("links"), F.col("head").alias("root")), "at-once")
    bridges = sure.where("tile_a <> tile_b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))

    # The others are compared.
    open_pairs = pairs.where("NOT all")
    name = F.concat_ws("/", "tile_a", "tile_b").alias("task")
    same = F.col("tile_a") == F.col("tile_b")
    tasks = open_pairs.select(F.col("tile_a").alias("tile"), name, F.when(same, -1).otherwise(0).alias("side")).unionByName(open_pairs.where(~same).select(F.col("tile_b").alias("tile"), name, F.lit(1).alias("side")))
    met = tiles.select("tile", "dig", "cnt", "v").join(tasks, "tile").select("task", "side", "dig", "cnt", "v")
    found = run(met.groupBy("task").applyInArrow(_compare(axes, threshold), "dig string, links long, root string"), "links")

    found = at_once.unionByName(found)
    edges = found.select(F.col("dig").alias("a"), F.col("root").alias("b")).unionByName(bridges)
    roots = components(edges, run, "classes")
    links = found.groupBy("dig").agg(F.sum("links").alias("links"))
    named = sets.select("dig", "rep", "cnt").join(links, "dig", "left").join(roots.withColumnRenamed("node", "dig"), "dig", "left")
    named = run(named.select("dig", "rep", (F.coalesce("links", F.lit(0)) + F.col("cnt") - 1).alias("n_links"), F.coalesce("root", "dig").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = out(named.join(least, "root").select("dig", "n_links", "component_id"), "classes")
    component = F.coalesce("component_id", "vec_id")
    joined = seen.select("vec_id", "dig").join(classes, "dig", "left")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
