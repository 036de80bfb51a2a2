"""Vector code compression: integer codebooks by part, compared in the Walsh-Hadamard domain.

A vector's integer components are cut into parts; each part position has a
codebook of entries. Parts and entries, padded with zeros to a power of two, go
through the integer Walsh-Hadamard transform, by which a squared distance is
the sum of squared differences of coefficients divided by their number: exact
in whole numbers. Coefficients are added in sequency order, where the first
ones hold most of what differs, and an entry is dropped as soon as its sum
passes the full distance of a likely entry.

Every round is one pass over the vectors, which only sends sums by part and
entry; the codebooks are a few hundred numbers and go out with the next pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Coefficients added between two eliminations.
STEP = 2


def hadamard(n: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of ``n``, a power of two, with its rows by sequency (their number of sign changes)."""
    h = np.ones((1, 1), np.int64)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(1), kind="stable")]


def transformed(parts: np.ndarray) -> np.ndarray:
    """Coefficients of rows of integers, padded with zeros to a power of two, in sequency order."""
    width = parts.shape[1]
    n = 1 << max(0, width - 1).bit_length()
    return parts @ hadamard(n)[:, :width].T


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest entry, the lowest index of ties, and its squared distance.

    ``parts`` and ``entries`` are coefficients. The entry least by the first
    coefficients gives each row a bound, its own full distance; pairs of row and
    entry over the bound are left out as soon as they are.
    """
    n = parts.shape[1]
    first = ((parts[:, None, :STEP] - entries[None, :, :STEP]) ** 2).sum(2)
    guess = first.argmin(1)
    bound = ((parts - entries[guess]) ** 2).sum(1)
    row, entry = np.nonzero(first <= bound[:, None])
    so_far = first[row, entry]
    for at in range(STEP, n, STEP):
        so_far = so_far + ((parts[row, at : at + STEP] - entries[entry, at : at + STEP]) ** 2).sum(1)
        left = so_far <= bound[row]
        row, entry, so_far = row[left], entry[left], so_far[left]
    starts = np.flatnonzero(np.diff(row, prepend=-1))  # the guess is left in every row
    least = np.minimum.reduceat(so_far, starts) if len(starts) else so_far
    ties = np.flatnonzero(so_far == least[row])
    best = ties[np.flatnonzero(np.diff(row[ties], prepend=-1))]
    return entry[best], least // n


def limit(width: int, parts: int = PARTS) -> int:
    """The greatest size of an integer component with which no sum of coefficients leaves 64 bits, nor an error a long."""
    n = 1 << max(0, -(-width // parts) - 1).bit_length()
    return 1 << ((62 - 2 * n.bit_length() + 2 - max(0, (parts - n).bit_length())) // 2 - 1)


def _integers(vectors: pa.Array, width: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a vector of ``width`` finite components, and these as integers by part."""
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(lengths == width)
    x = vectors.take(pa.array(fits)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(fits), width)  # nulls are NaN
    finite = np.isfinite(x).all(1)
    most = limit(width, parts)
    x = np.clip(np.floor(SCALE * np.clip(x[finite], -most, most)), -most, most).astype(np.int64)
    each = -(-width // parts)
    out = np.zeros((len(x), parts * each), np.int64)
    out[:, :width] = x
    return fits[finite], out.reshape(len(x), parts, each)


def encode(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row for each kept vector with its code.

    Columns: ``vec_id``; ``code``, two hex digits of the nearest entry's index
    for each part; ``error``, the squared distances to these entries, summed;
    ``label_error``, errors summed over equal labels, nulls together;
    ``codebooks_sha256``, of all components by part, entry and position.

    Dropped: null and empty vectors, those with a null or non-finite component,
    and those of another length than the kept vector of the smallest id. A
    length that ``parts`` does not divide is filled up with zeros. Integers
    beyond ``limit`` are taken as the limit, so that no error leaves a long; a
    label's sum beyond a long is the greatest long.
    Codebooks start as the parts of the smallest ids, null ids last, equal ids
    by their vectors; with fewer vectors than ``entries`` they have as many
    entries as vectors. Repeated rows count as often as they come; extra
    columns are ignored; no kept vector gives no rows.
    """
    spark = vectors.sparkSession
    values = vectors[vector_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].cast("string").alias("label"), values.alias("vector"))
    whole = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = rows.where((F.size("vector") > 0) & whole)
    head = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).collect()
    width = len(head[0]["vector"]) if head else parts
    firsts = kept.where(F.size("vector") == width).orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    each = -(-width // parts)
    start = _integers(pa.array([r["vector"] for r in firsts], pa.list_(pa.float64())), width, parts)[1] if firsts else np.zeros((1, parts, each), np.int64)
    books = start.transpose(1, 0, 2).copy()  # part, entry, position

    def assigned(batch: pa.RecordBatch, coefficients: list[np.ndarray]):
        which, x = _integers(batch.column(batch.schema.get_field_index("vector")), width, parts)
        found = [nearest(transformed(x[:, p]), coefficients[p]) for p in range(parts)]
        return which, x, np.stack([f[0] for f in found], 1), sum(f[1] for f in found)

    def sums_with(books: np.ndarray):
        coefficients = [transformed(b) for b in books]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                _, x, code, _ = assigned(batch, coefficients)
                for p in range(parts):
                    np.add.at(total[p], code[:, p], x[:, p])
                    count[p] += np.bincount(code[:, p], minlength=books.shape[1])
            p, e = np.nonzero(count)
            k = np.repeat(np.arange(len(p)), each)
            pos = np.tile(np.arange(each), len(p))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in ((p[k], pa.int32()), (e[k], pa.int32()), (pos, pa.int32()), (total[p, e].ravel(), pa.int64()), (count[p, e][k], pa.int64()))], names=["p", "e", "pos", "s", "n"])

        return run

    for _ in range(rounds if firsts else 0):
        partial = rows.select("vector").mapInArrow(sums_with(books.copy()), "p int, e int, pos int, s long, n long")
        books = books.copy()
        for r in partial.groupBy("p", "e", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():  # parts x entries x positions at most
            books[r["p"], r["e"], r["pos"]] = r["s"] // r["n"]

    final = [transformed(b) for b in books]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, _, code, error = assigned(batch, final)
            digits = ["".join(f"{e:02x}" for e in row) for row in code.tolist()]
            at = pa.array(which)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(digits, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    run = Scratch(spark, "vector-codes")
    out = run(rows.mapInArrow(coded, "vec_id long, label string, code string, error long"), "coded")
    if not firsts:
        out = out.limit(0)
    by_label = run(out.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias("label_error")), "label-errors")
    same = out["label"].eqNullSafe(by_label["label"])
    return out.join(by_label, same).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
