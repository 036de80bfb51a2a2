"""Tokens on a page: lines, spacing, regions that overlap, and the risk of their signals."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.sinks import stored

# Severities of spatial signals and limits of risk levels, in hundredths.
SEVERITY = {"critical": 100, "high": 70, "medium": 40, "low": 15}
LEVELS = ((75, "critical"), (50, "high"), (25, "medium"), (0, "low"))


def text_lines(tokens: DataFrame, gap: float = 8.0) -> DataFrame:
    """Tokens with the number of their line: a new line begins where y jumps by more than ``gap``."""
    order = W.partitionBy("page").orderBy("y", "x", "token_id")
    jump = F.coalesce(F.col("y") - F.lag("y").over(order) > gap, F.lit(False)).cast("int")
    return tokens.withColumn("jump", jump).withColumn("line", F.sum("jump").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("jump")


def line_statistics(lined: DataFrame) -> DataFrame:
    """By line: tokens, extent and the mean of the gaps between neighbours."""
    order = W.partitionBy("page", "line").orderBy("x", "token_id")
    rows = lined.withColumn("gap", F.col("x") - F.lag("x").over(order))
    return rows.groupBy("page", "line").agg(F.count("*").alias("n_tokens"), F.min("x").alias("x_lo"), F.max("x").alias("x_hi"), F.round(F.avg("gap"), 6).alias("mean_gap"))


def overlapping(regions: DataFrame) -> DataFrame:
    """Pairs of regions of one page whose boxes overlap, with the share of the smaller box."""
    a, b = regions.alias("a"), regions.alias("b")
    met = a.join(b, (F.col("a.page") == F.col("b.page")) & (F.col("a.region_id") < F.col("b.region_id")) & (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")) & (F.col("a.y0") < F.col("b.y1")) & (F.col("b.y0") < F.col("a.y1")))
    area = lambda t: (F.col(f"{t}.x1") - F.col(f"{t}.x0")) * (F.col(f"{t}.y1") - F.col(f"{t}.y0"))
    both = (F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")) * (F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0"))
    return met.select(F.col("a.page").alias("page"), F.col("a.region_id").alias("region_1"), F.col("b.region_id").alias("region_2"), F.round(both / F.least(area("a"), area("b")), 6).alias("share"))


def risk(signals: DataFrame) -> DataFrame:
    """By document: the mean of severity times confidence, plus a twentieth for each signal, up to 1, and its level."""
    table = F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair))
    scored = signals.withColumn("points", table[F.col("severity")] * F.col("confidence_c"))
    n = F.count("*")
    out = scored.groupBy("doc_id").agg(n.alias("n_signals"), F.least(F.lit(1.0), F.sum("points") / n / 10_000.0 + n * 5 / 100.0).alias("risk"))
    level = F.lit(None).cast("string")
    for limit, name in reversed(LEVELS):
        level = F.when(F.col("risk") >= limit / 100.0, name).otherwise(level)
    return out.withColumn("level", level)


def forensics(metrics: DataFrame) -> DataFrame:
    """What stored image metrics say: which limits they pass, and the verdict of two signals or more."""
    rules = (("ela_splice", F.col("ela_zone_variance") > 25.0), ("digital_origin", F.col("noise_mean") < 1.0), ("very_low_resolution", F.col("dpi") < 100), ("histogram_gaps", F.col("histogram_gap_ratio") > 0.3))
    hits = F.array_compact(F.array(*(F.when(c, n) for n, c in rules)))
    n = F.size(hits)
    return metrics.select("image_id", F.array_join(hits, ",").alias("signals"), n.cast("long").alias("n_signals"), F.when(n >= 3, "CRITICAL").when(n >= 2, "WARNING").alias("severity"))


def line_anomalies(lined: DataFrame, off: float = 3.0, share: float = 0.15, spread: float = 0.25) -> DataFrame:
    """Lines of three tokens or more whose baselines or heights don't agree.

    ``lined`` has whole-number ``base`` (a token's lower edge) and ``height``.
    A line is misaligned if ``share`` of its tokens stand more than ``off``
    from the mean baseline, uneven if the heights' variation exceeds ``spread``.
    """
    by = W.partitionBy("page", "line")
    mean = F.sum("base").over(by) / F.count("*").over(by)
    rows = lined.withColumn("apart", F.abs(F.col("base") - mean) > off)
    n, h, h2 = F.count("*"), F.sum("height"), F.sum(F.col("height") * F.col("height"))
    out = rows.groupBy("page", "line").agg(n.alias("n_tokens"), F.count_if("apart").alias("n_apart"), ((h2 * n - h * h) / (h * h)).alias("variation2"))
    known = out.where("n_tokens >= 3")
    return known.select("page", "line", "n_tokens", "n_apart", (F.col("n_apart") / F.col("n_tokens") >= share).alias("misaligned"), (F.col("variation2") > spread * spread).alias("uneven"))


def page_signals(anomalies: DataFrame, least: int = 2) -> DataFrame:
    """Signals of pages with ``least`` odd lines or more."""
    counted = anomalies.groupBy("page").agg(F.count("*").alias("n_lines"), F.count_if("misaligned").alias("n_misaligned"), F.count_if("uneven").alias("n_uneven"))
    found = F.array_compact(F.array(F.when(F.col("n_misaligned") >= least, "BASELINE_MISALIGNMENT"), F.when(F.col("n_uneven") >= least, "INTRA_LINE_HEIGHT_VARIATION")))
    return counted.select("page", "n_lines", F.array_join(found, ",").alias("signals")).where(F.col("signals") != "")


# Text that stands for something else, and mail domains for a day.
PLACEHOLDERS = r"lorem ipsum|xxx+|sample|\[.*?name.*?\]|john doe|jane doe|123 main st"
BRIEF_DOMAINS = ("tempmail", "mailinator", "guerrillamail", "10minutemail", "throwaway", "example")


def text_signals(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Placeholders, currencies, number formats, fixed phones and brief mail domains in a text: a row for each that is found."""
    t = F.coalesce(F.col(text), F.lit(""))
    symbols = F.array_distinct(F.regexp_extract_all(t, F.lit(r"[$€£¥₹]"), F.lit(0)))
    domains = F.regexp_extract_all(F.lower(t), F.lit(r"[a-z0-9._%+-]+@([a-z0-9-]+)\."), F.lit(1))
    formats = t.rlike(r"\d{1,3}(?:,\d{3})+\.\d{2}\b") & t.rlike(r"\d{1,3}(?:\.\d{3})+,\d{2}\b")
    rules = (
        ("PLACEHOLDER_TEXT_DETECTED", "high", t.rlike("(?i)" + PLACEHOLDERS)), ("MULTIPLE_CURRENCIES", "medium", F.size(symbols) > 1), ("INCONSISTENT_NUMBER_FORMAT", "medium", formats),
        ("PLACEHOLDER_PHONE_NUMBER", "high", t.rlike(r"\b(?:1234567890|0000000000|555-?01\d\d)\b")), ("SUSPICIOUS_EMAIL_DOMAIN", "medium", F.exists(domains, lambda d: d.isin(*BRIEF_DOMAINS))),
    )
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(n).alias("signal"), F.lit(s).alias("severity"))) for n, s, c in rules)))
    return documents.select(key, F.explode(found).alias("s")).select(key, "s.*")


#: Boxes that are settled together: pages of so many at most are settled whole; of larger ones, so many in each cell and round.
TOGETHER, IN_CELL = 50_000, 4_000
_SIDES = ("x0", "y0", "x1", "y1")
_SPOT = ("page", "kx", "ky", "ix", "iy")


def _covered(a: np.ndarray, b: np.ndarray, share: float, rows: int = 4096) -> np.ndarray:
    """Which boxes of ``a`` share more than ``share`` of both together with one of ``b``; columns are boxes, by area, rows x0, y0, x1, y1 and area."""
    found = np.zeros(a.shape[1], bool)
    if not a.size or not b.size:
        return found
    # a box can be covered by one of 1 / share of its area at most
    for lo in range(np.searchsorted(-b[4], -a[4, 0] / share * 1.001), b.shape[1], rows):
        found |= _cover(a, b[:, lo : lo + rows], share).any(axis=1)
    return found


def _cover(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    x0, y0, x1, y1, area = a[:, :, None]
    both = np.maximum(0, np.minimum(x1, b[2]) - np.maximum(x0, b[0])) * np.maximum(0, np.minimum(y1, b[3]) - np.maximum(y0, b[1]))
    return both > (area + b[4] - both) * share


def _certain(share: float, rows: int = 512) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over boxes by place and size: those that are certainly kept. A place begins at ``n`` 1; what it holds are its kept and open boxes.

    A box that is not the place's ``own`` can be covered by boxes that are not here: it is open, and so is what it covers.
    """

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty((5, 0))
        kept = open_ = none
        for batch in batches:
            number = lambda c, of=batch: of.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
            boxes, own, starts = np.array([number(c) for c in (*_SIDES, "area")]), batch.column("own").to_numpy(zero_copy_only=False), batch.column("n").to_numpy() == 1
            cuts = sorted({*range(0, batch.num_rows, rows), *np.flatnonzero(starts).tolist(), batch.num_rows})
            found = []
            for lo, hi in zip(cuts, cuts[1:]):  # noqa: B905  neighbours
                if starts[lo]:
                    kept = open_ = none
                at = np.arange(lo, hi)
                at = at[~_covered(boxes[:, at], kept, share)]
                doubt, gone = ~own[at] | _covered(boxes[:, at], open_, share), np.zeros(len(at), bool)
                meet = _cover(boxes[:, at], boxes[:, at], share)
                for i in range(len(at)):
                    if not gone[i]:
                        (doubt if doubt[i] else gone)[i + 1 :] |= meet[i, i + 1 :]
                sure, unsure = at[~gone & ~doubt], at[~gone & doubt]
                kept, open_ = np.concatenate([kept, boxes[:, sure]], axis=1), np.concatenate([open_, boxes[:, unsure]], axis=1)
                found.append(sure)
            yield batch.take(pa.array(np.concatenate([np.empty(0, np.int64), *found])))

    return settle


def distinct_regions(regions: DataFrame, share: float = 0.7, together: int | None = None) -> DataFrame:
    """Regions of a page, largest first, but those that cover a kept larger one by more than ``share`` of both together.

    Of equal areas the lower ``region_id`` goes first; equal boxes are one; boxes
    without an area are kept. ``rank`` counts a page's kept regions by size.
    A box is compared with kept ones only, which are few where boxes are dense,
    so no pairs of boxes are formed. A page of more than ``together`` boxes (``TOGETHER``) is
    cut into cells, by classes of width and height and by middles: two boxes that
    share so much differ by one class at most and stand close, so a cell sees all
    that its boxes may share with. Rounds keep what is certain in each cell, and
    what that covers goes; what is open is written between rounds.
    """
    together = together or TOGETHER
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    boxes = stored(regions.groupBy("page", *_SIDES).agg(F.min("region_id").alias("region_id")).withColumn("area", wide.cast("double") * high.cast("double")))
    has_area = F.coalesce((wide > 0) & (high > 0) & (F.col("area") < float("inf")), F.lit(False))
    sized = boxes.where(has_area)

    def certain(rows: DataFrame, most: int) -> DataFrame:
        first = F.row_number().over(W.partitionBy(*_SPOT).orderBy(F.desc("area"), "region_id"))
        ranked = rows.select(*boxes.columns, *_SPOT[1:], "own", first.alias("n")).where(F.col("n") <= most)
        return ranked.mapInArrow(_certain(share), ranked.schema).drop("own", "n")

    large = sized.groupBy("page").agg(F.count("*").alias("n")).where(F.col("n") > together).select(F.col("page").alias("large"))
    is_large = F.col("page").eqNullSafe(F.col("large"))
    whole = sized.join(large, is_large, "left_anti").select("*", *(F.lit(0).alias(k) for k in _SPOT[1:]), F.lit(True).alias("own"))
    kept = boxes.where(~has_area).unionByName(certain(whole, together).select(*boxes.columns))
    if not large.isEmpty():
        open_ = stored(_celled(sized.join(large, is_large, "left_semi"), share))
        while not open_.isEmpty():
            visitors = _visits(open_, share).where("NOT (kx = own_kx AND ky = own_ky AND ix = own_ix AND iy = own_iy)")
            found = stored(certain(open_.withColumn("own", F.lit(True)).unionByName(visitors.select(*open_.columns, F.lit(False).alias("own"))), min(together, IN_CELL)))
            kept = kept.unionByName(found.select(*boxes.columns))
            a, b = open_.alias("a"), _visits(found, share).alias("b")
            both = F.greatest(F.lit(0), F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")) * F.greatest(F.lit(0), F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0"))
            same = lambda names: reduce(and_, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in names))
            over = (both > (F.col("a.area") + F.col("b.area") - both) * share) | same(_SIDES)
            open_ = stored(a.join(b, same(_SPOT) & over, "left_anti"))
    rank = F.row_number().over(W.partitionBy("page").orderBy(F.desc("area"), "region_id"))
    return kept.select("page", "region_id", *_SIDES, rank.alias("rank"))


def _cell(at: Column, k: Column, share: float) -> Column:
    return F.floor(at / F.pow(F.lit(1 / share), k + 2))


def _middle(i: str) -> Column:
    return (F.col(f"{i}0") + F.col(f"{i}1")) / 2


def _celled(boxes: DataFrame, share: float) -> DataFrame:
    """Boxes with the classes of their width and height and the cell of their middle."""
    size = lambda i: F.floor(F.log(F.col(f"{i}1") - F.col(f"{i}0")) / math.log(1 / share)).cast("int").alias(f"k{i}")
    return boxes.select("*", size("x"), size("y")).withColumns({f"i{i}": _cell(_middle(i), F.col(f"k{i}"), share) for i in "xy"})


def _visits(celled: DataFrame, share: float) -> DataFrame:
    """Boxes in each cell, their own among them, whose boxes they may share so much with; their own is in columns with ``own_`` before them."""
    out = celled.withColumns({f"own_{k}": F.col(k) for k in _SPOT[1:]})
    for k in ("kx", "ky"):
        out = out.withColumn(k, F.explode(F.sequence(F.col(k) - 1, F.col(k) + 1)))
    # middles are nearer than (1 - share) of the larger side, which is within the cell of the next class
    for i in "xy":
        away = F.pow(F.lit(1 / share), F.col(f"k{i}") + 2) * (1 - share)
        out = out.withColumn(f"i{i}", F.explode(F.sequence(_cell(_middle(i) - away, F.col(f"k{i}"), share), _cell(_middle(i) + away, F.col(f"k{i}"), share))))
    return out
