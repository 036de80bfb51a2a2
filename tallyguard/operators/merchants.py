"""Merchants against a dictionary of known names, and language packs against texts."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stored

HIT, TYPO = 0.85, 0.70
#: Names of a block.
BLOCK = 512
#: Letters up to which names meet by what is left without one of them; longer ones meet in blocks.
SHORT = 64
# Words that speak for a language's pack.
PACKS = {
    "en": ("the", "and", "of", "total", "invoice", "amount", "date", "tax"), "de": ("der", "die", "das", "und", "rechnung", "betrag", "datum", "mwst"),
    "fr": ("le", "la", "les", "et", "facture", "montant", "date", "tva"), "es": ("el", "la", "los", "de", "factura", "importe", "fecha", "iva"),
}


def _best(left: pd.DataFrame, right: pd.DataFrame, least: float) -> pd.DataFrame:
    """For each name of a block the best known one of another block, by ratio, then name."""
    names, known = left["name"].tolist(), sorted(right["known"])
    shared = np.zeros((len(names), len(known)), np.int32)
    for c in set("".join(names)) & set("".join(known)):
        shared += np.minimum.outer([x.count(c) for x in names], [x.count(c) for x in known]).astype(np.int32)
    total = np.add.outer([len(x) for x in names], [len(x) for x in known])
    bounds = np.where(total > 0, 2.0 * shared / np.maximum(total, 1), 1.0)
    found = []
    for name, row in zip(names, bounds, strict=True):
        top: tuple[float, str] | None = None
        for j in np.argsort(-row, kind="stable"):
            if row[j] < least or top and row[j] < -top[0]:
                break
            ratio = difflib.SequenceMatcher(None, name, known[j]).ratio()
            if ratio >= least and (top is None or (-ratio, known[j]) < top):
                top = -ratio, known[j]
        if top:
            found.append((name, top[1], -top[0]))
    return pd.DataFrame(found, columns=["name", "known", "ratio"])


def near_matches(one: DataFrame, two: DataFrame, least: float = TYPO) -> DataFrame:
    """``name``, ``known``, ``ratio`` of names whose best known one is equal or a letter away, by equi-joins.

    With ``n`` letters, a known name two insertions and deletions away or more has a ratio of n / (n + 1) at most; a
    name with a better one among its nearest is settled, ties and all. Longer names than ``SHORT`` settle by equality.
    """

    def without(x: str, most: int) -> Column:
        return F.explode(F.when(F.length(x) <= most, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(F.col(x), F.lit(1), i - 1), F.substring(F.col(x), i + 1, F.length(x)))))).otherwise(F.array().cast("array<string>")))

    one, two = one.where("name <> ''"), two.where("known <> ''")
    equal = one.join(two, F.col("name") == F.col("known"))
    more = one.join(two.select("known", without("known", SHORT + 1).alias("name")), "name").select("name", "known")
    less = one.select("name", without("name", SHORT).alias("known")).join(two, "known").select("name", "known")

    def ratios(parts):
        for part in parts:
            yield part.assign(ratio=[difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(part["name"], part["known"], strict=True)])

    scored = equal.unionByName(more).unionByName(less).mapInPandas(ratios, "name string, known string, ratio double")
    best = scored.groupBy("name").agg(F.min(F.struct((-F.col("ratio")).alias("less"), "known")).alias("b"))
    n, ratio = F.length("name"), -F.col("b.less")
    sure = (ratio >= least) & ((ratio == 1.0) | ((n <= SHORT) & (ratio > n / (n + 1) + 1e-9)))
    return best.where(sure).select("name", "b.known", ratio.alias("ratio"))


def fuzzy_matches(names: DataFrame, known: DataFrame, least: float = TYPO) -> DataFrame:
    """For each name the best known one whose sequence ratio is ``least`` or more: a hit, or likely a misspelling.

    Names that are known, or a letter away from a known one, are settled by equi-joins. The other distinct names meet
    all known ones, in pairs of blocks. The letters that
    two names share, in any order, bound their ratio from above, so the ratio
    is taken only where that bound reaches ``least`` and the best found so far.
    """
    a = names.select("id", F.lower("name").alias("name"))
    one = a.where("name IS NOT NULL").select("name").distinct()
    two = known.select(F.lower("known").alias("known")).where("known IS NOT NULL").distinct()
    near = stored(near_matches(one, two, least))
    one = one.join(near.select("name"), "name", "left_anti")
    n, m = (max(1, -(-x.count() // BLOCK)) for x in (one, two))
    one = one.select("name", F.pmod(F.xxhash64("name"), F.lit(n)).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias("j"))
    two = two.select("known", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("i"), F.pmod(F.xxhash64("known"), F.lit(m)).alias("j"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _best(left, right, least)

    scored = one.groupBy("i", "j").cogroup(two.groupBy("i", "j")).applyInPandas(run, "name string, known string, ratio double").unionByName(near)
    best = scored.groupBy("name").agg(F.min(F.struct((-F.col("ratio")).alias("less"), "known")).alias("b"))
    top = best.select(F.col("name").alias("t_name"), "b.known", (-F.col("b.less")).alias("ratio"))
    j = a.join(top, a["name"] == top["t_name"], "left")
    kind = F.when(F.col("ratio") == 1.0, "exact").when(F.col("ratio") > HIT, "hit").when(F.col("ratio").isNotNull(), "typo")
    return j.select("id", "known", F.round("ratio", 6).alias("ratio"), kind.alias("match"))


def route_packs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pack with the most of its words in a text, by hundred words; ties by name, none below one."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+"), lambda w: w != "")
    rows = documents.select(key, words.alias("w"))
    n = F.size("w")

    def hits(known: tuple[str, ...]) -> Column:
        return F.size(F.filter("w", lambda w: w.isin(*known)))

    scores = [F.struct(hits(ws).alias("hits"), F.lit(-i).alias("order"), F.lit(p).alias("pack")) for i, (p, ws) in enumerate(sorted(PACKS.items()))]
    best = F.array_max(F.array(*scores))
    return rows.select(key, F.when(best["hits"] > 0, best["pack"]).alias("pack"), best["hits"].cast("long").alias("hits"), F.round(F.coalesce(F.try_divide(100 * best["hits"], n), F.lit(0.0)), 6).alias("per_100"))
