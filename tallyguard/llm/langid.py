"""Language identification by prediction by partial matching.

For each language a variable-order byte context tree is counted over the
training texts in lower case; escape probabilities (method C, with exclusion)
blend its orders into one exact probability of every one of 256 bytes after
every context. The statistics are frozen, so the tree of a language is laid out
as sorted tables of what it has seen: code lengths of bytes in context, and of
escapes from contexts, for each order. A text's code length under a language is
a sum of look-ups. The shortest code wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Bytes of context; with the byte itself they fill 32 bits.
ORDER = 3
#: Bytes that are looked up at once.
STEP = 1 << 18
#: Training texts of a language, in expectation; a language with fewer gives all.
FIT_DOCS = 4000
#: Bytes that the posterior counts as one independent observation.
DEPENDENCE = 24.0
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)


def packed(data: np.ndarray) -> np.ndarray:
    """For each byte its context and itself, as one number of ``ORDER + 1`` bytes."""
    c = np.concatenate([np.full(ORDER, 32, np.uint32), data.astype(np.uint32)])
    out = c[: len(data)]
    for k in range(1, ORDER + 1):
        out = out << 8 | c[k : k + len(data)]
    return out


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of every symbol after every context; ``counts``: contexts by symbol, shape ``(n,) * (ORDER + 1)``.

    Method C: a symbol seen ``c`` times of ``t`` in a context that has shown
    ``q`` symbols has probability c / (t + q); the others share q / (t + q) as
    the next shorter context has them, with the seen ones excluded.
    """
    n = counts.shape[0]
    p = np.full(n, 1.0 / n)
    for k in range(counts.ndim):
        c = counts.sum(axis=tuple(range(counts.ndim - 1 - k))).astype(np.float64)
        seen = c > 0
        total, kinds = c.sum(-1, keepdims=True), seen.sum(-1, keepdims=True)
        lower = np.broadcast_to(p if k == 0 else p[None], c.shape)
        rest = np.where(seen, 0.0, lower)
        mass = rest.sum(-1, keepdims=True)
        full = (mass <= 0) & (total > 0)
        p = np.where(seen, c / np.maximum(total + np.where(full, 0, kinds), 1), rest * np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0) / np.where(mass > 0, mass, 1))
    return -np.log2(np.maximum(p, 1e-300))


Order = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def tree(grams: np.ndarray, counts: np.ndarray) -> list[Order]:
    """``code_lengths`` over 256 bytes, of what was seen alone.

    For each order the sorted contexts with their byte and its bits, and the
    sorted contexts and the bits of an escape from each: with those, a byte
    that a context hasn't shown has the bits of the next shorter one.
    """
    orders, above, p = [], np.zeros(0, np.uint32), np.zeros(0)
    for k in range(ORDER + 1):
        keys, at = np.unique(grams.astype(np.uint32) & np.uint32((1 << 8 * (k + 1)) - 1), return_inverse=True)
        c = np.bincount(at, counts, len(keys))
        contexts, own = np.unique(keys >> np.uint32(8), return_inverse=True)
        total, kinds = np.bincount(own, c, len(contexts)), np.bincount(own, minlength=len(contexts))
        lower = p[np.searchsorted(above, keys & np.uint32((1 << 8 * k) - 1))] if k else np.full(len(keys), 1 / 256)
        full = kinds == 256
        rest = np.where(full, 1.0, np.maximum(1 - np.bincount(own, lower, len(contexts)), 1e-15))
        above, p = keys, c / (total + np.where(full, 0, kinds))[own]
        orders.append((keys, -np.log2(p).astype(np.float32), contexts, -np.log2(kinds / (total + kinds) / rest).astype(np.float32)))
    return orders


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are keys, and the values of those."""
    if not len(keys):
        return np.zeros(len(wanted), bool), values
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return hit, values[at[hit]]


def bits_of(orders: list[Order], grams: np.ndarray) -> np.ndarray:
    """Bits of each byte in context, by the longest context that has shown it and the escapes on the way."""
    out, left = np.zeros(len(grams)), np.arange(len(grams))
    for k in range(ORDER, -1, -1):
        keys, bits, contexts, escapes = orders[k]
        g = grams[left] & np.uint32((1 << 8 * (k + 1)) - 1)
        hit, b = _found(keys, bits, g)
        out[left[hit]] += b
        left, g = left[~hit], g[~hit]
        hit, b = _found(contexts, escapes, g >> np.uint32(8))
        out[left[hit]] += b
    out[left] += 8.0
    return out


def _counted(train: DataFrame) -> DataFrame:
    """Counts of bytes in context, by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def merge(lang: str) -> None:
            grams, counts = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
            if lang in sums:
                a, b = sums[lang]
                both, where = np.unique(np.concatenate([a, grams]), return_inverse=True)
                grams, counts = both, np.bincount(where, np.concatenate([b, counts])).astype(np.int64)
            sums[lang] = grams, counts

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(lang, []).append(packed(_bytes(text.as_py())))
                if sum(map(len, held[lang])) > 1 << 21:
                    merge(lang)
        for lang in list(held):
            merge(lang)
        for lang, (grams, counts) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

    return train.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Languages and the context tree of each."""

    def __init__(self, langs: list[str], trees: list[list[Order]]):
        self.langs, self.trees = langs, trees

    def codes(self, texts: list[str]) -> np.ndarray:
        """Bits of whole texts (rows) under each language."""
        total = np.zeros((len(texts), len(self.langs)))
        pieces: list[tuple[int, np.ndarray]] = []

        def add() -> None:
            every, at = np.unique(np.concatenate([x for _, x in pieces]), return_inverse=True)
            starts = np.cumsum([0, *(len(x) for _, x in pieces[:-1])])
            for j, orders in enumerate(self.trees):
                np.add.at(total[:, j], [i for i, _ in pieces], np.add.reduceat(bits_of(orders, every)[at], starts))
            pieces.clear()

        held = 0
        for i, text in enumerate(texts):
            grams = packed(_bytes(text))
            for k in range(0, len(grams), STEP):
                pieces.append((i, grams[k : k + STEP]))
                held += len(pieces[-1][1])
                if held >= STEP:
                    add()
                    held = 0
        if pieces:
            add()
        return total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out, able = [(UNKNOWN, 0.0)] * len(texts), [i for i, t in enumerate(texts) if self.langs and t and _LETTER.search(t)]
        for i, bits in zip(able, self.codes([texts[i] for i in able]), strict=True):
            less = (bits - bits.min()) * (np.log(2) / DEPENDENCE)
            out[i] = self.langs[int(bits.argmin())], float(1 / np.exp(-np.minimum(less, 700)).sum())
        return out


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """The model of ``docs`` (``doc_id``, ``text``, ``lang``, all labelled).

    Counts are summed over a sample of whole texts, chosen by a hash of the id
    so that a language gives ``fit_docs`` in expectation. The driver reads the
    counts of one language at a time and keeps its tree.
    """
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], [])
    share = F.lit(0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, int(1e6 * min(1.0, fit_docs / sizes[lang]))).otherwise(share)
    train = docs.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_000)) < share)
    run = Scratch(docs.sparkSession, "langid")
    grams = run(_counted(train).sortWithinPartitions("lang"), "grams")
    trees = []
    for lang in langs:
        own = grams.where(F.col("lang") == lang).select("gram", "n").toPandas()
        trees.append(tree(own["gram"].to_numpy(np.int64), own["n"].to_numpy(np.float64)))
    run.remove()
    return Model(langs, trees)


def predict_language(docs: DataFrame, fit_docs: int = FIT_DOCS, folds: int = 4, held: int = 2) -> DataFrame:
    """One row for each document: ``doc_id``, ``held_out``, ``lang_pred``, ``score``.

    Learned from the texts and non-null ``lang`` of the documents outside fold
    ``held`` alone; a prediction reads the whole text and nothing else.
    ``score`` is the posterior of the language at equal priors, with code
    lengths divided by ``DEPENDENCE``. Null texts and texts without letters are
    ``und`` with score 0, as is everything where nothing could be learned; of
    equal codes the first language by name wins. Null doc_ids count as empty
    text in the fold; repeated rows stay; extra columns are ignored; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    out = fold_of(docs["doc_id"], folds) == held
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"), out.alias("held_out"))
    shared = spark.sparkContext.broadcast(fit(rows.where("NOT held_out AND text IS NOT NULL AND lang IS NOT NULL"), fit_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = model.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
