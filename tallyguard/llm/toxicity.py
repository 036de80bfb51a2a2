"""Toxicity by a weighted finite-state pattern grammar.

Small transducers read the words of a clause: one marks insults, one threats,
one targets, one rewrites what stands under a negation and one what stands in
reported speech. They are composed into one machine, and a clause is scored by
the weights of the marks that the machine writes, so an insult that is denied,
quoted or aimed at someone, before or after it, counts as that and not as a
bare word, and a threat needs its intention: "will", "going to", "should".

The insults, their weights and those of the marks are learned from labels: a
word or the beginning of a word weighs by how much more often it stands in
toxic documents than in others, by different places. A word takes the weight of
its longest known beginning, so a harmless longer form stays harmless.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, numbered
from .langid import fold_of

#: Labelled texts that are learned from, in expectation: what the driver gathers is bounded by their words.
FIT_DOCS = 20_000
#: Features, and places of features, that a task holds before it hands them on.
HELD_FEATURES, HELD_PLACES = 100_000, 1_000_000
#: Bits of a place: two hashes of 32 bits, the first times 31.
PLACE_BITS = 37
#: Lengths of word beginnings that can be insults, beside whole words.
STEMS = (4, 5, 6, 7, 8)
#: Different places that an insult has in toxic texts at least, the chance of
#: such counts by accident, in nats, that is accepted, and the log-odds it needs.
LEAST_PLACES, LEAST_NATS, LEAST_WEIGHT = 4, 10.0, 2.0
#: The log-odds of a seed or a threat.
SEED_WEIGHT = 6.0
#: Words after a negation, and after a word of reporting, that it covers.
NEGATED_WORDS, REPORTED_WORDS = 3, 8

# Seed insults, used where no labels are, and the closed word classes.
SEEDS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
TARGETS = (
    "you", "your", "he", "him", "she", "her", "they", "them",
    "du", "dich", "dir", "dein", "deine", "ihr", "euch", "er", "ihn", "ihm",
    "tu", "te", "toi", "ton", "vous", "il", "elle", "ils", "elles", "lui", "leur",
    "tú", "ti", "usted", "ustedes", "él", "ella", "ellos", "ellas",
)
NEGATIONS = ("aucun", "jamais", "kein", "keine", "never", "nicht", "ni", "nor", "not", "nunca", "pas", "sin")
REPORTS = ("affirme", "asked", "behauptet", "called", "claimed", "dijo", "disait", "quoted", "reported", "said", "sagte", "says")
CONTRASTS = ("but", "yet", "aber", "sondern", "mais", "pero", "sino")
WILLS = (
    "will", "ll", "shall", "should", "must", "gonna", "going", "want", "wanna", "plan",
    "werde", "werden", "wird", "soll", "sollte", "muss", "will",
    "vais", "va", "vas", "allons", "veux", "dois", "devrait",
    "voy", "vas", "vamos", "quiero", "debo", "debería",
)
HARMS = (
    "beat", "crush", "destroy", "hurt", "kill", "murder", "shoot", "smash", "stab", "strangle",
    "schlagen", "töten", "umbringen", "verprügeln", "zerstören",
    "cogner", "détruire", "frapper", "tuer",
    "destruir", "golpear", "matar", "pegar",
)

WORDS = re.compile(r"[^\W\d_]+")
_CLAUSES = re.compile(r"[.!?;:\n]+")
_SYMBOLS = re.compile(r"[^\W\d_]+|,")
#: The marks that are weighed, in order.
MARKS = ("insult", "insult+target", "insult+negated", "insult+reported", "threat", "threat+target", "threat+negated")


class Transducer:
    """A deterministic machine: ``arcs`` from (state, symbol) to (state, symbol written).

    A symbol without an arc follows that of ``None`` and is copied; without
    that, the machine stays and copies. State 0 is the start.
    """

    def __init__(self, arcs: dict[tuple[object, str | None], tuple[object, str | None]]):
        self.arcs = arcs

    def step(self, state: object, symbol: str) -> tuple[object, str]:
        found = self.arcs.get((state, symbol))
        if found is None:
            found = (self.arcs.get((state, None)) or (state, None))[0], symbol
        return found[0], symbol if found[1] is None else found[1]

    def compose(self, after: Transducer, alphabet: Iterable[str]) -> Transducer:
        """The machine that reads what this one reads and writes what ``after`` writes of it."""
        arcs, left, names = {}, [(0, 0)], {(0, 0): 0}
        alphabet = tuple(alphabet)
        while left:
            pair = left.pop()
            for symbol in alphabet:
                one, middle = self.step(pair[0], symbol)
                two, out = after.step(pair[1], middle)
                if (one, two) not in names:
                    names[one, two] = len(names)
                    left.append((one, two))
                arcs[names[pair], symbol] = names[one, two], out
        return Transducer(arcs)

    def __call__(self, symbols: Iterable[str]) -> list[str]:
        state, out = 0, []
        for symbol in symbols:
            state, mark = self.step(state, symbol)
            out.append(mark)
        return out


ALPHABET = ("other", "insult", "target", "neg", "report", "will", "harm", "comma", "contrast")


def threats() -> Transducer:
    """An intention, up to two words, a harm; a target between them or within two words after makes it aimed."""
    return Transducer({
        (0, "will"): ("will", None),
        ("will", "harm"): ("done", "threat"), ("will", "target"): ("aimed", None), ("will", "other"): ("will1", None), ("will", "contrast"): (0, None),
        ("will1", "harm"): ("done", "threat"), ("will1", "target"): ("aimed", None), ("will1", "neg"): ("will1", None), ("will1", "other"): ("will2", None), ("will1", None): (0, None),
        ("will2", "harm"): ("done", "threat"), ("will2", "target"): ("aimed", None), ("will2", None): (0, None),
        ("aimed", "harm"): (0, "threat+target"), ("aimed", "neg"): ("aimed", None), ("aimed", "other"): ("aimed1", None), ("aimed", None): (0, None),
        ("aimed1", "harm"): (0, "threat+target"), ("aimed1", None): (0, None),
        ("done", "target"): (0, "threat+target"), ("done", "other"): ("done1", None), ("done", None): (0, None),
        ("done1", "target"): (0, "threat+target"), ("done1", None): (0, None),
    })


def negations() -> Transducer:
    """What stands within ``NEGATED_WORDS`` words after a negation, up to a comma or a contrast."""
    arcs: dict = {(0, "neg"): (1, None)}
    for k in range(1, NEGATED_WORDS + 1):
        after = k + 1 if k < NEGATED_WORDS else 0
        arcs |= {(k, x): (after, f"{x.split('+')[0]}+negated") for x in ("insult", "threat", "threat+target")}
        arcs |= {(k, "neg"): (1, None), (k, "comma"): (0, None), (k, "contrast"): (0, None), (k, None): (after, None)}
    return Transducer(arcs)


def reports() -> Transducer:
    """Insults within ``REPORTED_WORDS`` words after a word of reporting, up to a contrast."""
    arcs: dict = {(0, "report"): (1, None)}
    for k in range(1, REPORTED_WORDS + 1):
        after = k + 1 if k < REPORTED_WORDS else 0
        arcs |= {(k, "insult"): (after, "insult+reported"), (k, "report"): (1, None), (k, "contrast"): (0, None), (k, None): (after, None)}
    return Transducer(arcs)


def targets() -> Transducer:
    """Insults after a target, and targets within two words after an insult, up to a contrast."""
    return Transducer({
        (0, "target"): ("named", None), (0, "insult"): ("said", None),
        ("named", "insult"): ("named", "insult+target"), ("named", "contrast"): (0, None),
        ("said", "target"): ("named", "insult+target"), ("said", "comma"): ("said", None), ("said", "insult"): ("said", None), ("said", "other"): ("said1", None), ("said", None): (0, None),
        ("said1", "target"): ("named", "insult+target"), ("said1", "comma"): ("said1", None), ("said1", "insult"): ("said", None), ("said1", None): (0, None),
    })


def grammar() -> Transducer:
    """All transducers in one, over the word classes of ``ALPHABET``."""
    whole, alphabet = threats(), {*ALPHABET, *MARKS}
    for machine in (negations(), reports(), targets()):
        whole = whole.compose(machine, alphabet)
    return whole


class Scorer:
    """Marks and score of a text, by weighed insults and the weights of the marks.

    An insult is a word, or a beginning of longer words ending in ``*``;
    entries under ``LEAST_WEIGHT`` are known harmless forms.
    """

    def __init__(self, insults: dict[str, float], weights: np.ndarray | None = None):
        import ahocorasick

        self.insults = dict(insults)
        self.weights = np.array([-4.0, 1.0, 0.5, 0.5, -1.5, -1.2, 0.5, 1.0, -1.5]) if weights is None else weights
        self.lengths = sorted({len(x) - 1 for x in self.insults if x.endswith("*")}, reverse=True)
        self.classes = {w: kind for kind, group in (("target", TARGETS), ("neg", NEGATIONS), ("report", REPORTS), ("will", WILLS), ("harm", HARMS), ("contrast", CONTRASTS), ("comma", (",",))) for w in group}
        self.machine = grammar()
        self.cues = ahocorasick.Automaton()
        for cue in {x.rstrip("*") for x, w in self.insults.items() if w >= LEAST_WEIGHT} | set(HARMS):
            self.cues.add_word(cue, cue)
        self.cues.make_automaton()

    def weight(self, word: str) -> float:
        """The word's own weight, or that of its longest known beginning."""
        if word in self.insults:
            return self.insults[word]
        for k in self.lengths:
            if len(word) > k and (found := self.insults.get(word[:k] + "*")) is not None:
                return found
        return 0.0

    def marks(self, text: str | None) -> np.ndarray:
        """The greatest weight of an insult, then the sum of weights by mark, over all clauses of the text."""
        out = np.zeros(1 + len(MARKS))
        lower = (text or "").lower()
        if next(self.cues.iter(lower), None) is None:
            return out
        for clause in _CLAUSES.split(lower):
            weights, kinds = [], []
            for word in _SYMBOLS.findall(clause):
                weights.append(self.weight(word))
                kinds.append("insult" if weights[-1] >= LEAST_WEIGHT else self.classes.get(word, "other"))
            if "insult" not in kinds and "harm" not in kinds:
                continue
            said = 0.0
            for weight, kind, mark in zip(weights, kinds, self.machine(kinds), strict=True):
                said = weight if kind == "insult" else said
                if mark in MARKS:  # a target's mark is of the insult before it
                    weight = said if mark.startswith("insult") else SEED_WEIGHT
                    out[1 + MARKS.index(mark)] += weight
                    out[0] = max(out[0], weight)
        return out

    def scores(self, marks: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + features(marks) @ self.weights[1:], -30, 30)))

    def score(self, text: str | None) -> float:
        return float(self.scores(self.marks(text)))


def features(marks: np.ndarray) -> np.ndarray:
    """What the weights multiply: the greatest weight, and the logarithms of the sums."""
    return np.concatenate([marks[..., :1], np.log1p(marks[..., 1:])], axis=-1)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.5, steps: int = 60) -> np.ndarray:
    """Weights of an L2-regularised logistic regression by Newton's method; the first is the bias."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), l2 * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _grams(words: list[str]) -> Iterator[tuple[str, int]]:
    """Features of a text and the place of each: the words before and after."""
    for i, word in enumerate(words):
        place = hash_of(words[i - 1] if i else "") * 31 + hash_of(words[i + 1] if i + 1 < len(words) else "")
        yield word, place
        for k in STEMS:
            if len(word) > k:
                yield word[:k] + "*", place


def hash_of(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace"))


def _counts(train: DataFrame) -> DataFrame:
    """feature, toxic, clean: in how many sampled documents it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            every = list(found[0].keys() | found[1].keys())
            columns = [pa.array(every, pa.string()), *(pa.array([found[k][x] for x in every], pa.int64()) for k in (1, 0))]
            found[0].clear(), found[1].clear()
            return pa.RecordBatch.from_arrays(columns, names=["feature", "toxic", "clean"])

        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found[toxic].update({x for x, _ in _grams(WORDS.findall(text.as_py().lower()))})
                if len(found[0]) + len(found[1]) > HELD_FEATURES:
                    yield out()
        yield out()

    return train.select("toxic", "text").mapInArrow(run, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _nats(toxic: float, clean: float, share: float) -> float:
    """How unlikely so lopsided counts are if the feature meant nothing."""
    n = toxic + clean
    p = toxic / n
    if p <= share:
        return 0.0
    return toxic * math.log(p / share) + (clean * math.log((1 - p) / (1 - share)) if clean else 0.0)


def seeds() -> dict[str, float]:
    return dict.fromkeys(SEEDS, SEED_WEIGHT)


def _places(labelled: DataFrame, wanted: list[str]) -> dict[str, tuple[int, int]]:
    """In how many different places, clean and toxic, each of ``wanted`` stands, counted exactly."""
    shared = labelled.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held = {x: 2 * i << PLACE_BITS for i, x in enumerate(shared.value)}, array("q")

        def out() -> pa.RecordBatch:
            keys = np.unique(np.array(held, np.int64))
            del held[:]
            return pa.RecordBatch.from_arrays([pa.array(keys)], names=["key"])

        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for feature, place in _grams(WORDS.findall(text.as_py().lower())):
                    if (own := first.get(feature)) is not None:
                        held.append(own | toxic << PLACE_BITS | place)
                if len(held) > HELD_PLACES:
                    yield out()
        yield out()

    at = labelled.select("toxic", "text").mapInArrow(run, "key long").distinct()
    counted = at.groupBy(F.shiftright("key", PLACE_BITS).alias("own")).count().toPandas()
    found = np.zeros((len(wanted), 2), np.int64)
    found.reshape(-1)[counted["own"].to_numpy(np.int64)] = counted["count"].to_numpy(np.int64)
    return {x: (int(c), int(t)) for x, (c, t) in zip(wanted, found, strict=True) if c or t}


def learn(labelled: DataFrame) -> Scorer:
    """The scorer of ``labelled``: ``text`` and ``toxic`` (0/1), of which none is null.

    Counting is distributed; the driver gets the features that pass the test,
    the longer forms of those that then are insults, no more than the sample
    has words, and the marks of the sampled texts, a small vector each. Copies
    of a text would lend their words weight, so what counts in the end are
    different places, by the words before and after. Without texts of both
    labels the seeds stand.
    """
    sizes = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Scorer(seeds())
    context = labelled.sparkSession.sparkContext
    share = sizes[1] / (sizes[0] + sizes[1])
    run = Scratch(labelled.sparkSession, "toxicity-counts")
    counts = run(_counts(labelled), "counts")
    prior = math.log(share / (1 - share))

    def weighed(names: list[str]) -> dict[str, tuple[float, bool]]:
        """The log-odds of each, and whether its counts are no accident."""
        places = _places(labelled, names) if names else {}
        return {x: (math.log((toxic + 0.5) / (clean + 0.5)) - prior, toxic >= LEAST_PLACES and _nats(toxic, clean, share) >= LEAST_NATS) for x, (clean, toxic) in places.items()}

    lopsided = (F.col("toxic") >= LEAST_PLACES) & (F.col("toxic") > 2 * share / (1 - share) * (F.col("clean") + 1))
    insults = {x: w for x, (w, sure) in weighed(counts.where(lopsided).select("feature").toPandas()["feature"].to_list()).items() if sure and w >= LEAST_WEIGHT}
    stems = {k: sorted(x[:k] for x in insults if x.endswith("*") and len(x) == k + 1) for k in STEMS}
    extends = F.lit(False)
    for k, own in stems.items():
        extends = extends | (F.substring("feature", 1, k).isin(own) if own else F.lit(False))
    longer = counts.where((F.col("toxic") + F.col("clean") >= 2) & extends).select("feature").toPandas()["feature"].to_list()
    run.remove()
    insults |= {x: w for x, (w, sure) in weighed([x for x in longer if x not in insults]).items() if sure or w < LEAST_WEIGHT}
    if not any(w >= LEAST_WEIGHT for w in insults.values()):
        return Scorer(seeds())

    model = context.broadcast(insults)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(model.value)
        sums: dict[tuple, int] = defaultdict(int)
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[toxic, *own.marks(text.as_py())] += 1
        keys = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([list(k[1:]) for k in keys], pa.list_(pa.float64())), pa.array([sums[k] for k in keys], pa.int64())], names=["toxic", "marks", "n"])

    rows = labelled.select("toxic", "text").mapInArrow(marks, "toxic int, marks array<double>, n long").groupBy("toxic", "marks").agg(F.sum("n").alias("n")).collect()
    rows = sorted(rows, key=lambda r: (r["toxic"], r["marks"]))
    x = np.repeat(features(np.array([r["marks"] for r in rows])), [r["n"] for r in rows], axis=0)
    y = np.repeat([r["toxic"] for r in rows], [r["n"] for r in rows])
    return Scorer(insults, logistic(x, y.astype(float)))


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, folds: int = 5, held: int = 0) -> Scorer:
    """The scorer learned from labelled documents outside fold ``held``.

    A hash of the id chooses ``fit_docs`` labels in expectation, toxic ones
    first: they may be half. Only those labels are broadcast, and only their
    texts are written to the shared folder, to be read in every step.
    """
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.where((F.col("toxic").isin(0, 1)) & (fold_of(F.col("doc_id"), folds) != held))
    sizes = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    toxic = min(sizes.get(1, 0), fit_docs // 2)
    wanted = {1: toxic, 0: fit_docs - toxic}
    share = F.lit(0)
    for label, n in wanted.items():
        share = F.when(F.col("toxic") == label, int(1e6 * min(1.0, n / max(1, sizes.get(label, 0))))).otherwise(share)
    chosen = own.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_000)) < share)
    texts = docs.where("text IS NOT NULL").select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    texts = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # one text for each id
    with Scratch(docs.sparkSession, "toxicity-fit") as run:
        return learn(run(texts.select("toxic", "text"), "texts"))


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, folds: int = 5, held: int = 0) -> DataFrame:
    """One row for each document: ``doc_id``, ``held_out``, ``score``, ``predicted``, ``marks``.

    ``marks`` has the greatest weight of an insult, then the sums of weights
    by mark in the order of ``MARKS``. Null and
    empty texts have no marks and get the score of that. Labels that are null,
    neither 0 nor 1, or of unknown documents are ignored; of several labels of
    a document the larger counts. Null doc_ids count as empty text in the fold;
    repeated rows stay; extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    model = fit(docs, labels, fit_docs, folds, held)
    shared = spark.sparkContext.broadcast((model.insults, model.weights))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (fold_of(docs["doc_id"], folds) == held).alias("held_out"), docs["text"].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            marks = [scorer.marks(t.as_py()) for t in batch.column(2)]
            scores = scorer.scores(np.array(marks).reshape(-1, 1 + len(MARKS)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32()), pa.array([list(m) for m in marks], pa.list_(pa.float64()))],
                names=["doc_id", "held_out", "score", "predicted", "marks"],
            )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, marks array<double>")


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without those that are predicted toxic, all columns and types as they are.

    Null, empty and blank texts have no marks and stay unless the learned bias
    alone rejects; repeated rows stay or go together; labels are read as
    ``score_toxicity`` reads them, so an empty table of labels leaves the seeds.
    Extra columns, whatever their names, pass through; an empty table stays
    empty; a text of any length is read whole.
    """
    model = fit(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast((model.insults, model.weights))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t.as_py()) < 0.5 for t in batch.column(at)], pa.bool_()))

    plain = numbered(docs)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
