"""Rules learned from feedback: an ordered fold over the arrivals of each rule, in batch and as a stream.

A rule is a type and a pattern with an adjustment in hundredths. Arrivals raise, lower, confirm or belie it, and as
limits and switches are met on the way, their order counts. A rule has few states, so a run of arrivals is a table from
the state before it to the state after it, and tables of neighbouring runs compose. The batch form cuts all arrivals
into ranges of time, folds each range by itself and composes the ranges' tables: a rule with most of the arrivals is
spread over all tasks like any other.

A confirmed or false indicator speaks of the users' pattern equal to its own. A false one without a rule makes an entry
that lowers the score (``white``); a later miss of that pattern turns the entry into a rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .feedback import kind

# Start and gain of each type, and what other arrivals change, in hundredths.
STARTS = {"suspicious_software": (20, 5), "spacing_threshold": (15, 3), "date_manipulation": (25, 3), "user_identified_pattern": (15, 3), "merchant_pattern": (0, 0)}
MOST, CONFIRMED, BELIED, LOWERED, WHITE = 50, 2, 8, 5, -10
TYPES = tuple(STARTS)
OPS = ("raise", "lower", "confirm", "belie")
PATTERN_CHARS = 50

#: adjustment, enabled, white
State = tuple[int, bool, bool]
OUT = "rule_type string, pattern string, adjustment_c int, enabled boolean, white boolean, learned_from long, first_seen timestamp, last_seen timestamp"


def step(state: State | None, op: str, rule_type: str) -> tuple[State | None, int]:
    """The state after an arrival, and whether the arrival counts among those the rule was learned from."""
    start, gain = STARTS[rule_type]
    if state is None:
        return ((start, True, False), 1) if op == "raise" else ((WHITE, True, True), 1) if op == "belie" else (None, 0)
    value, on, white = state
    if op == "raise":
        return ((start, True, False) if white else (min(MOST, value + gain), on, white)), 1
    if op == "confirm":
        return (min(MOST, value + CONFIRMED), on, white), 1
    if op == "belie":
        left = max(0, value - BELIED)
        return (left, on and left > 0, white), 0
    return ((max(0, value - LOWERED), on, white), 1) if value > LOWERED else ((value, False, white), 0)


STATES: list[State | None] = [None] + [(v, on, white) for v in range(WHITE, MOST + 1) for on in (True, False) for white in (True, False)]
_INDEX = {s: i for i, s in enumerate(STATES)}


def tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and count for (type, op, state)."""
    after = np.zeros((len(TYPES), len(OPS), len(STATES)), np.int16)
    counts = np.zeros(after.shape, np.int64)
    for t, rule_type in enumerate(TYPES):
        for o, op in enumerate(OPS):
            for i, state in enumerate(STATES):
                new, counts[t, o, i] = step(state, op, rule_type)
                after[t, o, i] = _INDEX[new]
    return after, counts


def indicator_pattern(indicator: Column) -> Column:
    """The pattern that an indicator's description stands for; null of an empty one."""
    lower = F.lower(indicator)
    named = F.trim(F.regexp_extract(indicator, r"(?i)merchant[:\s]+([A-Za-z0-9\s]+)", 1))
    software = F.trim(F.regexp_extract(indicator, r"[:\s]+([A-Za-z0-9]+)", 1))
    return F.nullif(
        F.when(lower.contains("spacing"), "spacing_anomaly").when(lower.contains("phone"), "invalid_phone").when(lower.contains("address"), "invalid_address")
        .when(lower.contains("merchant"), F.when(indicator.rlike(r"(?i)merchant[:\s]+[A-Za-z0-9\s]"), named).otherwise("suspicious_merchant"))
        .when(lower.contains("software") | lower.contains("pdf"), F.when(software != "", software).otherwise("suspicious_software"))
        .when(lower.contains("date"), "date_manipulation").otherwise(F.substring(indicator, 1, PATTERN_CHARS)),
        F.lit(""),
    )


def arrivals(feedback: DataFrame) -> DataFrame:
    """What feedback says of rules: rule_type, pattern, op, created_at, feedback_id and ``part``, the order within one.

    ``feedback`` has ``software_detected``, ``software_flagged``, ``has_spacing_issue``, ``has_date_issue``, the arrays
    ``missed_indicators``, ``confirmed_indicators`` and ``false_indicators``, and ``corrected_merchant``. Nulls say nothing.
    """
    wrong = kind(F.col("system_verdict"), F.col("correct_verdict"))
    missed, alarm = wrong == "false_negative", wrong == "false_positive"

    def one(when: Column, rule_type: str, pattern: Column, op: str) -> Column:
        return F.array(F.when(when & (pattern != ""), F.struct(F.lit(rule_type).alias("rule_type"), pattern.alias("pattern"), F.lit(op).alias("op"))))

    def each(array: str, op: str, short: bool = False) -> Column:
        text = (lambda x: F.trim(F.get(F.split(x, ":"), F.lit(0)))) if short else (lambda x: x)
        return F.transform(F.coalesce(F.col(array), F.array().cast("array<string>")), lambda x: one(F.lit(True), "user_identified_pattern", indicator_pattern(text(x)), op)[0])

    said = F.concat(
        one(missed, "suspicious_software", F.col("software_detected"), "raise"),
        one(missed & F.col("has_spacing_issue"), "spacing_threshold", F.lit("consecutive_spaces"), "raise"),
        one(missed & F.col("has_date_issue"), "date_manipulation", F.lit("creation_after_receipt"), "raise"),
        one(alarm & F.col("software_flagged"), "suspicious_software", F.col("software_detected"), "lower"),
        each("missed_indicators", "raise"), each("confirmed_indicators", "confirm"),
        one(F.lit(True), "merchant_pattern", F.substring("corrected_merchant", 1, PATTERN_CHARS), "raise"),
        each("false_indicators", "belie", short=True),
    )
    rows = feedback.select("feedback_id", F.col("created_at").cast("timestamp").alias("created_at"), F.posexplode(said).alias("part", "said"))
    return rows.where("said IS NOT NULL").select("feedback_id", "created_at", "part", "said.*")


_RUN = "rule_type string, pattern string, run int, after array<smallint>, counts array<long>, born timestamp, last timestamp"


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each rule's arrivals in one range of time, composed into one table: memory grows with the range's rules alone."""
    after, counts = tables()
    type_no, op_no = {t: i for i, t in enumerate(TYPES)}, {o: i for i, o in enumerate(OPS)}
    held: dict[tuple[str, str], list] = {}
    run = 0
    for rows in batches:
        for rule_type, pattern, op, at, run in zip(rows["rule_type"], rows["pattern"], rows["op"], rows["created_at"], rows["run"]):  # noqa: B905  columns of one frame
            t, o = type_no[rule_type], op_no[op]
            rule = held.get((rule_type, pattern))
            if rule is None:
                rule = held[rule_type, pattern] = [np.arange(len(STATES)), np.zeros(len(STATES), np.int64), None, None]
            if rule[0][0] == 0 and after[t, o, 0] != 0:
                rule[2] = at
            rule[1] += counts[t, o, rule[0]]
            rule[0] = after[t, o, rule[0]]
            rule[3] = at
    for (rule_type, pattern), (now, n, born, last) in held.items():
        yield pd.DataFrame({"rule_type": [rule_type], "pattern": [pattern], "run": [run], "after": [now], "counts": [n], "born": [born], "last": [last]})


def learn(said: DataFrame) -> DataFrame:
    """The rules after all ``arrivals``: one row each, with the columns of ``OUT``; ties in time go by id, then part."""
    order = ("created_at", "feedback_id", "part")
    ranges = said.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("run", F.spark_partition_id())
    runs = ranges.select("rule_type", "pattern", "op", "created_at", "run").mapInPandas(_runs, _RUN)
    # a rule has one row for each range at most
    per = runs.groupBy("rule_type", "pattern").agg(F.array_sort(F.collect_list(F.struct("run", "after", "counts", "born", "last"))).alias("runs"))
    zero = F.struct(F.lit(0).cast("smallint").alias("s"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("timestamp").alias("born"), F.lit(None).cast("timestamp").alias("last"))
    end = F.aggregate("runs", zero, lambda a, r: F.struct(
        F.get(r["after"], a["s"].cast("int")).alias("s"), (a["n"] + F.get(r["counts"], a["s"].cast("int"))).alias("n"),
        F.when(a["s"] == 0, r["born"]).otherwise(a["born"]).alias("born"), r["last"].alias("last"),
    ))
    known = F.array(*(F.struct(F.lit(v).alias("value"), F.lit(on).alias("on"), F.lit(w).alias("white")) for v, on, w in STATES[1:]))
    ended = per.select("rule_type", "pattern", end.alias("e")).where("e.s > 0").withColumn("at", F.get(known, F.col("e.s").cast("int") - 1))
    return ended.select(
        "rule_type", "pattern", F.col("at.value").alias("adjustment_c"), F.col("at.on").alias("enabled"), F.col("at.white").alias("white"),
        F.col("e.n").alias("learned_from"), F.col("e.born").alias("first_seen"), F.col("e.last").alias("last_seen"),
    )


#: Ranges of time that a batch of a stream is cut into: a stream cannot sort, so a task holds a range's arrivals, as numbers, to order them.
RANGES = 64
_PACKED = "rule_type string, pattern string, run int, ops binary, born timestamp, last timestamp"


def _coded(texts: pa.Array, known: dict[str, int]) -> np.ndarray:
    """A number for each text; new ones are added to ``known``."""
    found = texts.dictionary_encode()
    return np.array([known.setdefault(x, len(known)) for x in found.dictionary.to_pylist()], np.int64)[found.indices.to_numpy()]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each rule's arrivals in one range of time: their ops in order, a byte each, the time of the first that can make a rule, and of the last."""
    types, ops, patterns = {t: i for i, t in enumerate(TYPES)}, {o: i for i, o in enumerate(OPS)}, {}
    held, times, run = [], [], 0
    for b in batches:
        if b.num_rows:
            at, ids = (b.column(c).cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy() for c in ("created_at", "feedback_id"))
            rule = _coded(b.column("pattern"), patterns) * len(TYPES) + _coded(b.column("rule_type"), types)
            held.append((_coded(b.column("op"), ops).astype(np.int8), b.column("part").to_numpy(), ids, at, rule))
            times.append(b.column("created_at"))
            run = b.column("run")[0].as_py()
    if not held:
        return
    op, part, ids, at, rule = (np.concatenate(x) for x in zip(*held))  # noqa: B905  columns of one range
    order = np.lexsort((part, ids, at, rule))
    op, rule, of, names = op[order], rule[order], pa.chunked_array(times), list(patterns)
    makes = np.append(np.flatnonzero((op == ops["raise"]) | (op == ops["belie"])), len(op))
    starts = np.flatnonzero(np.diff(rule, prepend=-1))
    ends = np.append(starts[1:], len(op))
    makers = makes[np.searchsorted(makes, starts)]
    born = pa.array(order[np.minimum(makers, len(op) - 1)], mask=makers >= ends)
    yield pa.RecordBatch.from_arrays([
        pa.array([TYPES[r % len(TYPES)] for r in rule[starts]]), pa.array([names[r // len(TYPES)] for r in rule[starts]]), pa.array([run] * len(starts), pa.int32()),
        pa.array([op[lo:hi].tobytes() for lo, hi in zip(starts, ends, strict=True)], pa.binary()), of.take(born).combine_chunks(), of.take(pa.array(order[ends - 1])).combine_chunks(),
    ], names=["rule_type", "pattern", "run", "ops", "born", "last"])


def packed(said: DataFrame) -> DataFrame:
    """One row for each rule and range of time, of a table or of each batch of a stream; runs of ops follow each other as ``run`` does."""
    ranges = said.repartitionByRange(RANGES, *(F.col(c).asc_nulls_last() for c in ("created_at", "feedback_id", "part")))
    return ranges.withColumn("run", F.spark_partition_id()).mapInArrow(_pack, _PACKED)


def learn_stream(said: DataFrame) -> DataFrame:
    """The same fold over a stream: after each batch the rules that it touched come out, with ``version``, the batches so far.

    Batches are taken in the order in which they come; within one, arrivals go by time, id and part. State is one row
    for each rule and does not expire. A rule's arrivals come to its state as ``packed``: a byte each, not a row.
    """
    state_of = "value int, enabled boolean, white boolean, n long, born timestamp, version long"
    after, counts = (dict(zip(TYPES, x.tolist(), strict=True)) for x in tables())

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rule_type, pattern = key
        value, on, white, n, born, version = state.get if state.exists else (None, None, None, 0, None, 0)
        now = 0 if value is None else _INDEX[value, on, white]
        then, count = after[rule_type], counts[rule_type]
        last = None
        for ops, at, last in pd.concat(list(batches)).sort_values("run")[["ops", "born", "last"]].itertuples(index=False):  # noqa: B007  the last is used
            born = at if now == 0 else born
            for op in ops:
                n += count[op][now]
                now = then[op][now]
        if now == 0:
            return
        value, on, white = STATES[now]
        born, last = (None if pd.isna(x) else x for x in (born, last))
        state.update((value, on, white, n, born, version + 1))
        yield pd.DataFrame({
            "rule_type": [rule_type], "pattern": [pattern], "adjustment_c": [value], "enabled": [on], "white": [white],
            "learned_from": [n], "first_seen": [born], "last_seen": [last], "version": [version + 1],
        })

    return packed(said).groupBy("rule_type", "pattern").applyInPandasWithState(fold, OUT + ", version long", state_of, "append", GroupStateTimeout.NoTimeout)
