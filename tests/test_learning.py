"""Learned rules: the fold by hand, ranges against one pass, and batch against stream."""

import datetime
import random

from tallyguard.operators import learning as L
from tallyguard.streaming import registry as T

SCHEMA = "feedback_id long, created_at timestamp, part int, rule_type string, pattern string, op string"


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def by_hand(rows):
    rules = {}
    for _, when, _, rule_type, pattern, op in sorted(rows, key=lambda r: (r[1], r[0], r[2])):
        state, n, born, _ = rules.get((rule_type, pattern), (None, 0, None, None))
        new, counted = L.step(state, op, rule_type)
        rules[rule_type, pattern] = (new, n + counted, when if state is None and new is not None else born, when)
    return {k: (*s, n, born, last) for k, (s, n, born, last) in rules.items() if s is not None}


def collected(df):
    return {(r.rule_type, r.pattern): (r.adjustment_c, r.enabled, r.white, r.learned_from, r.first_seen, r.last_seen) for r in df.collect()}


def test_steps():
    def run(rule_type, *ops):
        state, n = None, 0
        for op in ops:
            state, more = L.step(state, op, rule_type)
            n += more
        return state, n

    software, user = "suspicious_software", "user_identified_pattern"
    assert run(software, "lower", "confirm") == (None, 0)
    assert run(software, "raise", "raise") == ((25, True, False), 2)
    assert run(software, *["raise"] * 9) == ((50, True, False), 9)
    assert run(software, "raise", "lower", "lower", "lower") == ((5, True, False), 4)
    assert run(software, "raise", "lower", "lower", "lower", "lower") == ((5, False, False), 4)  # at five it is switched off
    assert run(software, "raise", "lower", "lower", "lower", "lower", "raise") == ((10, False, False), 5)  # and stays off
    assert run(user, "raise", "belie", "belie") == ((0, False, False), 1)
    assert run(user, "belie") == ((-10, True, True), 1)
    assert run(user, "belie", "confirm") == ((-8, True, True), 2)
    assert run(user, "belie", "belie") == ((0, False, True), 1)
    assert run(user, "belie", "belie", "raise") == ((15, True, False), 2)
    assert run("merchant_pattern", "raise", "raise") == ((0, True, False), 2)
    assert run("spacing_threshold", "raise", "raise") == ((18, True, False), 2)
    assert run("date_manipulation", "raise", "raise") == ((28, True, False), 2)


def test_every_state_stays_among_the_states():
    after, _ = L.tables()
    assert after.min() == 0
    assert after.max() < len(L.STATES)


def test_indicators(spark):
    cases = [
        ("Spacing anomalies in total", "spacing_anomaly"), ("Invalid PHONE", "invalid_phone"), ("no address", "invalid_address"), ("Suspicious merchant name: ABC Corp", "name"),
        ("merchant: ABC Corp!", "ABC Corp"), ("odd merchant", "suspicious_merchant"), ("Software: Canva", "Canva"), ("pdf", "suspicious_software"), ("bad date", "date_manipulation"), ("x" * 60, "x" * 50), ("", None), (None, None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i long, t string")
    assert [r[0] for r in df.orderBy("i").select(L.indicator_pattern(L.F.col("t"))).collect()] == [w for _, w in cases]


def test_arrivals(spark):
    schema = "feedback_id long, created_at timestamp, system_verdict string, correct_verdict string, software_detected string, software_flagged boolean, has_spacing_issue boolean, has_date_issue boolean, missed_indicators array<string>, confirmed_indicators array<string>, false_indicators array<string>, corrected_merchant string"
    rows = [
        (1, at(0), "real", "fake", "Canva", True, True, True, ["odd phone", "odd phone", None, ""], None, [], None),
        (2, at(1), "fake", "real", "Canva", True, True, True, None, ["a date"], ["a date: no: really"], "M" * 60),
        (3, at(2), "fake", "real", "Canva", None, None, None, None, None, None, ""),
        (4, at(3), None, None, None, None, None, None, None, None, None, None),
    ]
    found = [(r.feedback_id, r.rule_type, r.pattern, r.op) for r in L.arrivals(spark.createDataFrame(rows, schema)).orderBy("feedback_id", "part").collect()]
    user = "user_identified_pattern"
    assert found == [
        (1, "suspicious_software", "Canva", "raise"), (1, "spacing_threshold", "consecutive_spaces", "raise"), (1, "date_manipulation", "creation_after_receipt", "raise"),
        (1, user, "invalid_phone", "raise"), (1, user, "invalid_phone", "raise"),
        (2, "suspicious_software", "Canva", "lower"), (2, user, "date_manipulation", "confirm"), (2, "merchant_pattern", "M" * 50, "raise"), (2, user, "date_manipulation", "belie"),
    ]


def some(n, seed):
    draw = random.Random(seed)
    types = [draw.choice(L.TYPES) for _ in range(n)]
    # one rule has most of the arrivals; times tie often
    return [(i, at(draw.randrange(n // 3)), draw.randrange(3), t, "hot" if draw.random() < 0.6 else f"p{draw.randrange(20)}", draw.choice(L.OPS)) for i, t in enumerate(types)]


def test_ranges_compose_to_one_pass(spark):
    rows = some(3000, 5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert collected(L.learn(df)) == by_hand(rows)
    assert L.learn(df.where("false")).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = sorted(some(900, 6), key=lambda r: r[1])
    cuts = [0, next(i for i, r in enumerate(rows) if r[1] >= rows[300][1]), next(i for i, r in enumerate(rows) if r[1] >= rows[600][1]), len(rows)]
    at_path = f"{tmp_path}/in"
    for lo, hi in zip(cuts, cuts[1:]):
        spark.createDataFrame(rows[lo:hi], SCHEMA).coalesce(1).write.mode("append").parquet(at_path)
        T.drained(L.learn_stream(T.files(spark, at_path, spark.createDataFrame([], SCHEMA).schema)), f"{tmp_path}/out", f"{tmp_path}/check")
    out = spark.read.parquet(f"{tmp_path}/out")
    newest = out.groupBy("rule_type", "pattern").agg(L.F.max_by(L.F.struct(*out.columns), "version").alias("r")).select("r.*")
    assert newest.agg(L.F.max("version")).first()[0] == 3
    assert collected(newest) == by_hand(rows)


def test_a_batch_comes_to_the_state_as_bytes(spark):
    """One row for each rule and range of time, however many arrivals, with the ops in order and the time of the first that makes a rule."""
    rows = [(i, at(i // 3), 2 - i % 3, "merchant_pattern", "hot" if i % 50 else "cold", "confirm" if i < 900 else L.OPS[i % 4]) for i in range(2000)] + [(5000, None, 0, "merchant_pattern", "hot", "raise")]
    found = L.packed(spark.createDataFrame(rows, SCHEMA).repartition(5)).orderBy("pattern", "run").collect()
    assert len(found) <= 2 * L.RANGES
    for pattern in ("hot", "cold"):
        mine = sorted((r for r in rows if r[4] == pattern), key=lambda r: (r[1] is None, r[1] or at(0), r[0], r[2]))
        runs = [r for r in found if r.pattern == pattern]
        assert [L.OPS[o] for r in runs for o in r.ops] == [r[5] for r in mine]
        n = 0
        for r in runs:
            part = mine[n : n + len(r.ops)]
            n += len(r.ops)
            assert r.born == next((x[1] for x in part if x[5] in ("raise", "belie")), None)
            assert r.last == part[-1][1]
