"""The mix against a plain loop."""

import random

import pytest

from tallyguard.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), epochs=3):
    """Share, cut at the limit, share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, rest, live = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    while rest > 1e-9 and live:
        share = rest / sum(weight[s] for s in live)
        rest = 0.0
        for s in list(live):
            target[s] += share * weight[s]
            if target[s] >= epochs * sizes[s]:
                rest += target[s] - epochs * sizes[s]
                target[s] = float(epochs * sizes[s])
                live.discard(s)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_taken(spark, seed):
    rng = random.Random(seed)
    sources = ["a", "b", "c", "d", None, "é"][: 2 + seed]
    rows = [(i, " ".join("w" for _ in range(rng.randrange(30))), rng.choice(sources)) for i in range(120)]
    rows += [(None, None, "zero"), (5, "x y", "a"), (5, "x y", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS key", "3 AS s")
    got = mixing.mix(df, range_digits=1).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want, taken = brute_targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert r.target == pytest.approx(want[r.source])
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for source, n in taken.items():
        assert want[source] - 1 <= n <= want[source] + 1e-6
    assert sorted(map(str, mixing.mix(df, range_digits=1).collect())) == sorted(map(str, got))


def test_applied(spark):
    rows = [(1, "a  b c", 6, "s"), (2, "d e\nf g", 7, "t"), (3, "", 0, "s"), (4, "h i j k l m n o p", 17, "u"), (4, "h i j k l m n o p", 17, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, source string")
    plan, out = mixing.mix(df).collect(), mixing.apply_mix(df).collect()
    assert sum(len(r.text.split()) for r in out) == sum(r.taken for r in plan)
    texts = {r[0]: r[1] for r in rows}
    assert all(texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in out)
    assert out[0].asDict().keys() == {"doc_id", "text", "n_chars", "source"}
    assert mixing.apply_mix(df.limit(0)).count() == 0
    assert mixing.mix(df.where("text = ''")).first().target == 0


def test_applied_with_repeats_nulls_and_clashing_columns(spark):
    """A repeated row is most of a source; what comes out is what the plan says, word for word."""
    rows = [(7, "q w e r t", None, 1, "p")] * 300 + [(None, "a b", "s", 2, None), (1, None, "s", 3, "k"), (2, " \n", None, None, None), (3, "z " * 500_000, "s", 4, "n"), (4, "u v", "t", 5, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, place string").repartition(4)
    for digits in (1, 3):
        plan, out = mixing.mix(df, range_digits=digits).collect(), mixing.apply_mix(df, range_digits=digits)
        assert out.dtypes == df.dtypes
        took, words = {}, {}
        for r in plan:
            took[r.doc_id] = took.get(r.doc_id, 0) + r.taken
        found = out.collect()
        for r in found:
            words[r.doc_id] = words.get(r.doc_id, 0) + len((r.text or "").split())
        assert {k: n for k, n in took.items() if n} == {k: n for k, n in words.items() if n}
        assert sum(r.doc_id == 1 for r in found) == sum(r.doc_id == 2 for r in found) == 1
    assert mixing.apply_mix(df.limit(0)).count() == 0


def test_one_repeated_row_in_the_last_range(spark):
    rows = [(1, "a b c", "x")] * 70_000 + [(2, "d " * 50_000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix(df).groupBy("source").agg({"taken": "sum", "size": "count"}).collect()
    assert {r["source"]: r["count(size)"] for r in got} == {"x": 70_000, "y": 1}
    want = brute_targets({"x": 210_000, "y": 50_000})
    assert all(abs(r["sum(taken)"] - want[r["source"]]) <= 1 for r in got)
