"""The grammar by example, and held-out accuracy."""

import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyguard.llm import toxicity as t

DATA = "/root/testdata/sf0.1"


def marks(text):
    found = t.Scorer(t.seeds() | {"blöd*": t.SEED_WEIGHT, "blödel*": 0.0}).marks(text)
    return {k: int(v / t.SEED_WEIGHT) for k, v in zip(t.MARKS, found[1:], strict=True) if v}


def test_grammar():
    assert marks("what an idiot") == {"insult": 1}
    assert marks("you are an idiot") == {"insult+target": 1}
    assert marks("he is not an idiot. moron!") == {"insult+negated": 1, "insult": 1}
    assert marks("not today, but an idiot") == {"insult": 1}
    assert marks("they said idiot") == {"insult+reported": 1}
    assert marks("reported as trash") == {"insult+reported": 1}
    assert marks("he said it was late, but you idiot") == {"insult+target": 1}
    assert marks("said one two three four five six seven eight trash") == {"insult": 1}
    assert marks("idiot, you are") == {"insult": 1, "insult+target": 1}
    assert marks("an idiot came to see you") == {"insult": 1}
    assert marks("Blödsinn und idiotisch, blödeln") == {"insult": 1}
    assert marks("") == marks(None) == marks(" ,,, ") == {}


def test_threats():
    aimed = {"threat": 1, "threat+target": 1}
    for text in ("I am going to kill you", "i will hurt you", "I'll beat you", "someone should really hurt him", "we must destroy them"):
        assert marks(text) == aimed, text
    for text in ("ich werde dich töten", "je vais te tuer", "ich werde ihn nicht mehr sehen, ich muss dich schlagen"):
        assert marks(text) == {"threat+target": 1}, text
    assert marks("te voy a matar") == {"threat": 1}
    assert marks("we will kill the process") == {"threat": 1}
    assert marks("i will not hurt you") == {"threat+negated": 2}
    assert marks("you hurt my knee, the war will end") == {}
    seeded = t.Scorer(t.seeds())
    assert seeded.score("I am going to kill you") > 0.5 > seeded.score("the pump will not kill the engine")


def test_composition_agrees_with_one_after_the_other():
    a = t.Transducer({(0, "x"): (1, "y"), (1, "x"): (0, None)})
    b = t.Transducer({(0, "y"): (1, "z"), (1, "y"): (1, None), (1, "x"): (0, "w")})
    both = a.compose(b, "xyzw")
    for word in ("xxxx", "xyxyzx", "yyxx", "zxwxxy"):
        assert both(word) == b(a(word))


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "idiot you", "x"), (None, None, "y"), (2, "", "z"), (2, "fine day", "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (None, 1), (7, 1), (2, 5)], "doc_id long, toxic int")
    got = sorted((r.doc_id or -1, r.predicted) for r in t.score_toxicity(docs, labels).collect())
    assert got == [(-1, 0), (1, 1), (2, 0), (2, 0)]
    assert t.drop_toxic(docs, labels.limit(0)).count() == 3
    assert t.score_toxicity(docs.limit(0), labels).count() == 0


def test_places_are_counted_beyond_a_few_thousand(spark):
    def word(i):
        return "".join(chr(97 + i // 26**k % 26) for k in range(4))

    rows = [(1, f"{word(2 * i)} zork {word(2 * i + 1)}") for i in range(4000)] + [(0, f"{word(2 * i)} zork {word(2 * i + 1)}") for i in range(4000, 4200)]
    rows += [(1, "fine zork day")] * 50 + [(0, f"{word(2 * i)} hello {word(2 * i + 1)}") for i in range(5000, 8850)]
    model = t.learn(spark.createDataFrame(rows, "toxic int, text string").repartition(3))
    prior = math.log(4050 / 4050)
    assert model.insults["zork"] == pytest.approx(math.log(4001.5 / 200.5) - prior)
    assert model.score("you zork") > 0.5


def test_stage_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "you idiot", 1.5, "m"), (None, None, None, None), (2, "", 0.0, "n"), (2, "", 0.0, "n"), (3, "a fine day " * 200_000, 1.0, "o")], "doc_id long, text string, score double, marks string")
    labels = spark.createDataFrame([(3, 0)], "doc_id long, toxic int")
    kept = t.drop_toxic(docs, labels)
    assert kept.dtypes == docs.dtypes and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "2", "3", "None"]
    assert t.drop_toxic(docs.limit(0), labels).count() == 0


def test_learning_by_brute_force(spark):
    """Counts, places and weights as a loop over the texts finds them."""
    rng = random.Random(4)
    names = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 10))) for _ in range(150)]
    bad = ["zorkel", "zorkelt", "grimpf"]
    rows = []
    for i in range(500):
        words = rng.choices(names, k=rng.randrange(3, 15))
        toxic = int(i % 4 == 0)
        for w in bad:
            if rng.random() < (0.6 if toxic else 0.01):
                words.insert(rng.randrange(len(words)), w)
        rows.append((toxic, " ".join(words)))
    rows += rows[:40]
    model = t.learn(spark.createDataFrame(rows, "toxic int, text string").repartition(4))
    docs, places = [Counter(), Counter()], [defaultdict(set), defaultdict(set)]
    for toxic, text in rows:
        found = list(t._grams(t.WORDS.findall(text)))
        docs[toxic].update({x for x, _ in found})
        for x, place in found:
            places[toxic][x].add(place)
    share = sum(x for x, _ in rows) / len(rows)
    first = {x for x, n in docs[1].items() if n >= t.LEAST_PLACES and n > 2 * share / (1 - share) * (docs[0][x] + 1)}

    def weighed(x):
        bad_at, good_at = len(places[1][x]), len(places[0][x])
        weight = math.log((bad_at + 0.5) / (good_at + 0.5)) - math.log(share / (1 - share))
        return weight, bad_at >= t.LEAST_PLACES and t._nats(bad_at, good_at, share) >= t.LEAST_NATS

    want = {x: weighed(x)[0] for x in first if weighed(x)[1] and weighed(x)[0] >= t.LEAST_WEIGHT}
    stems = tuple(x[:-1] for x in want if x.endswith("*"))
    longer = {x for x in docs[0].keys() | docs[1].keys() if x.startswith(stems) and docs[0][x] + docs[1][x] >= 2} - want.keys()
    want |= {x: weighed(x)[0] for x in longer if weighed(x)[1] or weighed(x)[0] < t.LEAST_WEIGHT}
    assert {x for x in want if want[x] >= t.LEAST_WEIGHT} >= {"zorkel", "grimpf"}
    assert model.insults == pytest.approx(want)
    x = t.features(np.array([model.marks(text) for _, text in rows]))
    y = np.array([float(k) for k, _ in rows])
    p = model.scores(np.array([model.marks(text) for _, text in rows]))
    gradient = np.append((p - y).sum() + 1e-3 * model.weights[0], (x * (p - y)[:, None]).sum(0) + 0.5 * model.weights[1:])
    assert np.abs(gradient).max() < 1e-4  # the weights are the optimum


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
def test_held_out_precision_and_recall(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{x}.parquet") for x in ("documents", "labels"))
    scored = t.score_toxicity(docs, labels).join(labels.where("toxic IS NOT NULL"), "doc_id").where("held_out")
    hits, said, toxic = scored.agg(*(F.count_if(F.expr(x)) for x in ("toxic = 1 AND predicted = 1", "predicted = 1", "toxic = 1"))).first()
    print("held out: found", hits, "of", toxic, "said", said)
    assert toxic > 50 and hits >= 0.9 * toxic and hits >= 0.95 * said  # some labels are noise
