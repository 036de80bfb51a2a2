"""The join against all pairs of a small fixture."""

import random

from pyspark.sql import functions as F

from tallyguard.llm import jaccard


def sets(text):
    words = (text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    grams = [sets(t) for _, t in rows]
    n = len(rows)
    near = [[i != j and grams[i] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]) for j in range(n)] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            root[i] = min([root[i], *(root[j] for j in range(n) if near[i][j])])
    return [(rows[i][0], min(rows[j][0] for j in range(n) if root[j] == root[i]), sum(map(bool, near[i]))) for i in range(n)]


def fixture():
    rng = random.Random(9)
    rows = []

    def add(words):
        rows.append((len(rows), " ".join(words)))

    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(3, 90))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
            add(copy)
        add(base)
        add(base)
    rows += [(len(rows) + i, t) for i, t in enumerate(["", None, " \n", "one two", "one  two"])]
    return rows


def check(spark, **options):
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.lit(1)).withColumn("grp", F.lit(2))
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(df, recall=0.999999, **options).collect())
    assert got == brute(rows)


def test_all_pairs(spark):
    check(spark)


def test_split_groups(spark):
    check(spark, block_docs=2, block_grams=10_000)


def test_keep_first_and_edges(spark):
    df = spark.createDataFrame(
        [(3, "a b c d e f", 11, "x"), (1, "a b c d e f", 11, "y"), (1, "a b c d e f", 11, "y"), (None, "g h", 3, "z"), (4, None, None, "z"), (5, "", 0, "z")],
        "doc_id long, text string, n_chars long, source string",
    )
    kept = jaccard.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "None"]
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def test_bands_reach_the_recall():
    for rows in range(1, 9):
        bands = jaccard.bands_for(0.8, 0.9999, rows)
        assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 > 1 - (1 - 0.8**rows) ** (bands - 1)


def chains():
    """Windows over one long word sequence: near in the sequence is near in n-grams, so links chain one large group together."""
    words = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 60])) for i in range(100)]
    return rows + [(100 + i, t) for i, (_, t) in enumerate(rows[::7])]


def test_chained_groups_by_bucket(spark):
    rows = chains()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (8, 128):
        got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(df, recall=0.999999, block_docs=block).collect())
        assert got == brute(rows)


def test_keep_first_with_clashing_columns(spark):
    long = " ".join(f"l{i % 7001}" for i in range(150_000))
    rows = [(1, long, "k", 1, "r"), (2, long + " end", "k", 2, "r"), (3, None, None, None, None), (3, None, None, None, None), (None, "x y", "k", 3, "r"), (None, "x y", "k", 3, "r"), (4, " ", "k", 4, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, __key int, __row string")
    kept = jaccard.keep_first(df)
    assert kept.dtypes == df.dtypes
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "3", "4", "None"]
    assert jaccard.keep_first(df.limit(0)).count() == 0
