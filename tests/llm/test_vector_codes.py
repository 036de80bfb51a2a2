"""Codes against plain loops in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tallyguard.llm import vector_codes as vc


def brute(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, vector, label)."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    each = len(kept[0][1]) // parts
    x = [[[math.floor(4096 * c) for c in r[1][p * each : (p + 1) * each]] for p in range(parts)] for r in kept]
    books = [[list(x[i][p]) for i in range(min(entries, len(x)))] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            where = [near(v[p], books[p])[1] for v in x]
            for k in range(len(books[p])):
                own = [v[p] for v, w in zip(x, where, strict=True) if w == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = [[near(v[p], books[p]) for p in range(parts)] for v in x]
    error, by = [sum(d for d, _ in f) for f in last], {}
    for r, e in zip(kept, error, strict=True):
        by[r[2]] = by.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(r[0], "".join(f"{k:02x}" for _, k in f), e, by[r[2]], digest) for r, f, e in zip(kept, last, error, strict=True)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, error int, `a.b` string")


@pytest.mark.parametrize("n,d", [(3, 8), (90, 24), (200, 40)])
def test_rows_by_brute_force(spark, n, d):
    rng = random.Random(n)
    rows = [(i, [rng.choice([rng.gauss(0, 1), 0.25, -0.25]) for _ in range(d)], rng.choice([None, 1, 2])) for i in rng.sample(range(1000), n)]
    rows += [rows[0], (rows[1][0], rows[2][1], 2), (None, rows[1][1], 1), (5000, None, 1), (5001, [], 1), (5002, [None] + [0.0] * (d - 1), 1), (5003, [float("nan")] * d, 1), (5004, [float("inf")] + [0.0] * (d - 1), None)]
    found = vc.encode(frame(spark, rows).repartition(4)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(brute(rows), key=str)


def test_odd_lengths_and_no_rows(spark):
    rows = [(1, [0.5] * 10, 1), (2, [0.25] * 10, 1), (3, [0.5] * 9, 1)]
    assert sorted(r.vec_id for r in vc.encode(frame(spark, rows)).collect()) == [1, 2]
    for empty in ([], [(1, None, 1)]):
        assert vc.encode(frame(spark, empty)).count() == 0


def test_great_components_stay_in_a_long(spark):
    rows = [(i, [(-1) ** (i + k) * 1e300 for k in range(64)], 1) for i in range(20)] + [(99, [-3e4] * 64, 1)]
    assert all(r.error >= 0 for r in vc.encode(frame(spark, rows), entries=1).collect())


def test_transform_is_exact_and_by_sequency():
    h = vc.hadamard(16)
    assert (h @ h.T == 16 * np.eye(16)).all()
    assert ((np.diff(h, axis=1) != 0).sum(1) == np.arange(16)).all()
    rng = np.random.default_rng(2)
    for width in (1, 5, 8):
        a, b = rng.integers(-9, 9, (300, width)), rng.integers(-9, 9, (16, width))
        entry, d = vc.nearest(vc.transformed(a), vc.transformed(b))
        plain = ((a[:, None] - b[None]) ** 2).sum(2)
        assert (entry == plain.argmin(1)).all() and (d == plain.min(1)).all()
    for width in (8, 64, 1000):
        each = 1 << max(0, -(-width // 8) - 1).bit_length()
        assert 8 * each * (2 * vc.limit(width)) ** 2 < 1 << 63 and each * each * (2 * vc.limit(width)) ** 2 < 1 << 63
