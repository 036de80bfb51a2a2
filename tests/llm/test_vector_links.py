"""Links of vectors against every pair."""

import numpy as np
import pytest

from tallyguard.llm import vector_links as vl


def brute(rows, threshold=0.93):
    """rows: (vec_id, vector, label)."""
    good = [r[1] is not None and len(r[1]) > 0 and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    near = [[] for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    near[i].append(j)
                    near[j].append(i)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        least = min(ids) if ids else None
        out.append((r[0], len(near[i]), least, least == r[0]))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(r[0], None if r[1] is None else [None if x is None else float(x) for x in r[1]], r[2], 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, kept int, `a.b` string")


def made(seed, n, d, groups, noise):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, d))
    rows = [(int(i), list(middles[rng.integers(groups)] * rng.uniform(0.5, 3) + rng.normal(size=d) * noise * rng.uniform(0, 1)), int(rng.integers(3))) for i in rng.permutation(n)]
    rows += [rows[0], rows[0], (n + 1, rows[1][1], None), (n + 2, None, 1), (n + 3, [], 1), (n + 4, [0.0] * d, 1), (n + 5, [None] + [1.0] * (d - 1), 1), (n + 6, [float("nan")] * d, 1), (n + 7, [1.0] * (d + 1), 1), (n + 8, [2.0] * (d + 1), 1), (None, rows[2][1], rows[2][2]), (None, list(rng.normal(size=d)), 2)]
    return rows


@pytest.mark.parametrize("seed,n,d,groups,noise,tile", [(1, 250, 16, 40, 0.6, 1024), (2, 300, 8, 3, 0.5, 16), (3, 200, 64, 1, 0.35, 32), (4, 120, 3, 5, 0.9, 8), (5, 60, 1, 2, 1.0, 4)])
def test_rows_by_brute_force(spark, seed, n, d, groups, noise, tile):
    rows = made(seed, n, d, groups, noise)
    found = vl.link_vectors(frame(spark, rows).repartition(4), tile=tile, sample_rows=64).collect()
    assert sorted(map(tuple, found), key=str) == sorted(brute(rows), key=str)


def test_no_rows(spark):
    assert vl.link_vectors(frame(spark, [])).count() == 0
    assert [tuple(r) for r in vl.link_vectors(frame(spark, [(3, None, 1)])).collect()] == [(3, 0, 3, True)]


def test_great_and_small_lengths(spark):
    rows = [(1, [1e300, 1e300], 1), (2, [1e-300, 1e-300], 1), (3, [1e300, -1e300], 1)]
    assert sorted(map(tuple, vl.link_vectors(frame(spark, rows)).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_tiles_stop_early():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(70, 40)) * np.linspace(2, 0.1, 40)
    x = np.concatenate([x, x[:20] + 0.05 * rng.normal(size=(20, 40))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = vl.linked(x[:60], x[60:], 0.93)
    p, q = np.nonzero(x[:60] @ x[60:].T >= 0.93)
    assert sorted(zip(i, j, strict=True)) == sorted(zip(p, q, strict=True)) and len(p) >= 20
