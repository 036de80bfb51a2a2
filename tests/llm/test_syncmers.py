"""Closed syncmers against a plain loop."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tallyguard.llm import syncmers


CUTS = set(syncmers.ASCII_CUTS) | {chr(a + i) for lo, hi in syncmers.CUT_BLOCKS for a in range(lo, hi + 1, syncmers.CUT_STEP) for i in range(syncmers.CUT_WIDTH)}


def xx(data, seed=42):
    h = xxhash.xxh64(data, seed=seed & (1 << 64) - 1).intdigest()
    return h - (1 << 64) if h >> 63 else h


def brute_anchors(text):
    """(position, hash) of the chosen runs."""
    letters = []
    for run in re.findall(r"[^\x20\x09-\x0D]+", text):
        if len(run) <= 24:
            letters.append(run)
            continue
        piece = ""
        for i, c in enumerate(run):
            piece += c
            if c in CUTS or len(piece) == 24:
                letters.append(piece)
                piece = ""
        letters += [piece] if piece else []
    h = [xx(w.encode()) for w in letters]
    cut = (1 << syncmers.BITS) - 1
    if len(h) < syncmers.K:
        return [(i, x & cut) for i, x in enumerate(h)]

    def long(x):
        return x.to_bytes(8, "little", signed=True)

    p = [xx(long(b), xx(long(a))) for a, b in zip(h, h[1:])]
    runs = range(len(h) - syncmers.K + 1)
    at = [i for i in runs if min(p[i], p[i + 3]) <= min(p[i + 1], p[i + 2])] or list(runs)
    return [(i, xx(long(p[i + 3]), xx(long(p[i + 2]), xx(long(p[i])))) & cut) for i in at]


def brute_likeness(a, b):
    """Equal anchors paired at their first positions; those displaced like the middle pair."""
    if not a and not b:
        return 1.0
    one, two = ({h: at for at, h in reversed(x)} for x in (a, b))
    moves = sorted(two[h] - one[h] for h in one.keys() & two.keys())
    drift = syncmers.DRIFT + int(syncmers.DRIFT_SHARE * max([at for at, _ in a + b]))
    return 2 * sum(abs(d - moves[(len(moves) - 1) // 2]) <= drift for d in moves) / (len(one) + len(two))


def printed(found):
    return ",".join(str(at) for at, _ in found) + "|" + ",".join(str(h) for _, h in found) if found else ""


rng = random.Random(3)
PARTS = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) + str(rng.randrange(60)) for _ in range(n)) for n in (200, 200, 150)]
TEXTS = [
    "", "one", "a b c d", "a b c d e", "the cat sat on the mat and the dog sat on the log " * 3, "é " * 40 + "x" * 100, "w1 w2\nw3\tw4  w5 w6 w7 w8 w9 w10",
    PARTS[0] + " " + PARTS[1], PARTS[1] + " " + PARTS[0], PARTS[0] + " " + PARTS[1] + " " + PARTS[2], "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(300)), " \n\t",
]


def test_anchors_are_the_closed_syncmers(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: list(zip(r.found['at'], r.found['h'])) for r in df.select("doc_id", syncmers.anchors(F.col("text")).alias("found")).collect()}
    assert got == {i: brute_anchors(t) for i, t in enumerate(TEXTS)}


def test_fingerprints_by_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"found": F.lit(1), "range": F.lit(2), "th": F.lit(3)}).repartition(3)
    for ranges in (1, 3, 50):
        got = {r.doc_id: r for r in syncmers.fingerprints(df, ranges).collect()}
        order = sorted((i for i, _ in rows if i is not None), reverse=True) + [None]
        texts = {i: t or "" for i, t in rows}
        assert len(got) == len(rows)
        for a, b in zip(order, order[1:] + order[:1]):
            t, half = texts[a], len(texts[a]) // 2
            edited = t[: len(t) - half] + texts[b][:half]
            own, other, after = brute_anchors(t), brute_anchors(edited), brute_anchors(texts[b])
            assert got[a].n_chars == len(t)
            assert got[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert got[a].fingerprint == printed(own) and got[a].edited_fingerprint == printed(other)
            assert got[a].near_edited == pytest.approx(brute_likeness(own, other)) and got[a].near_next == pytest.approx(brute_likeness(own, after))
    assert syncmers.fingerprints(df.limit(0), 3).count() == 0


def test_positions_tell_moved_passages_and_keep_inserted_ones():
    ab, ba, abc, han = (brute_anchors(TEXTS[i]) for i in (7, 8, 9, 10))
    assert brute_likeness(ab, ba) < 0.6 and brute_likeness(ab, abc) > 0.7
    shifted = brute_anchors(TEXTS[10][:7] + "\u4e01" + TEXTS[10][7:])
    assert brute_likeness(han, shifted) > 0.9


def test_one_id_that_fills_several_ranges(spark):
    rows = [(None, f"t {i % 40} {i % 7} x") for i in range(300)] + [(5, f"u {i} v w") for i in range(300)] + [(i, f"w {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for bounds in (2, 1024):
        held, syncmers.BOUNDS = syncmers.BOUNDS, bounds
        got = sorted((str(r.doc_id), r.text, r.next_text) for r in syncmers.with_next(df, 12).collect())
        syncmers.BOUNDS = held
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, xx(r[1].encode())), reverse=True)
        want = sorted((str(a[0]), a[1], b[1]) for a, b in zip(order, order[1:] + order[:1]))
        assert got == want


def test_every_text_with_a_word_has_anchors_that_tell_it_apart(spark):
    texts = [" ".join(f"{chr(97 + i % 26)}{i}w{k}" for k in range(n)) for n in range(1, 9) for i in range(60)]
    df = spark.createDataFrame(list(enumerate([*texts, "", " \n"])), "doc_id long, text string")
    rows = {r.doc_id: r for r in syncmers.fingerprints(df, 2).select("doc_id", "fingerprint", "edited_fingerprint", "near_next", "near_edited").collect()}
    assert all((rows[i].fingerprint != "") == (i < len(texts)) for i in rows)
    for first in range(0, len(texts), 60):  # of as many words each
        assert len({rows[i].fingerprint for i in range(first, first + 60)}) == 60
    assert all(rows[i].near_next < 1 for i in range(1, len(texts)))
    assert all(rows[i].near_edited < 1 for i in range(len(texts)) if len(texts[i].split()) in (5, 6) and i % 60)
