"""Packing by exact round trip."""

import random
import zlib

import numpy as np
import pytest

from tallyguard.llm import packing


@pytest.fixture(scope="module")
def encoders():
    paths = packing.tokenizer_paths()
    return packing.Encoder(*paths), packing.Encoder(paths[0])


def test_both_libraries_give_the_same_ids(encoders):
    rng = random.Random(1)
    fast, exact = encoders
    alphabets = ["abc ", "aé'ß s\n", "Don't I'll we've ", "0123 ,.!?-", "\t\n  a", "€‘x’ —", "日本 a", "<|endoftext|> ", " ", "!!! *** ###\n\n"]
    for alphabet in alphabets:
        for size in (0, 1, 5, 60, 700):
            text = "".join(rng.choice(alphabet) for _ in range(size))
            assert fast(text) == exact(text), text
    assert fast("x <|endoftext|> y") == exact("x <|endoftext|> y")
    assert fast("a" * 30_000) == exact("a" * 30_000)


@pytest.mark.parametrize("buffer", [1, 3000, 1 << 20])
def test_windows_are_full_powers_of_two(buffer):
    rng = random.Random(buffer)
    packer, sizes = packing.TierPacker(buffer=buffer), [rng.choice([1, 2, 30, 128, 129, 500, 2048, 2049, 9000, rng.randrange(1, 3000)]) for _ in range(400)]
    for doc, n in enumerate(sizes):
        packer.add(doc, n)
    packer.flush()
    pieces, odd = {}, 0
    for size, window in packer.done:
        total = sum(x[2] for x in window)
        assert total == size <= 2048
        odd += total & (total - 1) != 0
        for doc, start, length in window:
            pieces.setdefault(doc, []).append((start, length))
    assert odd <= 1
    for doc, n in enumerate(sizes):
        at = 0
        for start, length in sorted(pieces[doc]):
            assert start == at and length > 0
            at += length
        assert at == n


def test_frames(spark, encoders):
    rows = [(1, "hello world", 7), (None, None, 8), (2, "", 9), (2, "", 9), (3, "word " * 5000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset int").coalesce(1)
    out = packing.pack(df).collect()
    exact = encoders[1]
    for doc_id, text, _ in rows:
        ids = np.array([*exact(text or ""), 1], "<u4")
        mine = sorted((r.start, r.length, r.ids_crc32) for r in out if r.doc_id == doc_id)
        for start, length, crc in mine:
            assert zlib.crc32(ids[start : start + length].tobytes()) == crc
        assert sum(x[1] for x in mine) == len(ids) * (2 if doc_id == 2 else 1)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(df.limit(0)).count() == 0
