"""Alignment against plain loops over whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tallyguard.llm import alignment


@pytest.fixture(scope="module")
def pair():
    import public_tokenizers

    from tallyguard.llm.packing import tokenizer_paths

    return alignment.Pair(*tokenizer_paths(), public_tokenizers.path("piece_bpe_32k.model"))


TEXTS = [
    "hello world, this isn't  two spaces.\nNext line \n\n tab\there ",
    " leading space", "", None, "a", "<|endoftext|> and </s> <s> [INST]", "日本語のテキスト и русский", "▁ odd piece", "é" * 40, "x" * 3000, "\x00 nul \x1c sep", "  ", "\n",
    "naïve café — “quotes” 12345 67.89", "ź combining   nbsp", "same text here", "same text here", "emoji 😀 👩‍👩‍👧 end",
]


def test_ids(pair):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    alphabet = ["a", "the", " ", " ", "  ", "\n", "\t", "é", "日", "!", "12", "'s", " ", "\x1c", "<|endoftext|>", "▁", " ", "Zq"]
    texts = [*(t for t in TEXTS if t), *("".join(rng.choice(alphabet) for _ in range(n)) for n in range(1, 120))]
    import public_tokenizers
    import sentencepiece

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    exact.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for t in texts:
        assert pair(t) == (exact.encode(" " + t, add_special_tokens=False).ids, b.encode(t)), repr(t)


def test_galloping():
    rng = random.Random(5)
    for n in range(1, 400):
        a = np.array(sorted({*rng.sample(range(3000), rng.randrange(1, 400)), 3000}))
        b = np.array(sorted({*rng.sample(range(3000), n), 3000}))
        assert (alignment.gallop(a, b) == np.searchsorted(b, a)).all()
    assert (alignment.gallop(np.array([7, 100_000]), np.arange(100_001)) == [7, 100_000]).all()


def brute(pair, texts):
    docs = []
    for t in texts:
        if not t:
            docs.append(None)
            continue
        a, b = pair(t)
        x, y = [pair.a_bytes[i] for i in a], [pair.b_bytes[i] for i in b]
        if b"".join(x) != (" " + t).encode() or b"".join(y) != (" " + t).encode():
            docs.append(None)
            continue
        found, i, j, at, bt, ga, gb = [], 0, 0, 0, 0, [], []
        while i < len(a) or j < len(b):
            if at <= bt and i < len(a):
                at += len(x[i])
                ga.append(a[i])
                i += 1
            else:
                bt += len(y[j])
                gb.append(b[j])
                j += 1
            if at == bt and gb:
                found.append((ga, gb))
                ga, gb = [], []
        docs.append((len(a), len(b), found))
    count = Counter()
    for d in docs:
        count.update({(p, q) for ga, gb in d[2] for p in ga for q in gb} if d else ())
    best = Counter()
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        pairs = [(p, q) for ga, gb in d[2] for p in ga for q in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in d[2])
        out.append((d[0], d[1], len(d[2]), len(pairs), sum(count[p] == best[p[0]] for p in pairs), sum(count[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block_pairs", [1, 60, 1 << 20])
def test_rows_by_brute_force(spark, pair, block_pairs, monkeypatch):
    rows = [(i if i != 7 else None, t, 9, "x") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, count int, `a.b` string").repartition(3)
    found = alignment.align(df, block_pairs=block_pairs).collect()
    expected = brute(pair, TEXTS)
    assert sorted(map(tuple, found), key=str) == sorted(((r[0], *e) for r, e in zip(rows, expected, strict=True)), key=str)
    assert alignment.align(df.limit(0)).count() == 0


def test_large_groups_in_strips(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 30, 500), rng.integers(0, 40, 400)
    to_a, to_b = np.array([300, 301, 310, 500]), np.array([1, 200, 210, 400])
    plain = alignment.links(a, b, to_a, to_b, 100)
    monkeypatch.setattr(alignment, "LIST_LINKS", 50)
    strips = alignment.links(a, b, to_a, to_b, 100)
    assert all((x == y).all() for x, y in zip(plain, strips, strict=True))
    at, want = [0, 0], Counter()
    for p, q in zip(to_a, to_b, strict=True):
        want.update(int(x) * 100 + int(y) for x in a[at[0] : p] for y in b[at[1] : q])
        at = [p, q]
    assert dict(zip(plain[0].tolist(), plain[1].tolist(), strict=True)) == want


def test_real_texts(spark, pair):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    expected = sorted((r[0], *e) for r, e in zip(rows, brute(pair, [r[1] for r in rows]), strict=True))
    assert sorted(map(tuple, alignment.align(df).collect())) == expected


def test_blocks_are_small_and_few_at_once(spark, tmp_path, monkeypatch):
    """Blocks that are held at once don't grow with a partition."""
    import pyarrow.parquet as pq

    class Kept(alignment.Scratch):
        def __init__(self, spark, name):
            super().__init__(spark, name)
            self.path = str(tmp_path)

    monkeypatch.setattr(alignment, "Scratch", Kept)
    df = spark.createDataFrame([(i, f"text number {i} of many") for i in range(60)], "doc_id long, text string").coalesce(1)
    found = alignment.align(df, block_pairs=1)
    (file,) = tmp_path.glob("blocks-*/*.parquet")
    held = pq.ParquetFile(file).metadata
    assert held.num_rows == 60 and max(held.row_group(i).num_rows for i in range(held.num_row_groups)) <= 8
    assert sorted(r.doc_id for r in found.collect()) == list(range(60))
    assert alignment.BLOCK_PAIRS <= 1 << 17
