"""Cross-tokenizer alignment by galloping intersection of byte ends.

1. One pass encodes each text by both vocabularies and lists the byte offset at
   which every token ends. The shorter list drives an exponential, then binary
   search into the longer one; offsets found in both cut the tokens into groups,
   and differences of their ranks are how many tokens of either side a group has.
2. A partition's documents form blocks of bounded size. A block is one row: a
   dictionary of its distinct linked id pairs with the documents that hold each,
   and every document's pairs as places in that dictionary.
3. The dictionaries alone are shuffled: summed by pair they are the counts of
   the whole corpus, and joined back they give each block the counts of its own
   pairs. A block meets its counts by its name, so no task sees more than one.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .packing import _LONG_RUN, _PLAIN, Encoder, tokenizer_paths

#: Pairs (distinct in their document) of one block at most, unless one document has more. A block is one row, of which writers, readers,
#: sorts and groups hold several at once: some 1.6 MB at this size.
BLOCK_PAIRS = 1 << 17
#: Blocks that are written, and read again, at once. Parquet itself looks at the size of what it holds every 100 rows only.
BLOCKS_AT_ONCE = 8
#: Links that are listed at once.
LIST_LINKS = 1 << 20
#: Tokens whose ends are searched together, and every how many a value is searched ahead of its neighbours.
TOGETHER, STRIDE = 1 << 18, 16


def byte_alphabet() -> dict[str, int]:
    """The byte of each character in which byte-level entries are written: printable ones stand for themselves, others from 256 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Ids of a text by both vocabularies, and the bytes of their tokens."""

    def __init__(self, json_path: str, ranks_path: str | None, piece_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece

        self._a = Encoder(json_path, ranks_path)
        self._a.exact.encode_special_tokens = True  # their strings in a text are plain text
        self._b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        alphabet = byte_alphabet()
        self.a_bytes = [b""] * self._a.exact.get_vocab_size(with_added_tokens=True)
        for entry, i in self._a.exact.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]

    def __call__(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of space+text by the first vocabulary, of the text by the second, which adds the space."""
        full = " " + text
        fast = self._a.fast is not None and _plain(full)
        return (self._a.fast.encode_ordinary(full) if fast else self._a.exact.encode(full, add_special_tokens=False).ids), self._b.encode(text)


def _plain(text: str) -> bool:
    return bool(_PLAIN.fullmatch(text)) and not _LONG_RUN.search(text)


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each of ``short`` the rank of the first of ``long`` that isn't less; both ascend, and ``long`` ends with the greatest value of either.

    Every ``STRIDE``-th value is searched first, and is where the search for the
    values behind it starts: steps of 1, 2, 4 and so on pass the value, then a
    binary search within the last step finds it. All values take a step at once.
    """
    low = np.repeat(gallop(short[::STRIDE], long), STRIDE)[: len(short)] if len(short) > STRIDE else np.zeros(len(short), np.int64)
    high, step, last = low.copy(), 1, len(long) - 1
    at = np.flatnonzero(long[high] < short)
    while len(at):
        passed = high[at]
        low[at] = passed + 1
        high[at] = passed = np.minimum(passed + step, last)
        step += step
        at = at[long[passed] < short[at]]
    at = np.flatnonzero(low < high)
    while len(at):
        a, b = low[at], high[at]
        mid = (a + b) >> 1
        less = long[mid] < short[at]
        low[at] = a = np.where(less, mid + 1, a)
        high[at] = b = np.where(less, b, mid)
        at = at[a < b]
    return low


def groups(docs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each document, given as the byte lengths of its tokens by both sides, the tokens of each side before the end of each group.

    The byte ends of many documents, one behind another, are searched together:
    those with fewer tokens of the first side apart from the others.
    """
    out: list = [None] * len(docs)
    for drives in (0, 1):
        chosen = [k for k, d in enumerate(docs) if (len(d[0]) > len(d[1])) == bool(drives)]
        if not chosen:
            continue
        short, long = (np.cumsum(np.concatenate([docs[k][side] for k in chosen])) for side in (drives, 1 - drives))
        place = gallop(short, long)
        i = np.flatnonzero(long[place] == short)
        j = place[i]
        from_i, from_j = (np.cumsum([0, *(len(docs[k][side]) for k in chosen)]) for side in (drives, 1 - drives))
        cut = np.searchsorted(i, from_i)
        for n, k in enumerate(chosen):
            found = (i[cut[n] : cut[n + 1]] - from_i[n] + 1, j[cut[n] : cut[n + 1]] - from_j[n] + 1)
            out[k] = found[::-1] if drives else found
    return out


def _counted(keys: list[np.ndarray], occ: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all arrays, ascending, and the sums of their numbers."""
    key, n = np.concatenate(keys), np.concatenate(occ)
    key, where = np.unique(key, return_inverse=True)
    return key, np.bincount(where, n, len(key)).astype(np.int64) if n.sum() < 1 << 50 else np.array([n[where == k].sum() for k in range(len(key))])


def links(a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked pairs, as a * width + b ascending, and how often each is linked.

    Groups are listed ``LIST_LINKS`` links at a time; a group with more than
    that is counted by its distinct ids, a strip of them at a time.
    """
    size_a, size_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
    from_a, from_b, size = to_a - size_a, to_b - size_b, size_a * size_b
    keys, occ = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def add(key: np.ndarray, n: np.ndarray | None = None) -> None:
        if n is None:
            key, n = np.unique(key, return_counts=True)
        keys.append(key)
        occ.append(n)
        if len(keys) > 8:
            keys[:], occ[:] = ([x] for x in _counted(keys, occ))

    huge = size > LIST_LINKS
    for g in np.flatnonzero(huge):
        ids_a, n_a = np.unique(a[from_a[g] : to_a[g]], return_counts=True)
        ids_b, n_b = np.unique(b[from_b[g] : to_b[g]], return_counts=True)
        strip = max(1, LIST_LINKS // len(ids_b))
        for at in range(0, len(ids_a), strip):
            add((ids_a[at : at + strip, None] * width + ids_b).ravel(), (n_a[at : at + strip, None] * n_b).ravel())
    rest = np.flatnonzero(~huge)
    filled = np.cumsum(size[rest])
    for part in np.split(rest, np.flatnonzero(np.diff(filled // LIST_LINKS)) + 1) if len(rest) else []:
        n = size[part]
        g = np.repeat(part, n)
        within = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
        wide = size_b[g]
        add(a[from_a[g] + within // wide] * width + b[from_b[g] + within % wide])
    if len(keys) == 2:  # one listing, distinct already
        return keys[1], occ[1]
    return _counted(keys, occ)


class Written:
    """The text ``a1,a2|b1;a3|b2,b3`` of a document's groups."""

    def __init__(self, n_a: int, n_b: int):
        self.n = max(n_a, n_b)
        self.parts = [b"%d%s" % (i, mark) for mark in (b",", b"|", b";") for i in range(self.n)]

    def __call__(self, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> bytes:
        size_a, size_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        out = np.empty(len(a) + len(b), np.int64)
        code_a, code_b = a.copy(), b.copy()
        code_a[to_a - 1] += self.n
        code_b[to_b - 1] += 2 * self.n
        out[np.arange(len(a)) + np.repeat(to_b - size_b, size_a)] = code_a
        out[np.arange(len(b)) + np.repeat(to_a, size_b)] = code_b
        return b"".join(map(self.parts.__getitem__, out.tolist()))[:-1]


_BLOCK = (
    "block long, pairs array<long>, held array<long>, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
    "n_links array<long>, sha array<string>, size array<int>, place array<int>, occ array<long>"
)
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _blocks(docs: DataFrame, paths: tuple[str, str | None, str], block_pairs: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(*paths)
        width = len(pair.b_bytes)
        wrote = Written(len(pair.a_bytes), width)
        of_a, of_b = pair.a_bytes.__getitem__, pair.b_bytes.__getitem__
        long_a, long_b = (np.array([len(x) for x in t], np.int64) for t in (pair.a_bytes, pair.b_bytes))
        part, serial, held = TaskContext.get().partitionId(), 0, 0
        rows: list[tuple] = []
        nothing = (0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64))

        def encoded(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
            if not text:
                return None
            (ids_a, ids_b), whole = pair(text), (" " + text).encode("utf-8", "replace")
            if b"".join(map(of_a, ids_a)) != whole or b"".join(map(of_b, ids_b)) != whole:
                return None
            return np.array(ids_a, np.int64), np.array(ids_b, np.int64)

        def aligned(waiting: list[tuple]) -> Iterator[tuple]:
            found = iter(groups([(long_a[x[0]], long_b[x[1]]) for _, x in waiting if x]))
            for doc_id, x in waiting:
                if x is None:
                    yield doc_id, *nothing
                    continue
                (a, b), (to_a, to_b) = x, next(found)
                key, occ = links(a, b, to_a, to_b, width)
                yield doc_id, len(a), len(b), len(to_a), int(occ.sum()), hashlib.sha256(wrote(a, b, to_a, to_b)).hexdigest(), key, occ

        def out() -> pa.RecordBatch:
            nonlocal serial, held
            serial, held = serial + 1, 0
            pairs, place, n = np.unique(np.concatenate([r[6] for r in rows]), return_inverse=True, return_counts=True)
            cols = [[(part << 32) + serial], [pairs], [n], *([[r[k] for r in rows]] for k in range(6)), [[len(r[6]) for r in rows]], [place.ravel()], [np.concatenate([r[7] for r in rows])]]
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 7, pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _BLOCK.split(", ")])

        def texts() -> Iterator[list[tuple]]:
            waiting, tokens = [], 0
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    x = encoded(text.as_py())
                    waiting.append((doc_id, x))
                    tokens += len(x[0]) + len(x[1]) if x else 1
                    if tokens >= TOGETHER:
                        yield waiting
                        waiting, tokens = [], 0
            yield waiting

        for waiting in texts():
            for row in aligned(waiting):
                rows.append(row)
                held += len(row[6]) + 1
                if held >= block_pairs:
                    yield out()
        if rows:
            yield out()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, _BLOCK)


def _report(block: pa.Table, counts: pa.Table) -> pa.Table:
    """A row for each document of a block, whose counts ``counts`` has by place."""
    names = [x.split()[0] for x in _RESULT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()]
    if not block.num_rows:
        return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
    flat = {c: block.column(c).combine_chunks().flatten() for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "sha")}
    size, place, occ = (block.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("size", "place", "occ"))
    n = block.column("n_pairs")[0].as_py()
    count, best = np.zeros(n, np.int64), np.zeros(n, bool)
    at = counts.column("place").to_numpy()
    count[at], best[at] = counts.column("count").to_numpy(), counts.column("best").to_numpy()
    ends = np.cumsum(size, dtype=np.int64)

    def summed(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x)])
        return total[ends] - total[ends - size]

    cols = [*(flat[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(summed(occ * best[place])), pa.array(summed(occ * count[place])), flat["sha"]]
    return pa.Table.from_arrays([c.cast(k) for c, k in zip(cols, kinds, strict=True)], names=names)


def align(docs: DataFrame, *, json_path: str | None = None, ranks_path: str | None = None, piece_path: str | None = None, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """One row for each document: how its tokens by two vocabularies line up.

    A is the byte-level vocabulary of ``json_path`` over space+text, B that of
    ``piece_path``, which adds the space. Columns: ``doc_id``; ``n_a`` and
    ``n_b``, tokens; ``n_groups``, groups between byte offsets at which tokens
    of both end; ``n_links``, token pairs that share a group; ``n_best``, links
    whose pair's count is its A id's highest in the corpus, ties included;
    ``count_sum``, of the counts over all links; ``groups_sha256``, of the
    groups' ids as text. A pair's count is the number of documents that hold it.

    Null and empty texts, and texts whose tokens don't give their bytes back by
    either side, have no tokens: zeros and ''. Repeated rows are documents of
    their own; null doc_ids stay null; extra columns are ignored; an empty
    table gives no rows. Very long texts are a block by themselves; a group of
    any size is counted in strips. Counts are summed exactly at every size: the
    only broadcast side has a row for each id of A at most.
    """
    import public_tokenizers

    default_json, default_ranks = tokenizer_paths()
    ranks_path = ranks_path or (None if json_path else default_ranks)
    paths = (json_path or default_json, ranks_path, piece_path or public_tokenizers.path("piece_bpe_32k.model"))
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=paths[2]).get_piece_size()
    spark = docs.sparkSession
    run = Scratch(spark, "alignment")
    blocks = run(_blocks(docs, paths, block_pairs), "blocks", **{"parquet.block.row.count.limit": BLOCKS_AT_ONCE})
    listed = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "x")).select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    of_pair = run(listed.groupBy("pair").agg(F.sum("held").alias("count")), "counts")
    of_a = F.floor(F.col("pair") / width).cast("long")
    highest = of_pair.groupBy(of_a.alias("a")).agg(F.max("count").alias("highest"))
    of_pair = of_pair.withColumn("a", of_a).join(F.broadcast(highest), "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    counts = listed.select(F.col("block").alias("of_block"), "place", "pair").join(of_pair.hint("merge"), "pair").select("of_block", "place", "count", "best")
    # a block goes without its dictionary: its counts have the places
    told = blocks.select("block", F.size("pairs").alias("n_pairs"), "doc_id", "n_a", "n_b", "n_groups", "n_links", "sha", "size", "place", "occ")
    return told.groupBy("block").cogroup(counts.groupBy("of_block")).applyInArrow(_report, _RESULT)
