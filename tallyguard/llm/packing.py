"""Hierarchical multi-length packing of token sequences.

Documents are routed to context-size tiers (powers of two up to the longest
sequence) by their length. Each tier is packed with the documents routed to
it, the gap that a document leaves in its window is filled from shorter tiers,
and windows of one tier are dealt to step groups of equal token counts.

Every partition of the input is packed by itself, in one pass and without a
shuffle: a partition holds millions of tokens while a window holds 2048, so
packing across partitions would gain nothing but cost a shuffle of all tokens.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: The tier sizes, ascending; the last is the longest sequence.
TIERS = (128, 256, 512, 1024, 2048)
#: Id that ends every document.
END_ID = 1
#: Tokens of one step group.
STEP_TOKENS = 16384
#: Tokens that a partition holds back at most while it packs.
BUFFER_TOKENS = 1 << 20

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, tier int, step_group long"
)

#: Texts that both libraries split alike beyond doubt: Latin letters, digits,
#: punctuation and plain white space, without endless runs of one kind.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ɏ‐-‧€]*")
_LONG_RUN = re.compile(r"\S{1000}|\s{1000}")


class Encoder:
    """Ids of whole texts under a public byte-level BPE vocabulary.

    The ids are those of ``tokenizers`` with the given file. Plain texts take
    the faster ``tiktoken`` with the same vocabulary as ranks, which gives the
    same ids (tested); special-token strings, other scripts and very long runs
    go to ``tokenizers`` itself.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        self.specials = [str(t.content) for t in self.exact.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path and os.path.exists(ranks_path):
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if (
            self.fast is not None
            and _PLAIN.fullmatch(text)
            and not _LONG_RUN.search(text)
            and not any(s in text for s in self.specials)
        ):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


def tokenizer_paths() -> tuple[str, str]:
    """Default vocabulary: the JSON file and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class TierPacker:
    """Packs pieces into windows of ``tiers``, holding back ``buffer`` tokens at most.

    ``add`` takes a document's token count; ``pieces`` yields finished windows
    as ``(tier, [(doc, start, length), ...])``. Every window but those of the
    last flush holds exactly its tier's tokens, a power of two. The last flush
    cuts what is left into powers of two too; under ``tiers[0]`` tokens of a
    partition end in a window that isn't full.
    """

    def __init__(self, tiers: Iterable[int] = TIERS, buffer: int = BUFFER_TOKENS):
        self.tiers = tuple(sorted(tiers))
        self.buffer = buffer
        #: By tier: (length, doc, start), sorted by length.
        self.waiting: list[list[tuple[int, int, int]]] = [[] for _ in self.tiers]
        self.held = 0
        self.done: list[tuple[int, list[tuple[int, int, int]]]] = []

    def _route(self, doc: int, start: int, length: int) -> None:
        insort(self.waiting[bisect_left(self.tiers, length)], (length, doc, start))
        self.held += length

    def add(self, doc: int, length: int) -> None:
        top, start = self.tiers[-1], 0
        while length - start >= top:
            self.done.append((top, [(doc, start, top)]))
            start += top
        if length > start:
            self._route(doc, start, length - start)
        if self.held >= self.buffer:
            self._pack()

    def _fill(self, gap: int, below: int, window: list[tuple[int, int, int]]) -> int:
        """Whole pieces of tiers up to ``below`` that fit, longest first, then a cut one."""
        for k in range(below, -1, -1):
            pool = self.waiting[k]
            while gap and pool:
                at = bisect_right(pool, (gap, 1 << 62, 0)) - 1
                if at < 0:
                    break
                length, doc, start = pool.pop(at)
                window.append((doc, start, length))
                self.held -= length
                gap -= length
        if gap:
            for k in range(below + 1):
                if self.waiting[k]:
                    length, doc, start = self.waiting[k].pop()
                    self.held -= length
                    window.append((doc, start, gap))
                    self._route(doc, start + gap, length - gap)
                    return 0
        return gap

    def _pack(self) -> None:
        """Windows of each tier from the longest down, while shorter tiers can fill them."""
        for k in range(len(self.tiers) - 1, -1, -1):
            pool = self.waiting[k]
            while pool and self._below(k) >= self.tiers[k]:
                length, doc, start = pool.pop()
                self.held -= length
                window = [(doc, start, length)]
                gap = self._fill(self.tiers[k] - length, max(k - 1, 0), window)
                if gap:
                    gap = self._fill(gap, k, window)
                self.done.append((self.tiers[k] - gap, window))

    def _below(self, k: int) -> int:
        """Tokens that a window of tier ``k`` can be made of, counted no further than needed."""
        total = 0
        for pool in reversed(self.waiting[: k + 1]):
            for length, _, _ in pool:
                total += length
                if total >= self.tiers[k]:
                    return total
        return total

    def flush(self) -> None:
        """Cut everything that waits into windows of the largest tier that it still fills."""
        self._pack()
        left = [x for pool in reversed(self.waiting) for x in reversed(pool)]
        self.waiting, total, self.held = [[] for _ in self.tiers], sum(x[0] for x in left), 0
        while total:
            size = next((t for t in reversed(self.tiers) if t <= total), total)
            window, room = [], size
            while room:
                length, doc, start = left.pop(0)
                take = min(length, room)
                window.append((doc, start, take))
                if take < length:
                    left.insert(0, (length - take, doc, start + take))
                room -= take
            self.done.append((size, window))
            total -= size


def pack(
    docs: DataFrame,
    *,
    json_path: str | None = None,
    ranks_path: str | None = None,
    end_id: int = END_ID,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    buffer_tokens: int = BUFFER_TOKENS,
) -> DataFrame:
    """One row for each piece of a document in a sequence.

    A document is its ids, then ``end_id``; it may be cut anywhere and each of
    its ids lies in one piece. Columns: ``doc_id``, ``start`` (ids before the
    piece), ``length``, ``ids_crc32`` (of the ids as unsigned little-endian 32
    bit), ``doc_tokens``, ``sequence_id``, ``offset`` (in the sequence, gapless
    from 0), ``tier`` (the window's size) and ``step_group``: windows of one
    tier of one partition, ``step_tokens`` tokens together.

    Null and empty texts are one piece, the end id. A null ``doc_id`` stays
    null; repeated rows are packed as often as they come; extra columns are
    ignored; an empty table gives no rows. A sequence's id holds the number of
    its partition, so reruns over the same splits agree.
    """
    default_json, default_ranks = tokenizer_paths()
    json_path, ranks_path = json_path or default_json, ranks_path or (None if json_path else default_ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(json_path, ranks_path)
        packer = TierPacker(tiers, buffer_tokens)
        part = TaskContext.get().partitionId()
        ids_of: dict[int, list] = {}  # doc -> [doc_id, ids, ids not yet out]
        serial, groups = 0, {}  # groups: tier -> (its step group, tokens in it)
        next_group = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal serial, next_group
            cols: list[list] = [[] for _ in range(9)]
            for size, window in packer.done:
                tier = next((t for t in packer.tiers if t >= size), size)
                group, used = groups.get(tier, (None, 0))
                if group is None or used + tier > step_tokens:
                    group, used, next_group = (part << 33) + next_group, 0, next_group + 1
                groups[tier] = (group, used + tier)
                offset = 0
                for doc, start, length in window:
                    entry = ids_of[doc]
                    piece = entry[1][start : start + length]
                    row = (entry[0], start, length, zlib.crc32(piece.tobytes()), len(entry[1]), (part << 33) + serial, offset, tier, group)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                    offset += length
                    entry[2] -= length
                    if not entry[2]:
                        del ids_of[doc]
                serial += 1
            packer.done = []
            if cols[0]:
                kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        number = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                ids_of[number] = [doc_id, ids, len(ids)]
                packer.add(number, len(ids))
                number += 1
                if len(packer.done) >= 2048:
                    yield from out()
        packer.flush()
        yield from out()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)
