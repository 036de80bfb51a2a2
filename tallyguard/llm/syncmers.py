"""Document fingerprints from closed syncmers, in DataFrame functions alone.

A text's letters here are its words. A run without white space of more than
``MAX_WORD`` characters, as texts without spaces are, is cut after every
character of a fixed class, one in four or so, so that an insertion shifts
nothing behind the next of them. Of all runs of ``K`` letters those are chosen whose least inner pair of letters, by hash, stands
first or last in the run. Whether a run is chosen depends on its own letters
only, so an edit changes no anchor but those it touches, and any ``K - S`` runs
in a row hold at least one. A text of fewer runs may hold none; then all of its
runs are anchors.

An anchor has a position, the number of letters before it. Two fingerprints are
matched by position: equal anchors are paired, and a pair counts if it is
displaced about as far as the middle pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let

#: Letters of an anchor, letters of the inner substring, characters of a word at most.
K, S, MAX_WORD = 5, 2, 24
#: Bits of an anchor.
BITS = 48
#: How far a pair may be displaced from the middle one: a share of the longer text's letters, and letters.
DRIFT_SHARE, DRIFT = 0.1, 16
#: Characters of a range of documents that is sorted by one task, and bounds that one look-up spans.
RANGE_CHARS, BOUNDS = 32 << 20, 1024

# Characters after which a long run is cut. Of other scripts, the first 32 of every 128 code points.
ASCII_CUTS, CUT_STEP, CUT_WIDTH, CUT_BLOCKS = "02468aeimquyAEIMQUY/._", 128, 32, ((0x80, 0xFFF), (0x3000, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7A3))
_CUT = ASCII_CUTS + "".join(f"{chr(a)}-{chr(a + CUT_WIDTH - 1)}" for lo, hi in CUT_BLOCKS for a in range(lo, hi + 1, CUT_STEP))
_WORD, _UNCUT = r"[^\x20\x09-\x0D]", rf"[^\x20\x09-\x0D{_CUT}]"
LETTER = rf"{_WORD}(?:(?<!{_WORD}{{2}}){_WORD}{{0,{MAX_WORD - 1}}}+(?!{_WORD})|(?<=[{_CUT}])|(?<={_UNCUT})(?:{_UNCUT}{{0,{MAX_WORD - 2}}}+[{_CUT}]|{_UNCUT}{{0,{MAX_WORD - 1}}}+))"  # a word, or a cut of a long run


#: Bits of a position and of the side of a comparison, in a number that holds a hash above them.
_AT = 27
_NONE = -(1 << 31)


def anchors(text: Column) -> Column:
    """The anchors of a text in order: ``struct<at:array<int>, h:array<bigint>>``, their positions and hashes.

    A text of fewer than ``K`` letters has an anchor for each letter, one
    without a chosen run an anchor for each run; only a text without letters
    has none.
    """
    letters = F.regexp_extract_all(text, F.lit(LETTER), F.lit(0))

    def found(at: Column, h: Column) -> Column:
        return F.struct(at.alias("at"), h.alias("h"))

    def short(h: Column) -> Column:
        return found(F.transform(h, lambda x, i: i), F.transform(h, lambda x: x.bitwiseAND((1 << BITS) - 1)))

    def chosen(hashes: Column) -> Column:
        pairs = F.zip_with(F.slice(hashes, 1, F.size(hashes) - 1), F.slice(hashes, 2, F.size(hashes)), lambda a, b: F.xxhash64(a, b))

        def pick(p: Column) -> Column:
            at = F.sequence(F.lit(0), F.size(p) - (K - S) - 1)
            edge = F.filter(at, lambda i: F.least(p[i], p[i + 3]) <= F.least(p[i + 1], p[i + 2]))
            kept = let(edge, lambda e: F.when(F.size(e) == 0, at).otherwise(e))
            return let(kept, lambda k: found(k, F.transform(k, lambda i: F.xxhash64(p[i], p[i + 2], p[i + 3]).bitwiseAND((1 << BITS) - 1))))

        return let(pairs, pick)

    return let(F.transform(letters, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) < K, short(h)).otherwise(chosen(h)))


def firsts(found: Column, side: int) -> Column:
    """Each hash with its first position, sorted: numbers of hash, ``side`` and position."""
    most = (1 << 63 - _AT - 1) - 1
    codes = F.transform(found["h"], lambda h, i: F.shiftleft(h.bitwiseAND(most), _AT + 1).bitwiseOR(F.coalesce(F.get(found["at"], i), F.lit(0)).cast("long")).bitwiseOR(side << _AT))
    return let(F.sort_array(codes), lambda c: F.filter(c, lambda x, i: (i == 0) | (F.shiftright(x.bitwiseXOR(F.get(c, i - 1)), _AT + 1) != 0)))


def likeness(a: Column, b: Column) -> Column:
    """Twice the pairs in place over all anchors, each counted once: 0 to 1; 1 for two empty lists.

    Equal anchors are paired at their first positions. A pair is in place if
    its displacement is that of the middle pair (of those in order the lower
    middle), give or take ``DRIFT`` letters and ``DRIFT_SHARE`` of the longer
    text's extent.
    """
    low = (1 << _AT) - 1

    def moves(c: Column) -> Column:
        def move(x: Column, i: Column) -> Column:
            after = F.get(c, i + 1)
            return F.coalesce(F.when(F.shiftright(x.bitwiseXOR(after), _AT + 1) == 0, (after.bitwiseAND(low) - x.bitwiseAND(low)).cast("int")), F.lit(_NONE))

        return F.sort_array(F.filter(F.transform(c, move), lambda d: d != _NONE))

    extent = lambda x: F.coalesce(F.get(x["at"], F.size(x["at"]) - 1), F.lit(0))
    drift = DRIFT + F.floor(DRIFT_SHARE * F.greatest(extent(a), extent(b)))

    def in_place(d: Column) -> Column:
        middle = F.get(d, F.floor((F.size(d) - 1) / 2).cast("int"))
        return let(F.struct(middle.alias("m"), drift.alias("w")), lambda v: F.size(F.filter(d, lambda x: F.abs(x - v["m"]) <= v["w"])))

    def share(sides: Column) -> Column:
        total = F.size(sides["a"]) + F.size(sides["b"])
        both = F.sort_array(F.concat(sides["a"], sides["b"]))
        return F.when(total == 0, 1.0).otherwise(2.0 * let(let(both, moves), in_place) / total)

    return let(F.struct(firsts(a, 0).alias("a"), firsts(b, 1).alias("b")), share)


def fingerprint(found: Column) -> Column:
    """The anchors as text, in order: positions, then hashes; equal texts have equal fingerprints."""
    listed = F.concat_ws("|", *(F.array_join(found[x].cast("array<string>"), ",") for x in ("at", "h")))
    return F.when(F.size(found["h"]) > 0, listed).otherwise("")


def _below(bounds: Column, most: int, value: Column) -> Column:
    """How many of the sorted ``bounds`` (an array of ``most`` at most) lie below ``value``, by bisection."""
    steps = [1 << k for k in range(most.bit_length() - 1, -1, -1)]

    def step(at: Column, s: Column) -> Column:
        return F.when(F.coalesce(F.get(bounds, at + s - 1) < value, F.lit(False)), at + s).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def with_range(rows: DataFrame, bounds: list[int]) -> DataFrame:
    """``rows`` with ``range``: how many of the sorted ``bounds`` lie below ``doc_id``; -1 for null.

    Bounds are looked up in blocks of ``BOUNDS``, which a small table holds.
    """
    if not bounds:
        return rows.withColumn("range", F.when(F.col("doc_id").isNull(), -1).otherwise(0))
    blocks = [bounds[i : i + BOUNDS] for i in range(0, len(bounds), BOUNDS)]
    listed = F.array(*(F.lit(b[0]).cast("long") for b in blocks[1:])) if len(blocks) > 1 else F.array().cast("array<long>")
    table = F.broadcast(rows.sparkSession.createDataFrame(list(enumerate(blocks)), "block int, bounds array<long>"))  # a long for each range
    found = rows.withColumn("block", _below(listed, max(1, len(blocks) - 1), F.col("doc_id"))).join(table, "block")
    place = F.col("block") * BOUNDS + _below(F.col("bounds"), BOUNDS, F.col("doc_id"))
    return found.withColumn("range", F.when(F.col("doc_id").isNull(), -1).otherwise(place)).drop("block", "bounds")


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """``doc_id``, ``text``, ``found`` (anchors) and ``next_text``, ``next_found`` of the document after it.

    The order is descending doc_id, nulls last, equal ids by a hash of their
    texts; after the last comes the first. Ids are cut into ranges of about
    equal counts, ``RANGE_CHARS`` of text each or ``ranges`` in all; an id (or
    null) that fills several ranges by itself is cut by the texts' hashes. The
    driver sees no more than a bound, a count and a first document's id and
    hash for each. Every range is sorted by itself, with the first document of
    the next range put at its end.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    if ranges is None:
        chars = rows.agg(F.sum(F.length("text").cast("double"))).first()[0] or 0.0
        ranges = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(chars // RANGE_CHARS) + 1)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], min(10 * ranges, 1_000_000))).first()[0] if ranges > 1 else []
    placed = with_range(rows, sorted(set(cuts or []))).withColumn("th", F.xxhash64("text"))
    sizes = {r["range"]: r for r in placed.groupBy("range").agg(F.count("*").alias("n"), F.max("doc_id").alias("head")).collect()}
    even = max(1.0, 2 * sum(r["n"] for r in sizes.values()) / ranges)
    full = [(k, r["head"], int(r["n"] // even) + 1) for k, r in sizes.items() if r["n"] > even]
    if full:  # the first id of such a range is most of it: slices of its hashes come first, the other ids last
        table = F.broadcast(spark.createDataFrame(full, "range int, head long, slices int"))
        slice_of = F.floor((0.5 - F.col("th") / float(1 << 64)) * F.col("slices")).cast("int")
        inside = F.least(F.greatest(slice_of, F.lit(0)), F.col("slices") - 1)
        placed = placed.join(table, "range", "left")
        placed = placed.withColumn("slice", F.when(F.col("slices").isNull(), 0).when(F.col("doc_id").eqNullSafe(F.col("head")), inside).otherwise(F.col("slices"))).drop("head", "slices")
    else:
        placed = placed.withColumn("slice", F.lit(0))
    heads = placed.groupBy("range", "slice").agg(F.max(F.struct("doc_id", "th")).alias("h")).collect()
    heads.sort(key=lambda r: (-r["range"], r["slice"]))
    after = [(heads[(i + 1) % len(heads)]["h"]["doc_id"], heads[(i + 1) % len(heads)]["h"]["th"], r["range"], r["slice"]) for i, r in enumerate(heads)]
    wanted = F.broadcast(spark.createDataFrame(after, "h_id long, h_th long, range int, slice int"))  # a row for each range
    ends = placed.select("doc_id", "text", "th").join(wanted, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("th") == F.col("h_th")))
    ends = ends.groupBy("range", "slice").agg(F.first(F.struct("doc_id", "text", "th")).alias("r")).select("r.doc_id", "r.text", "r.th", "range", "slice", F.lit(1).alias("extra"))
    both = placed.withColumn("extra", F.lit(0)).select(*ends.columns).unionByName(ends).repartition(max(ranges, 1), "range", "slice")
    both = both.withColumn("found", anchors(F.col("text")))  # after the shuffle, which carries texts alone
    order = W.partitionBy("range", "slice").orderBy("extra", F.col("doc_id").desc_nulls_last(), F.col("th").desc())
    led = both.withColumns({"next_text": F.lead("text").over(order), "next_found": F.lead("found").over(order)})
    return led.where("extra = 0").select("doc_id", "text", "found", "next_text", "next_found")


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row for each document: fingerprints of its text and of its edited text.

    The edited text is the text with its last ``floor(n_chars / 2)`` code
    points replaced by the first as many (or all) of the next document.
    ``near_edited`` and ``near_next`` are the likeness of the text's
    fingerprint to the edited text's and to the next document's.

    Null texts are empty; a text without letters (white space alone) has the
    empty fingerprint. Repeated rows follow one another; a lone document is its
    own next. Extra columns are ignored; an empty table gives no rows; texts of
    any length are read whole.
    """
    rows = with_next(docs, ranges)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", 1, n - half), F.substring("next_text", 1, half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "found", "next_found")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "found", "next_found", anchors(F.col("edited")).alias("edited_found"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("found")).alias("fingerprint"),
        fingerprint(F.col("edited_found")).alias("edited_fingerprint"),
        likeness(F.col("found"), F.col("edited_found")).alias("near_edited"),
        likeness(F.col("found"), F.col("next_found")).alias("near_next"),
    )
