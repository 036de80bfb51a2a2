"""Line-first cleaning, in DataFrame functions alone.

Rules of punctuation, navigation and boilerplate judge every line by itself;
failing lines are removed, and a document that loses too much of its text is
rejected, as are those that fail the base figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let

SYMBOLS = "#*$%&|<>"
#: Base: words of a text at least, and per cent of them in repeated windows at most.
MIN_WORDS, MAX_REPEAT = 50, 50
#: A line fails if this share of its words has symbols, or shouts.
NOISE_SHARE = 0.3
#: Words from which a line needs a mark of punctuation, of any script.
BARE_WORDS = 25
#: A line of navigation: short pieces between separators, this many at least, of so many words each at most.
LINKS, LINK_WORDS = 3, 3
#: A document that loses more than this share of its word characters is rejected.
MAX_LOST = 0.5

# What lines of navigation and boilerplate begin with or hold, lower-cased.
BOILERPLATE = (
    "all rights reserved", "accept all cookies", "cookie policy", "enable javascript", "licensed under",
    "lorem ipsum", "privacy policy", "released under the", "sign up for our newsletter",
    "skip to content", "skip to main content", "subscribe to our newsletter", "terms of service", "terms of use",
)

_WS = r"[\x20\x09-\x0D]"


#: The whole line is such pieces, as of menus and bread crumbs: no sentence ends in it.
_PIECE = r"[^\x00-\x20|•·»›>/.!?。।]+(?: [^\x00-\x20|•·»›>/.!?。।]+){0,%d}" % (LINK_WORDS - 1)
NAVIGATION = rf"^\s*{_PIECE}(?: *[|•·»›>] *{_PIECE}){{{LINKS - 1},}}\s*$"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def word_chars(text: Column) -> Column:
    """Code points that belong to words."""
    return F.length(F.regexp_replace(text, _WS + "+", ""))


def repeated_words(words: Column) -> Column:
    """How many words lie in three-word windows that come twice or more in the list.

    Windows are told apart by 64-bit hashes. The windows that repeat are listed
    from the sorted hashes; where they are many, places are sorted along.
    """

    def count(places: Column) -> Column:
        """Words that windows at the ascending places cover."""
        steps = F.transform(F.sequence(F.lit(1), F.size(places) - 1), lambda j: F.least(F.lit(3), places[j] - places[j - 1]))
        inner = F.when(F.size(places) < 2, 0).otherwise(F.aggregate(steps, F.lit(0), lambda a, x: a + x))
        return F.when(F.size(places) == 0, 0).otherwise(inner + 3)

    def covered(windows: Column) -> Column:
        last = F.size(windows) - 1
        at = F.sequence(F.lit(0), last)

        def few(again: Column) -> Column:
            return let(F.filter(at, lambda i: F.array_contains(again, windows[i])), count)

        def many(_: Column) -> Column:
            def places(s: Column) -> Column:
                same = F.filter(at, lambda i: ((i > 0) & (F.get(s, i - 1)["h"] == s[i]["h"])) | ((i < last) & (F.get(s, i + 1)["h"] == s[i]["h"])))
                return F.sort_array(F.transform(same, lambda i: s[i]["i"]))

            pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
            return let(let(pairs, places), count)

        def twice(s: Column) -> Column:
            return F.array_distinct(F.transform(F.filter(F.sequence(F.lit(0), last), lambda i: (i > 0) & (F.get(s, i - 1) == s[i])), lambda i: s[i]))

        some = let(let(F.sort_array(windows), twice), lambda again: F.when(F.size(again) <= 64, few(again)).otherwise(many(again)))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(some)

    windows = let(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])))
    return F.when(F.size(words) < 4, 0).otherwise(let(windows, covered))


def line_fails(line: Column) -> Column:
    """Whether a rule removes the line; blank lines stay."""

    def judge(s: Column) -> Column:
        words, lower = s["words"], F.lower(line)
        boiler = F.lit(False)
        for phrase in BOILERPLATE:
            boiler = boiler | lower.contains(phrase)
        noisy = s["symbols"] >= NOISE_SHARE * words
        shouting = s["shouts"] >= NOISE_SHARE * words
        bare = (words >= BARE_WORDS) & ~line.rlike(r"\p{P}")
        links = line.rlike(NAVIGATION)
        return (words > 0) & (noisy | shouting | bare | links | (boiler & (words <= BARE_WORDS)))

    counts = F.struct(
        _count(line, WORD).alias("words"),
        _count(line, rf"[#*$%&|<>][^\x20\x09-\x0D]*+").alias("symbols"),
        _count(line, rf"!!(?={_WS}|$)").alias("shouts"),
    )
    return let(counts, judge)


def clean_lines(text: Column) -> Column:
    """The text without its failing lines."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~line_fails(line)), "\n")


def judge_quality(docs: DataFrame) -> DataFrame:
    """One row for each document: base figures, ``base_failed``, ``kept`` and ``cleaned``.

    ``n_words``, ``word_chars``, ``n_symbols`` (characters of ``#*$%&|<>``),
    ``n_dup_lines`` (lines with a word equal to an earlier line) and
    ``n_repeat_words`` are of the whole text. ``base_failed``: under
    ``MIN_WORDS`` words, or more than ``MAX_REPEAT`` per cent repeated.
    ``kept``: not so, and the lines that the rules remove hold at most
    ``MAX_LOST`` of the word characters. ``cleaned`` is the text without them.

    Null texts count as empty and fail. Repeated rows and null doc_ids stay;
    extra columns are ignored; an empty table gives no rows. Nothing is
    shuffled: every figure comes from its own row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    worded = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id",
        "text",
        let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("again"))).alias("w"),
        word_chars(text).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        clean_lines(text).alias("cleaned"),
    )
    failed = (F.col("w.n") < MIN_WORDS) | (100 * F.col("w.again") > MAX_REPEAT * F.col("w.n"))
    left = word_chars(F.col("cleaned"))
    return rows.select(
        "doc_id",
        F.col("w.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.col("w.again").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & (left >= (1 - MAX_LOST) * F.col("word_chars"))).alias("kept"),
        "cleaned",
    )
