"""Dates and times anywhere in a text.

Patterns are tried in order, each over the whole text; what stands behind a
number sign or before a word of an address is no date. A first date reads the
day before the month, a list of all dates the month before the day. Digits are
those of ASCII.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, formats and words, in the order in which they are tried.
_SHORT = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_LONG = "January|February|March|April|May|June|July|August|September|October|November|December"
PATTERNS = (
    r"\b[0-3]?[0-9][/-][0-1]?[0-9][/-](?:20)?[0-9]{2}\b",
    r"\b20[0-9]{2}[-/][0-1]?[0-9][-/][0-3]?[0-9]\b",
    r"\b[0-9]{1,2}\s*/\s*[0-9]{1,2}\s*/\s*[0-9]{2,4}\s+[0-9]{1,2}:[0-9]{2}\s*(?:AM|PM|am|pm)\b",
    r"\b[0-9]{1,2}\s*/\s*[0-9]{1,2}\s*/\s*[0-9]{2,4}\s+[0-9]{1,2}:[0-9]{2}\b",
    r"\b[0-9]{1,2}\s*[/-]\s*[0-9]{1,2}\s*[/-]\s*[0-9]{2,4}\b",
    r"\b[0-9]{4}\s*[/-]\s*[0-9]{1,2}\s*[/-]\s*[0-9]{1,2}\b",
    rf"(?i:\b[0-9]{{1,2}}\s+(?:{_SHORT})[a-z]*\s+[0-9]{{2,4}}\b)",
    rf"(?i:\b(?:{_SHORT})[a-z]*\s+[0-9]{{1,2}},?\s+[0-9]{{2,4}}\b)",
    rf"(?i:\b(?:{_SHORT})[a-z]*\.?\s+[0-3]?[0-9],?\s+20[0-9]{{2}}\b)",
    rf"(?i:\b[0-3]?[0-9]\s+(?:{_SHORT})[a-z]*\.?\s+20[0-9]{{2}}\b)",
    rf"(?i:\b(?:{_LONG})\s+[0-3]?[0-9],?\s+20[0-9]{{2}}\b)",
)
DAY_FIRST = ("%d/%m/%Y", "%d-%m-%Y", "%Y-%m-%d", "%m/%d/%Y", "%d.%m.%Y", "%d %b %Y", "%d %B %Y", "%b %d, %Y", "%b %d %Y", "%B %d, %Y", "%B %d %Y")
MONTH_FIRST = (
    "%m/%d/%Y", "%m/%d/%y", "%d/%m/%Y", "%d/%m/%y", "%Y-%m-%d", "%d-%m-%Y", "%m/%d/%Y %I:%M %p", "%m/%d/%y %I:%M %p",
    "%d %b %Y", "%d %B %Y", "%b %d, %Y", "%b %d %Y", "%B %d, %Y", "%B %d %Y",
)
ADDRESS_WORDS = (
    "nagar", "road", "rd", "street", "st,", "lane", "marg", "avenue", "ave", "colony", "sector", "block", "plot",
    "house", "floor", "building", "bldg", "cross", "main",
)
#: Code points before and after a date in which an address shows itself.
BEFORE, AFTER = 3, 30
#: A time, with its half of the day where it has one; each place is looked at, as one may begin within what only looks like another.
TIME = r"(?U)\b(?=([0-9]{1,2}:[0-9]{2}(?:\s*(?:AM|PM|am|pm))?\b))[0-9]"
CONFLICT_DAYS, POS_HUNDREDTHS, OTHER_HUNDREDTHS = 30, 35, 25

_FIELDS = {
    "d": " [1-9]|0?[1-9]|[12][0-9]|3[01]", "m": "0?[1-9]|1[0-2]", "Y": "[0-9]{4}", "y": "[0-9]{2}", "b": _SHORT, "B": _LONG,
    "I": "0?[1-9]|1[0-2]", "M": "[0-5]?[0-9]", "p": "AM|PM",
}
_CENTURY = 69


def _in_address() -> str:
    """What follows a date within ``AFTER`` code points if an address does: white space, a comma at most, a word."""
    return "|".join(rf"\s{{0,{AFTER - len(lead + w)}}}{lead}{re.escape(w)}" for w in ADDRESS_WORDS for lead in ("", ", "))


#: Where a date may start: each pattern begins with one of these, and never within a word.
_START = rf"(?=[0-9JFMASONDjfmasondſ])(?<![0-9A-Za-z_])(?:[0-9]{{1,4}}\s*[/-]\s*[0-9]|[0-9]{{1,2}}\s+(?i:{_SHORT})|(?i:(?:{_SHORT})[a-z]*\.?\s+[0-9]))"
#: All that a match can be made of.
_RUN = rf"(?:[0-9\s/:,.-]|AM|PM|am|pm|(?i:(?:{_SHORT})[a-z]*+))++"
#: Dates with their surroundings; one that starts in those of another belongs to the same stretch.
_DATE = rf"(?={_START}){_RUN}(?:(?!.{{0,{BEFORE}}}{_START}).){{0,{AFTER}}}+"
#: Dates with their surroundings; one that starts in those of another belongs to the same stretch.
_NEAR = rf"(?Us).{{{BEFORE}}}{_DATE}(?:.{{0,{BEFORE}}}?{_DATE})*+"


def near(text: Column) -> Column:
    """The stretches of a text in which dates and their surroundings lie, with a mark before each that no date starts after; null of a null text."""
    stretches = F.regexp_extract_all(F.concat(F.lit(" " * BEFORE), text), F.lit(_NEAR), F.lit(0))
    return F.concat(F.lit("_"), F.array_join(stretches, " _"))


def found(text: Column) -> Column:
    """What looks like a date and is part of no address, by pattern and then by place; null of a null text.

    A match is taken whole before its surroundings are asked for, so one that an address hides still uses up its
    characters: the other alternative takes it without showing it. A text is read once for the stretches in which
    dates can lie, and the patterns are asked about those, each if what it needs is there.
    """

    def one(part: Column, pattern: str) -> Column:
        day_of = pattern.startswith(r"(?i:\b[")
        start = r"[0-9]{1,4}\s*[/-]" if pattern.startswith(r"\b") else r"[0-9]{1,2}\s+(?i:[JFMASOND])" if day_of else "(?i:[JFMASOND][A-Z])"
        shown = rf"(?<!#\s{{0,{BEFORE - 1}}}|[Nn]o\.)((?>{pattern}))(?!(?i:{_in_address()}))"
        return F.filter(F.regexp_extract_all(part, F.lit(rf"(?U)(?<![0-9A-Za-z_])(?={start})(?:{shown}|(?>{pattern}))"), F.lit(1)), lambda x: x != "")

    def group(part: Column, needs: str, patterns: tuple[str, ...]) -> Column:
        return F.when(part.rlike(needs), F.flatten(F.array(*(one(part, p) for p in patterns)))).otherwise(F.array().cast("array<string>"))

    def every_pattern(part: Column) -> Column:
        plain, timed, spaced, named = "[0-9][/-]", "[0-9]:[0-9]", "[/-]", rf"(?iU)[0-9]\s+(?=[jfmasond])(?:{_SHORT})|(?=[jfmasond])(?:{_SHORT})[a-z]*\.?\s+[0-9]"
        groups = (group(part, plain, PATTERNS[:2]), group(part, timed, PATTERNS[2:4]), group(part, spaced, PATTERNS[4:6]), group(part, named, PATTERNS[6:]))
        return F.when(part.isNotNull(), F.flatten(F.array(*groups)))

    return once(near(text), every_pattern)


def read(written: Column, form: str) -> Column:
    """The date of a whole string in a form with ``%`` fields, as ISO text; null where it isn't one.

    Years of two digits below 69 are of this century.
    """
    names = re.findall("%(.)", form)
    pattern = "".join(f"({_FIELDS[x[1]]})" if x[0] == "%" else r"\s+" if x == " " else re.escape(x) for x in re.findall("%.|[^%]", form))
    pattern = rf"(?iU)^{pattern}$"

    def part(name: str) -> Column:
        return F.regexp_extract(written, pattern, names.index(name) + 1)

    if "Y" in names:
        year = part("Y")
    else:
        year = F.concat(F.when(part("y") < F.lit(str(_CENTURY)), "20").otherwise("19"), part("y"))
    if "m" in names:
        month = part("m")
    else:
        name = F.lower(F.substring(part("b" if "b" in names else "B"), 1, 3))
        month = F.array_position(F.array(*map(F.lit, _SHORT.lower().split("|"))), name).cast("string")
    iso = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(F.trim(part("d")), 2, "0"))
    return F.when(written.rlike(pattern) & (year != "0000"), iso).try_cast("date").cast("string")


def read_first(written: Column, forms: tuple[str, ...]) -> Column:
    """What the first of the forms that reads a string makes of it; forms are told apart by their separators before they are tried."""

    def of(some: list[str]) -> Column:
        return F.coalesce(*(read(written, form) for form in some)) if some else F.lit(None).cast("string")

    out, left = None, list(forms)
    for sign in "/-.":
        own = [form for form in left if sign in form]
        left = [form for form in left if sign not in form]
        out = (F if out is None else out).when(written.contains(sign), of(own))
    return out.otherwise(of(left))


def first(dates: Column) -> Column:
    """The first of ``found`` as ISO text, day before month; as it is written where no form reads it."""
    written = F.get(dates, F.lit(0))
    return F.coalesce(read_first(written, DAY_FIRST), written)


def every(dates: Column) -> Column:
    """All of ``found`` that a form reads, month before day, each once, in order; of a string with spaces its first word."""

    def one(written: Column) -> Column:
        word = F.when(written.contains(" "), F.get(F.split(F.trim(written), r"\s+"), F.lit(0))).otherwise(written)
        return once(word, lambda w: read_first(w, MONTH_FIRST))

    return F.array_distinct(F.array_compact(F.transform(F.array_distinct(dates), one)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value taken once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def span(dates: Column) -> Column:
    """Days between the first and the last of ISO dates; null with fewer than two."""
    return F.when(F.size(dates) >= 2, F.datediff(F.array_max(dates), F.array_min(dates)))


def time(text: Column) -> Column:
    """The first time with a half of the day, else the first time, as HH:MM of 24 hours; null without any."""

    def read_out(written: Column, half: Column | None) -> Column:
        hour = F.substring_index(written, ":", 1).cast("int")
        if half is not None:
            hour = F.when((half == "PM") & (hour != 12), hour + 12).when((half == "AM") & (hour == 12), 0).otherwise(hour)
        return F.when(written.isNotNull(), F.format_string("%02d:%s", hour, F.substring(F.substring_index(written, ":", -1), 1, 2)))

    def chosen(times: Column) -> Column:
        with_half = F.get(F.filter(times, lambda x: x.rlike("[Mm]$")), F.lit(0))
        return F.coalesce(read_out(with_half, F.upper(F.right(with_half, F.lit(2)))), read_out(F.get(times, F.lit(0)), None))

    return once(F.regexp_extract_all(text, F.lit(TIME), F.lit(1)), chosen)
