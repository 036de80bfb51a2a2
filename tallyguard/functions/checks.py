"""Checks of layout, dates, amounts and confidences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lines

BLANK = r"[\x20\x09-\x0D]"
# Words for levels of confidence.
LEVELS = (("high", 0.9), ("very high", 0.9), ("medium", 0.7), ("med", 0.7), ("low", 0.4), ("very low", 0.4))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def wide_lines(text: Column) -> dict[str, Column]:
    """Lines with a double space or a tab: how many, a score from two on, the first three to show.

    Null is a text without lines; blank lines don't count. Only what is shown is cut, at 80 characters.
    """
    found = F.filter(lines(F.coalesce(text, F.lit(""))), lambda x: x.rlike(r"[^\x20\x09-\x0D]") & (x.contains("  ") | x.contains("\t")))
    n = F.size(found)
    shown = F.transform(F.slice(found, 1, 3), lambda x: F.substring(stripped(x), 1, 80))
    return {"n_wide": n, "score": F.when(n < 2, 0).otherwise(F.least(n, F.lit(4))) / 10.0, "evidence": F.when(n >= 2, F.array_join(shown, "|"))}


def day_first_dates(dates: Column) -> dict[str, Column]:
    """Dates whose first part can only be a day: how many, and a weak score."""
    n = F.size(F.filter(dates, lambda d: F.regexp_extract(d, r"^(\d{1,2})[/\-.]\d{1,2}[/\-.]\d{2,4}", 1).try_cast("int") > 12))
    return {"n_day_first": n, "score": F.least(n, F.lit(2)) / 10.0}


def signed_amount(text: Column) -> Column:
    """The number that a money string is; round brackets make it negative.

    Currency signs, commas and spaces (also those that don't break) are dropped. Null if the rest is no number.
    """
    s = F.regexp_replace(text, "^[\\s ]+|[\\s ]+$", "")
    value = F.regexp_replace(s, "[^0-9.-]", "").try_cast("double")
    return F.when(s.startswith("(") & s.endswith(")"), -value).otherwise(value)


def unspaced(text: Column) -> Column:
    """Letters set apart are joined where most words of a text of three or more are single characters."""
    words = F.filter(F.split(text, BLANK + "+"), lambda w: w != "")
    single = F.size(F.filter(words, lambda w: F.length(w) == 1))
    joined = F.regexp_replace(F.array_join(words, " "), r"(?<=(?<!\S)\S) (?=\S(?!\S))", "")
    return F.when((F.size(words) > 2) & (single * 2 > F.size(words)), joined).otherwise(text)


def largest_amount(text: Column) -> Column:
    """The largest number in a text, commas dropped; null without one."""
    found = F.regexp_extract_all(text, F.lit(r"[0-9,]+\.?[0-9]*"), F.lit(0))
    return F.array_max(F.transform(found, lambda x: F.regexp_replace(x, ",", "").try_cast("double")))


def _unit(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def confidence(value: Column, default: float = 0.0) -> Column:
    """A confidence from 0 to 1 of a string: a level, a percentage, a share, or a number over 1 in per cent.

    Null, empty and other strings give the default.
    """
    s = F.lower(F.trim(value))
    level = F.lit(None).cast("double")
    for word, share in LEVELS:
        level = F.when(s == word, share).otherwise(level)
    number = s.try_cast("double")
    share = F.when(s.endswith("%"), F.regexp_replace(s, "%$", "").try_cast("double") / 100).when(number > 1, number / 100).otherwise(number)
    return F.coalesce(level, F.when(share.isNotNull(), _unit(share)), F.lit(max(0.0, min(1.0, default))))


def rule_score(value: Column) -> Column:
    """A rule score from 0 to 1 of a string; over 1, also after a per cent sign, it counts in per cent. Else one half."""
    s = F.trim(value)
    v = F.when(s.endswith("%"), F.regexp_replace(s, "%$", "").try_cast("double") / 100).otherwise(s.try_cast("double"))
    v = F.when(v > 1, v / 100).otherwise(v)
    return F.coalesce(F.when(v.isNotNull(), _unit(v)), F.lit(0.5))


def confidence_level(value: Column) -> Column:
    """The level of a confidence; null counts as 0.7."""
    v = F.coalesce(value, F.lit(0.7))
    return F.when(v >= 0.85, "high").when(v >= 0.65, "medium").otherwise("low")
