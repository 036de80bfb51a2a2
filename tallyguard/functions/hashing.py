"""Fingerprints and Hamming distance as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Company suffixes that a merchant's name loses, in this order.
SUFFIXES = ("pvt ltd", "pvt. ltd.", "private limited", "limited", "ltd", "inc", "inc.", "llc", "corp", "corporation", "co.", "& co", "enterprises", "services")


def merchant_key(merchant: Column) -> Column:
    """A merchant's name in lower case, without suffixes and with single spaces; empty for null."""
    name = F.lower(F.trim(F.coalesce(merchant, F.lit(""))))
    for suffix in SUFFIXES:
        escaped = suffix.replace(".", r"\.")
        name = F.regexp_replace(name, rf"\b{escaped}\b", "")
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def amount_bucket(amount: Column) -> Column:
    """Ten-unit bucket of an amount."""
    lower = F.floor(amount / 10) * 10
    return F.when(amount.isNull(), "none").when(amount <= 0, "zero").otherwise(F.concat(F.lit("bucket_"), lower.cast("string"), F.lit("_"), (lower + 10).cast("string")))


def date_key(text: Column) -> Column:
    """A date as year-month-day, by the first format that fits; other text as it is."""
    t = F.trim(F.coalesce(text.cast("string"), F.lit("")))
    parsed = F.coalesce(*(F.try_to_timestamp(t, F.lit(f)).cast("date") for f in ("d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy/M/d", "d.M.yyyy")))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).otherwise(F.coalesce(parsed.cast("string"), t))


def fingerprints(merchant: Column, date: Column, total: Column) -> tuple[Column, Column]:
    """Exact and fuzzy fingerprint; null where merchant and date are both empty."""
    name, day = merchant_key(merchant), date_key(date)
    some = (name != "") | (day != "")
    exact = F.concat_ws("|", name, day, F.coalesce(F.format_string("%.2f", total), F.lit("None")))
    fuzzy = F.concat_ws("|", name, day, amount_bucket(total))
    return tuple(F.when(some, F.substring(F.sha2(x, 256), 1, 32)) for x in (exact, fuzzy))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hex hashes; 64 where a length or a digit is wrong."""
    halves = [F.bit_count(F.conv(F.substring(a, k, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(b, k, 8), 16, 10).cast("long"))) for k in (1, 9)]
    valid = a.rlike("^[0-9a-fA-F]{16}$") & b.rlike("^[0-9a-fA-F]{16}$")
    return F.when(valid, halves[0] + halves[1]).otherwise(64)
