"""Checks of phone and tax numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First digits of mobile numbers, the checksum's alphabet, known fakes.
LANDLINES = ("11", "22", "33", "40", "44", "80", "20", "79", "120", "124")
MOBILE_PREFIXES, ALPHABET = "6789", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FAKES = ("1234567890", "9999999999", "0000000000", "1111111111")
SEQUENCES = ("01234", "12345", "23456", "34567", "45678", "56789", "98765", "87654", "76543", "65432", "54321", "43210")


def indian_phone(phone: Column) -> dict[str, Column]:
    """Confidence and issues of an Indian number of ten digits, in tenths as whole numbers first."""
    d = F.regexp_replace(phone, r"[^\d+]", "")
    d = F.when(d.startswith("+91"), F.substring(d, 4, 99)).when(d.startswith("91") & (F.length(d) == 12), F.substring(d, 3, 99)).otherwise(d)
    mobile = F.length(d) == 10
    landline = (F.length(d) == 11) & d.startswith("0")
    repeated, sequential = d.rlike(r"(\d)\1{4}"), d.rlike("|".join(SEQUENCES))
    same = d.rlike(r"^(.)\1*$")
    off = (
        F.when(mobile & ~F.substring(d, 1, 1).isin(*MOBILE_PREFIXES), 4).when(~mobile & ~landline, 5).when(landline & ~F.substring(d, 2, 2).isin(*LANDLINES) & ~F.substring(d, 2, 3).isin(*LANDLINES), 3).otherwise(0)
        + F.when(repeated, 5).otherwise(0)
        + F.when(sequential, 6).otherwise(0)
        + F.when(same, 8).otherwise(0)
        + F.when(d.isin(*FAKES), 9).otherwise(0)
    )
    return {"digits": d, "confidence": F.greatest(F.lit(0), 10 - off) / 10.0, "valid": 10 - off > 5, "repeated": repeated, "sequential": sequential}


def us_phone(phone: Column) -> dict[str, Column]:
    """Confidence of a number of the United States, in tenths as whole numbers first, and its written form."""
    d = F.regexp_replace(F.coalesce(phone, F.lit("")), r"[^\d+]", "")
    d = F.when(d.startswith("+1"), F.substring(d, 3, 99)).when(d.startswith("1") & (F.length(d) == 11), F.substring(d, 2, 99)).otherwise(d)
    whole = F.length(d) == 10
    off = (
        F.when(F.substring(d, 1, 1).isin("0", "1"), 4).otherwise(0)
        + F.when(d.rlike(r"(.)\1{4}"), 5).otherwise(0)
        + F.when(d.rlike("|".join(SEQUENCES)), 6).otherwise(0)
    )
    tenths = F.when(F.coalesce(phone, F.lit("")) == "", 0).when(whole, F.greatest(F.lit(0), 10 - off)).otherwise(5)
    dashed = F.concat(F.lit("+1-"), F.substring(d, 1, 3), F.lit("-"), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4))
    return {"digits": d, "confidence": tenths / 10.0, "valid": tenths > 5, "formatted": F.when(whole, dashed).otherwise(d)}


def gstin_issue(gstin: Column) -> Column:
    """The first thing wrong with a tax number's form, or null."""
    state = F.substring(gstin, 1, 2)
    return (
        F.when(F.length(gstin) != 15, "wrong_length")
        .when(~state.rlike(r"^\d{2}$"), "non_numeric_state_code")
        .when(~state.try_cast("int").between(1, 38), "invalid_state_code")
        .when(~F.substring(gstin, 3, 10).rlike(r"^[A-Z]{5}\d{4}[A-Z]$"), "invalid_pan_format")
        .when(~F.substring(gstin, 13, 1).rlike("[1-9Z]"), "invalid_entity_code")
        .when(F.substring(gstin, 14, 1) != "Z", "missing_z_at_pos14")
    )


def gstin_check_digit(gstin: Column) -> Column:
    """The check character that a tax number's first fourteen call for."""

    def part(i: Column) -> Column:
        digit = (F.instr(F.lit(ALPHABET), F.substring(gstin, i, F.lit(1))) - 1) * F.when(i % 2 == 1, 1).otherwise(2)
        return F.floor(digit / 36).cast("int") + digit % 36

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(14)), part), F.lit(0), lambda a, x: a + x)
    return F.substring(F.lit(ALPHABET), (36 - total % 36) % 36 + 1, F.lit(1))
