"""Geography against currency and tax: events of records whose region, currency and tax regime don't fit.

Country profiles and tax rules are small tables, broadcast; everything else is
decided within a record's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import SOFT_TENTHS

# Words of travel, and of health care (whole word: lab).
TRAVEL = (
    "airline", "flight", "boarding pass", "pnr", "iata", "hotel", "resort", "inn", "lodge", "booking",
    "check-in", "check out", "room", "stay", "airport", "terminal", "gate",
)
HEALTH = ("hospital", "clinic", "health", "medical", "pharmacy", r"\blab\b", "urgent care", "dental", "imaging")
#: Confidence of the country from which a currency counts against a record.
SURE = 0.6


def in_force(rules: DataFrame, as_of: str) -> DataFrame:
    """Of (country, tax_name, effective_from, effective_to) the distinct tax names of each country in force on a day."""
    day = F.lit(as_of).cast("date")
    open_ = (F.col("effective_from").cast("date") <= day) & (F.col("effective_to").isNull() | (F.col("effective_to").cast("date") >= day))
    return rules.where(open_).groupBy("country").agg(F.collect_set("tax_name").alias("taxes"))


def consistency(records: DataFrame, profiles: DataFrame, rules: DataFrame, as_of: str) -> DataFrame:
    """A row for each event: ``id``, ``ordinal``, ``rule_id``, ``severity``, ``thousandths``.

    ``records``: id, merchant, full_text, geos (regions hinted at), geo_country,
    geo_conf, currency, tax_regime. ``profiles``: country, currencies, tier.
    Two regions or more are taken as cross-border, none as no hint; only a
    record of one region with a known country is held against its country's
    currencies and the taxes in force. Words of travel soften both where the
    country is STRICT. Null texts, regions and currencies say nothing.
    """
    taxes = in_force(rules, as_of)
    p = F.broadcast(profiles.select(F.col("country").alias("p_country"), "currencies", "tier"))
    t = F.broadcast(taxes.select(F.col("country").alias("t_country"), "taxes"))
    c = F.col
    joined = records.join(p, c("geo_country") == c("p_country"), "left").join(t, c("geo_country") == c("t_country"), "left")
    text = F.lower(F.coalesce("full_text", F.lit("")))
    regions = F.coalesce(F.size(F.coalesce("geos", F.array().cast("array<string>"))), F.lit(0))
    hinted = lambda x: F.coalesce(F.array_contains("geos", x), F.lit(False))
    yes = lambda x: F.coalesce(x, F.lit(False))
    one = (regions == 1) & yes(c("geo_country") != "UNKNOWN")
    travel = yes(c("tier") == "STRICT") & text.rlike("|".join(TRAVEL))
    currency = one & yes((F.size("currencies") > 0) & ~F.array_contains("currencies", c("currency")))
    label = (c("geo_country") == "IN") & (c("tax_regime") == "VAT") & text.rlike(r"\bvat\s*(?:no|tin|reg)") & ~text.rlike(r"\bvat\s*[\d.]+%")
    tax = one & yes(~F.array_contains("taxes", c("tax_regime")) & ~label)
    unsure = yes(c("geo_conf") < SURE) | c("geo_conf").isNull()
    health = F.lower(F.coalesce("merchant", F.lit(""))).rlike("|".join(HEALTH)) | text.rlike("|".join(HEALTH))
    foreign = c("merchant").isNotNull() & hinted("US") & health

    def event(i: int, rule: str, when: Column, severity: Column | str, hundredths: Column | int) -> Column:
        severity, hundredths = (F.lit(x) if isinstance(x, str | int) else x for x in (severity, hundredths))
        return F.when(when, F.struct(F.lit(i).alias("ordinal"), F.lit(rule).alias("rule_id"), severity.alias("severity"), (hundredths * SOFT_TENTHS).cast("double").alias("thousandths")))

    events = F.array_compact(F.array(
        event(0, "GEO_CROSS_BORDER_HINTS", regions >= 2, "INFO", 0),
        event(1, "GEO_NO_REGION_HINT", (regions == 0) & (c("currency").isNotNull() | c("tax_regime").isNotNull()), "INFO", 0),
        event(2, "GEO_CURRENCY_MISMATCH", currency, F.when(unsure, "INFO").when(travel, "WARNING").otherwise("CRITICAL"), F.when(unsure, 0).when(travel, 15).otherwise(25)),
        event(3, "GEO_TAX_MISMATCH", tax, F.when(travel, "WARNING").otherwise("CRITICAL"), F.when(travel, 10).otherwise(18)),
        event(4, "GEO_TRAVEL_SOFTENER", travel & (currency | tax), "INFO", 0),
        event(5, "MERCHANT_CURRENCY_IMPLAUSIBLE", foreign & yes(c("currency") == "CAD") & ~hinted("CA"), "CRITICAL", 22),
        event(6, "MERCHANT_CURRENCY_IMPLAUSIBLE", foreign & yes(c("currency") == "INR") & ~hinted("IN"), "CRITICAL", 18),
    ))
    return joined.select("id", F.explode(events).alias("e")).select("id", "e.*")
