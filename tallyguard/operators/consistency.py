"""Whether a receipt's time, place and name fit one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words of a category, its hours, postal circles of India, and words that no name is told by.
CATEGORIES = (
    ("restaurant", ("restaurant", "cafe", "food", "pizza", "burger")), ("pharmacy", ("pharmacy", "medical", "chemist")), ("electronics", ("electronics", "mobile", "digital")),
    ("grocery", ("grocery", "supermarket", "mart")), ("mall", ("mall", "shopping")), ("airport", ("airport", "terminal")), ("gas_station", ("gas", "petrol", "fuel")),
)
HOURS = {"restaurant": (6, 23), "cafe": (7, 23), "retail": (9, 22), "grocery": (7, 22), "electronics": (10, 22), "pharmacy": (0, 24), "gas_station": (0, 24), "convenience_store": (0, 24), "mall": (10, 22), "airport": (0, 24)}
LATE, EARLY = ("pharmacy", "gas_station", "airport", "convenience_store"), ("pharmacy", "gas_station", "airport", "restaurant", "cafe")
CIRCLES = (
    ("11", "delhi"), ("12", "haryana"), ("13", "haryana"), ("14", "punjab"), ("15", "punjab"),
    ("16", "punjab"), ("17", "himachal pradesh"), ("18", "jammu"), ("19", "jammu"), ("20", "uttar pradesh"),
    ("21", "uttar pradesh"), ("22", "uttar pradesh"), ("23", "uttar pradesh"), ("24", "uttar pradesh"), ("25", "uttar pradesh"),
    ("26", "uttar pradesh"), ("27", "uttar pradesh"), ("28", "uttar pradesh"), ("30", "rajasthan"), ("31", "rajasthan"),
    ("32", "rajasthan"), ("33", "rajasthan"), ("34", "rajasthan"), ("36", "gujarat"), ("37", "gujarat"),
    ("38", "gujarat"), ("39", "gujarat"), ("40", "maharashtra"), ("41", "maharashtra"), ("42", "maharashtra"),
    ("43", "maharashtra"), ("44", "maharashtra"), ("45", "maharashtra"), ("50", "telangana"), ("51", "telangana"),
    ("52", "andhra pradesh"), ("53", "andhra pradesh"), ("56", "karnataka"), ("57", "karnataka"), ("58", "karnataka"),
    ("59", "karnataka"), ("60", "tamil nadu"), ("61", "tamil nadu"), ("62", "tamil nadu"), ("63", "tamil nadu"),
    ("64", "tamil nadu"), ("67", "kerala"), ("68", "kerala"), ("69", "kerala"), ("70", "west bengal"),
    ("71", "west bengal"), ("72", "west bengal"), ("73", "west bengal"), ("74", "west bengal"),
)
NO_NAME = ("ltd", "llp", "inc", "corp", "company", "co", "pvt", "private", "limited")


def category(merchant: Column) -> Column:
    lower = F.lower(F.coalesce(merchant, F.lit("")))
    out = F.lit(None).cast("string")
    for name, words in reversed(CATEGORIES):
        out = F.when(lower.rlike("|".join(words)), name).otherwise(out)
    return F.coalesce(out, F.lit("retail"))


def business_hours(receipts: DataFrame) -> DataFrame:
    """``id``, ``category``, ``hour`` and the confidence that a merchant of its category is open then.

    Ten tenths, less 3 outside the hours, 4 from 2 to 5, 2 late at night and 2
    early where the category isn't one that opens then; 0.5 without a time.
    """
    table = F.create_map(*(x for k, (a, b) in HOURS.items() for x in (F.lit(k), F.array(F.lit(a), F.lit(b)))))
    rows = receipts.select("id", category(F.col("merchant")).alias("category"), F.try_to_timestamp("time", F.lit("H:mm")).alias("at")).withColumns({"hour": F.hour("at"), "open": table[F.col("category")]})
    start, end, hour = F.col("open")[0], F.col("open")[1], F.col("hour")
    always = (start == 0) & (end == 24)
    off = (
        F.when((hour < start) | (hour >= end), 3).otherwise(0) + F.when(hour.between(2, 4), 4).otherwise(0)
        + F.when(((hour >= 23) | (hour < 2)) & ~F.col("category").isin(*LATE), 2).otherwise(0) + F.when(hour.between(5, 6) & ~F.col("category").isin(*EARLY), 2).otherwise(0)
    )
    confidence = F.when(hour.isNull(), 5).when(always, 10).otherwise(F.greatest(F.lit(0), 10 - off))
    return rows.select("id", "category", "hour", (confidence / 10.0).alias("confidence"))


def circles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CIRCLES), "circle string, expected string")


def postal_states(addresses: DataFrame, circles: DataFrame) -> DataFrame:
    """Whether a PIN code's circle is the named state's: valid, mismatch, unknown_prefix or incomplete_data. The circles are fixed, so broadcast."""
    j = addresses.join(F.broadcast(circles), F.substring("pin", 1, 2) == F.col("circle"), "left")
    state = F.lower("state")
    fits = state.contains(F.col("expected")) | F.col("expected").contains(state)
    reason = F.when(F.coalesce("pin", F.lit("")) == "", "incomplete_data").when(F.col("expected").isNull(), "unknown_prefix").when(F.coalesce(state, F.lit("")) == "", "valid").when(fits, "valid").otherwise("mismatch")
    return j.select("id", reason.alias("reason"))


def merchant_fit() -> tuple[Column, Column]:
    """How a merchant's name and its address fit: words in common 0.1, a company at a PO box 0.2; unknown where either is unsure."""
    long_words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), F.lit(0)))
    name = F.array_except(long_words(F.col("merchant")), F.array(*map(F.lit, NO_NAME)))
    common = F.size(F.array_intersect(name, long_words(F.col("address")))) > 0
    company = F.lower("merchant").rlike(r"\b(ltd|llp|inc|corp|company|logistics|services|solutions|industries)\b")
    box = F.lower("address").rlike(r"\b(p\.?\s*o\.?\s*box)\b")
    tenths = F.when(common, 1).otherwise(0) + F.when(company & box, 2).otherwise(0)
    sure = F.col("merchant").isNotNull() & (F.col("merchant_conf") >= 0.6) & (F.col("profile_conf") >= 0.55) & F.col("address_class").isin("PLAUSIBLE_ADDRESS", "STRONG_ADDRESS")
    sure = F.coalesce(sure, F.lit(False))
    status = F.when(~sure, "UNKNOWN").when(tenths == 0, "CONSISTENT").when(tenths == 1, "WEAK_MISMATCH").otherwise("MISMATCH")
    return status, F.when(sure, F.least(tenths, F.lit(2))).otherwise(0) / 10.0


def merchant_address(records: DataFrame) -> DataFrame:
    """``merchant_fit`` of every record: ``id``, ``status``, ``score``."""
    status, score = merchant_fit()
    return records.select("id", status.alias("status"), score.alias("score"))
