"""Where a document comes from: postal codes, cities, terms and strong patterns, summed by country.

The dimensions are small and fixed, so a document meets them as literal arrays
in its own row: no join, no shuffle. Weights are whole hundredths.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Country, pattern or word, weight in hundredths; and the caps of cities and terms.
POSTAL = (
    ("US", r"\b\d{5}(?:-\d{4})?\b", 25), ("DE", r"\b\d{5}\b", 25), ("UK", r"\b[A-Z]{1,2}\d{1,2}[A-Z]?\s?\d[A-Z]{2}\b", 50),
    ("CA", r"\b[A-Z]\d[A-Z]\s?\d[A-Z]\d\b", 50), ("AU", r"\b\d{4}\b", 30), ("AE", r"\b\d{5}\b", 20),
)
CITIES = {
    "IN": ("mumbai", "delhi", "bangalore", "bengaluru", "hyderabad", "chennai", "kolkata", "pune", "ahmedabad", "jaipur", "surat", "lucknow"),
    "US": ("new york", "los angeles", "chicago", "houston", "phoenix", "philadelphia", "san antonio", "san diego", "dallas", "austin", "seattle", "boston"),
    "DE": ("berlin", "hamburg", "munich", "cologne", "frankfurt", "stuttgart", "dortmund", "essen", "leipzig", "bremen", "dresden"),
    "UK": ("london", "birmingham", "manchester", "leeds", "glasgow", "liverpool", "edinburgh", "bristol", "cardiff"),
    "CA": ("toronto", "montreal", "vancouver", "calgary", "edmonton", "ottawa"), "SG": ("singapore",), "AE": ("dubai", "abu dhabi", "sharjah"),
    "AU": ("sydney", "melbourne", "brisbane", "perth", "adelaide"), "KE": ("nairobi", "mombasa", "kisumu"),
}
TERMS = {
    "IN": (("gstin", 25), ("gst", 15), ("cgst", 20), ("sgst", 20), ("igst", 20), ("pan", 15), ("pin code", 15), ("pin", 10), ("inr", 10), ("₹", 20), ("rs", 10), ("rupees", 10), ("+91", 20)),
    "US": (("sales tax", 20), ("tax id", 15), ("ein", 15), ("zip", 15), ("zip code", 15), ("usd", 10), ("+1", 20), ("llc", 10), ("inc", 10)),
    "DE": (("mwst", 25), ("ust-idnr", 25), ("steuernummer", 20), ("umsatzsteuer", 20), ("rechnung", 15), ("quittung", 15), ("eur", 10), ("+49", 20), ("plz", 10)),
    "UK": (("vat", 25), ("vat number", 25), ("vat reg", 20), ("gbp", 10), ("+44", 20), ("postcode", 15)),
    "AE": (("aed", 10), ("+971", 20), ("dubai", 15), ("abu dhabi", 15)), "AU": (("abn", 25), ("acn", 20), ("gst", 20), ("aud", 10), ("+61", 20), ("postcode", 15)),
    "KE": (("kenya", 25), ("nairobi", 20), ("kes", 20), ("ksh", 15), ("+254", 20), ("kra", 20)), "JP": (("japan", 25), ("jpy", 20), ("+81", 20)), "BR": (("brazil", 25), ("brl", 20), ("cnpj", 25)),
}
STRONG = (
    ("IN", r"\b\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b", 45), ("IN", r"\bPAN\s*:?\s*[A-Z]{5}\d{4}[A-Z]\b", 25), ("IN", r"\bVAT\s+TIN\b", 30), ("FR", r"\bFR\s?[A-Z0-9]{2}\s?\d{9}\b", 40),
    ("IT", r"\bIT\s?\d{11}\b", 40), ("NL", r"\bNL\s?\d{9}B\d{2}\b", 40), ("US", r"\b(?:EIN|Tax\s*ID)\s*:?\s*\d{2}-\d{7}\b", 35), ("AE", r"\bTRN\s*:?\s*100\d{12}\b", 45), ("AU", r"\bABN\s*:?\s*\d{2}\s?\d{3}\s?\d{3}\s?\d{3}\b", 45),
)
CITY, CITY_CAP, TERM_CAP, LEAST, HIGH, GAP = 25, 35, 35, 30, 35, 25
COUNTRIES = tuple(sorted({c for c, *_ in (*POSTAL, *STRONG)} | CITIES.keys() | TERMS.keys()))


WORDS = tuple(sorted({w for words in CITIES.values() for w in words} | {w for words in TERMS.values() for w, _ in words}))


def known_words(norm: Column) -> Column:
    """The words of ``WORDS`` that stand between spaces of a text, or begin or end it; a word may be named twice."""
    listed = lambda words: F.array(*map(F.lit, words))
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    single = F.array_intersect(F.split(norm, " ", -1), listed([w for w in WORDS if " " not in w]))
    several = F.array_compact(F.array(*(F.when(padded.contains(f" {w} "), w) for w in WORDS if " " in w)))
    return F.concat(single, several, F.filter(listed(WORDS), lambda w: norm.startswith(w) | norm.endswith(w)))


def _fits(text: Column, lower: Column, pattern: str) -> Column:
    """Whether a pattern fits in any case; one that begins with letters is asked only where those are."""
    fits, lead = text.rlike("(?i)" + pattern), re.match(r"\\b([A-Z]{2,})", pattern)
    return lower.contains(lead[1].lower()) & fits if lead else fits


def scores(text: Column, lower: Column, words: Column) -> list[Column]:
    """Points of every country of ``COUNTRIES``, in order, of a text, its lower case and its ``known_words``."""
    out = []
    for country in COUNTRIES:
        points = F.lit(0)
        for c, pattern, weight in (*POSTAL, *STRONG):
            if c == country:
                points = points + F.when(_fits(text, lower, pattern), weight).otherwise(0)
        cities, terms = F.lit(0), F.lit(0)
        if country in CITIES:
            cities = F.size(F.array_intersect(words, F.array(*map(F.lit, CITIES[country])))) * CITY
        if country in TERMS:
            # a lookup by word, not a branch for each: so many branches make code that the JVM does not compile
            weights = F.create_map(*(F.lit(x) for pair in TERMS[country] for x in pair))
            held = F.array_intersect(words, F.array(*(F.lit(w) for w, _ in TERMS[country])))
            terms = F.aggregate(held, F.lit(0), lambda a, w: a + weights[w])
        out.append(points + F.least(cities, F.lit(CITY_CAP)) + F.least(terms, F.lit(TERM_CAP)))
    return out


def infer(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``country`` (UNKNOWN below the limits), ``confidence``, the best and second score, and whether signals are mixed."""
    ranked = F.sort_array(F.array(*(F.struct(s.alias("score"), F.lit(-i).alias("order"), F.lit(c).alias("country")) for i, (c, s) in enumerate(zip(COUNTRIES, scores(*map(F.col, ("t", "lower", "words"))), strict=True)))), asc=False)
    rows = documents.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("lower", F.lower("t"))
    # a text's words are looked up once, and the countries' words among the few that it has
    rows = rows.withColumn("norm", F.regexp_replace("lower", r"\s+", " ")).withColumn("words", known_words(F.col("norm"))).withColumn("r", ranked)
    top, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))["score"]
    mixed = (second > HIGH) & (top["score"] - second < GAP)
    raw = F.try_divide(top["score"] - second, F.greatest(top["score"], F.lit(1))) * 0.70 + F.least(F.lit(0.30), top["score"] / 100.0 * 0.40)
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw) - F.when(mixed, 0.20).otherwise(0.0))
    known = (top["score"] >= LEAST) & (confidence >= LEAST / 100.0)
    return rows.select(
        key, F.when(known, top["country"]).otherwise("UNKNOWN").alias("country"), F.when(known, F.round(confidence, 3)).otherwise(0.0).alias("confidence"),
        top["score"].alias("top_score"), second.alias("second_score"), mixed.alias("mixed"),
    )


def effective(rules: DataFrame, as_of: str, keys: list[str]) -> DataFrame:
    """The newest rule of every key that is in force on a day: no end, or an end not before it."""
    from pyspark.sql import Window as W

    day = F.lit(as_of).cast("date")
    live = rules.where((F.col("effective_to").isNull() | (F.to_date("effective_to") >= day)) & (F.to_date("effective_from") <= day))
    newest = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("effective_from")))
    return live.withColumn("__n", newest).where("__n = 1").drop("__n")


def expectations(documents: DataFrame, rules: DataFrame) -> DataFrame:
    """A document's expectation by country, else by region, else globally: successive left joins on small tables."""
    out = documents
    for scope, column in (("COUNTRY", F.col("country")), ("REGION", F.col("region")), ("GLOBAL", F.lit("*"))):
        own = rules.where(F.col("geo_scope") == scope).select(F.col("geo_code").alias(f"{scope}_code"), F.col("doc_subtype").alias(f"{scope}_type"), F.col("expects").alias(f"{scope}_expects"))
        out = out.join(own, (column == F.col(f"{scope}_code")) & (F.col("doc_subtype") == F.col(f"{scope}_type")), "left")
    return out.select(*documents.columns, F.coalesce("COUNTRY_expects", "REGION_expects", "GLOBAL_expects").alias("expects"), F.when(F.col("COUNTRY_expects").isNotNull(), "COUNTRY").when(F.col("REGION_expects").isNotNull(), "REGION").when(F.col("GLOBAL_expects").isNotNull(), "GLOBAL").alias("scope"))
