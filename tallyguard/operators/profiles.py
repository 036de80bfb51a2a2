"""What kind of document a text is, what its country's fields say, and how many addresses it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Words that speak for a subtype, with the subtype's weight in hundredths; a larger table is a parameter away.
KEYWORDS: dict[str, tuple[int, tuple[str, ...]]] = {
    "POS_RESTAURANT": (100, ("table", "server", "gratuity", "tip", "covers", "dine in", "restaurant", "cafe", "food", "beverage")),
    "POS_RETAIL": (90, ("pos", "terminal", "till", "cashier", "thank you", "change due", "qty", "sku", "barcode", "item", "discount", "store", "receipt")),
    "HOTEL_FOLIO": (100, ("folio", "room", "check-in", "check-out", "nightly rate", "guest", "front desk", "hotel", "resort")),
    "FUEL": (100, ("fuel", "petrol", "diesel", "litre", "liter", "pump", "nozzle", "price per litre", "odometer")),
    "PARKING": (90, ("parking", "slot", "entry time", "exit time", "duration", "license plate", "parking fee")),
    "TRANSPORT": (85, ("taxi", "ride", "trip", "fare", "driver", "boarding", "ticket", "train", "metro")),
    "MISC": (60, ("receipt", "cash memo", "bill")),
    "TAX_INVOICE": (100, ("tax invoice", "gstin", "gst", "hsn", "sac", "place of supply", "cgst", "sgst", "igst")),
    "COMMERCIAL_INVOICE": (100, ("commercial invoice", "incoterms", "hs code", "country of origin", "consignee", "exporter", "invoice no", "invoice number", "fob", "cif")),
    "SERVICE_INVOICE": (90, ("service invoice", "service period", "hours", "professional fee", "consulting", "maintenance")),
    "UTILITY": (95, ("electricity", "water bill", "gas bill", "meter", "kwh", "units consumed", "billing period", "account no")),
    "SHIPPING_BILL": (100, ("shipping bill", "sb no", "customs", "exporter", "ad code", "port of loading")),
    "PAYMENT_RECEIPT": (95, ("payment receipt", "paid", "payment successful", "transaction id", "txn id", "utr", "auth code")),
}
LOGISTICS, PAYMENT = ("SHIPPING_BILL",), ("PAYMENT_RECEIPT",)
#: Country fields: name and pattern; the first group is the value.
COUNTRY_FIELDS = {
    "mx_rfc": r"\b([A-Z&Ñ]{3,4}\d{6}[A-Z0-9]{3})\b", "mx_postal_code": r"C\.?P\.?\s*(\d{5})", "us_zip": r"\b[A-Z]{2}\s+(\d{5}(?:-\d{4})?)\b", "us_ein": r"\b(\d{2}-\d{7})\b",
    "in_gstin": r"\b(\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z])\b", "in_pin": r"\bpin\s*code?\s*:?\s*(\d{6})\b", "br_cnpj": r"\b(\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2})\b", "sa_vat": r"\b(3\d{13}3)\b",
}
# Characters of a block that are looked at, and candidates that are compared; None: all.
MAX_BLOCK, MAX_CANDIDATES = 250, 6


def profile(documents: DataFrame, key: str = "id", text: str = "full_text", table: dict[str, tuple[int, tuple[str, ...]]] = KEYWORDS) -> DataFrame:
    """Family, subtype and confidence: the subtype with the most weight of words, less for a close second."""
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    norm = F.trim(F.regexp_replace(F.regexp_replace(lower, r"(?U)[^\w\s/]", " "), r"\s+", " "))
    rows = documents.select(F.col(key), lower.alias("t"), norm.alias("n"))

    def one(order: int, subtype: str, weight: int, words: tuple[str, ...]) -> Column:
        hits = sum((F.when(F.col("t").contains(w) | F.col("n").contains(w), 1).otherwise(0) for w in words), F.lit(0))
        return F.struct((hits * weight).alias("score"), F.lit(-order).alias("order"), F.lit(subtype).alias("subtype"), hits.alias("hits"))

    ranked = F.sort_array(F.array(*(one(i, s, w, words) for i, (s, (w, words)) in enumerate(table.items()))), asc=False)
    rows = rows.withColumn("r", ranked)
    best, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))["score"]
    raw = F.least(F.lit(1.0), 0.25 + 0.16 * best["hits"])
    raw = F.when(second > 0, F.greatest(F.lit(0.0), raw - F.least(F.lit(0.65), 0.55 * F.try_divide(second, best["score"])))).otherwise(raw)
    few = best["hits"] <= 2
    raw = F.when(few & (best["subtype"] == "MISC"), F.least(raw, F.lit(0.45))).when(few & (best["subtype"] == "UTILITY"), F.least(raw, F.lit(0.35))).otherwise(raw)
    raw = F.when((best["hits"] >= 2) & best["subtype"].isin("COMMERCIAL_INVOICE", *LOGISTICS), F.greatest(raw, F.lit(0.55))).otherwise(raw)
    known = best["score"] > 0
    family = F.when(~known, "UNKNOWN").when(best["subtype"].isin(*LOGISTICS), "LOGISTICS").when(best["subtype"].isin(*PAYMENT), "PAYMENT").otherwise("TRANSACTIONAL")
    return rows.select(key, family.alias("family"), F.when(known, best["subtype"]).otherwise("UNKNOWN").alias("subtype"), F.when(known, F.round(raw, 6)).otherwise(0.0).alias("confidence"), best["hits"].cast("long").alias("hits"))


def country_fields(text: Column) -> dict[str, Column]:
    return {name: F.nullif(F.regexp_extract(text, "(?i)" + p, 1), F.lit("")) for name, p in COUNTRY_FIELDS.items()}


def address_blocks(text: Column, most: int | None = MAX_BLOCK) -> Column:
    """Windows of two to four lines with text, each once by its normal form, in order."""
    ls = F.filter(F.transform(F.split(text, r"\r?\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    block = lambda t: t if most is None else F.substring(t, 1, most)
    windows = F.flatten(F.transform(F.array(*map(F.lit, (2, 3, 4))), lambda w: F.when(F.size(ls) >= w, F.transform(F.sequence(F.lit(1), F.size(ls) - w + 1), lambda i: block(F.array_join(F.slice(ls, i, w), "\n")))).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(windows)


def multi_address(documents: DataFrame, key: str = "id", text: str = "text", max_block: int | None = MAX_BLOCK, max_candidates: int | None = MAX_CANDIDATES, keep: list[str] | None = None) -> DataFrame:
    """SINGLE, MULTIPLE or UNKNOWN, and how many distinct addresses a document has.

    The first ``max_candidates`` blocks with a plausible address, of which
    ``max_block`` characters are read (None: all), fold into groups:
    one is new if its postal code differs from every group's so far or, where
    one has none, it shares under four tenths of its words with each. ``keep`` names the columns that stay (None: ``key``).
    """
    def read(block: Column) -> Column:
        words = F.array_distinct(F.regexp_extract_all(F.lower(block), F.lit(r"\b[a-z]{4,}\b"), F.lit(0)))
        return F.struct(words.alias("words"), F.regexp_extract(block, r"\b(\d{4,6})\b", 1).alias("postal"))

    fit = F.filter(address_blocks(F.coalesce(F.col(text), F.lit("")), max_block), lambda block: X.address_score(block) >= 4)
    # all in the document's own row: nothing is dealt out by key and joined again
    held = documents.select("*", F.transform(F.slice(fit, 1, max_candidates or (1 << 31) - 1), read).alias("c"))

    def differs(a: Column, g: Column) -> Column:
        share = F.coalesce(F.try_divide(F.size(F.array_intersect(a["words"], g["words"])), F.size(F.array_union(a["words"], g["words"]))), F.lit(0.0))
        both = (a["postal"] != "") & (g["postal"] != "")
        return F.when(both, a["postal"] != g["postal"]).otherwise(share < 0.4)

    empty = F.filter("c", lambda x: F.lit(False))
    groups = F.aggregate("c", empty, lambda gs, a: F.when(F.forall(gs, lambda g: differs(a, g)), F.concat(gs, F.array(a))).otherwise(gs))
    counted = held.withColumn("n_addresses", F.size(groups).cast("long")).drop("c")
    n = F.col("n_addresses")
    return counted.select(*(keep or [key]), n, F.when(n == 0, "UNKNOWN").when(n == 1, "SINGLE").otherwise("MULTIPLE").alias("status"))
