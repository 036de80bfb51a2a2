"""Text functions over one document: lines, amounts, dates, currency, spacing, scripts, addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, keyword lists and thresholds.
AMOUNT = r"(?iU)(?<!\w)(?:₹|rs\.?|inr)?\s*([0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{1,2})?|[0-9]+(?:\.[0-9]{1,2})?)"
TOTAL_WORDS = ("total", "grand total", "amount payable", "amount due", "net total", "balance due")
SUBTOTAL_WORDS = ("subtotal", "sub total", "sub-total", "amount before tax")
SHIPPING_WORDS = ("shipping", "freight", "delivery", "handling", "postage")
DISCOUNT_WORDS = ("discount", "promo", "coupon", "rebate", "savings", "off")
TAX_WORDS = ("gst", "cgst", "sgst", "igst", "cess", "central gst", "state gst", "integrated gst", "tax", "vat", "sales tax", "service tax", "excise")
GST_WORDS = {"cgst": ("cgst", "central gst"), "sgst": ("sgst", "state gst"), "igst": ("igst", "integrated gst"), "cess": ("cess",)}
NO_ITEM = (
    r"\b\d{5,}\b", r"\b[A-Z]{2}\s+\d{5}", r"^[A-Z\s]{3,}$", r"(?i)\b(total|subtotal|tax|discount|balance|amount|due|paid)\b",
    r"(?i)\b(invoice|receipt|bill|order)\s*#?\s*\d+", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", r"\b\d{1,2}:\d{2}",
    r"(?i)\b(po number|purchase order)\b", r"(?i)\b(quote|quotation)\b", r"(?i)\b(proforma|commercial invoice)\b",
)
ITEM = r"^(.{5,})\s+([0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{1,2})?)\s*$"
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DATES = (
    r"\b([0-3]?\d)[/-]([0-1]?\d)[/-]((?:20)?\d{2})\b", r"\b(20\d{2})[-/]([0-1]?\d)[-/]([0-3]?\d)\b", r"\b\d{1,2}\s*[/-]\s*\d{1,2}\s*[/-]\s*\d{2,4}\b",
    r"\b\d{4}\s*[/-]\s*\d{1,2}\s*[/-]\s*\d{1,2}\b", rf"(?i)\b\d{{1,2}}\s+(?:{MONTHS})[a-z]*\s+\d{{2,4}}\b", rf"(?i)\b(?:{MONTHS})[a-z]*\.?\s+\d{{1,2}},?\s+\d{{2,4}}\b",
)
SYMBOLS = (("₹", "INR"), (r"\$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"), ("₩", "KRW"), ("₱", "PHP"), ("₫", "VND"), ("₦", "NGN"), ("฿", "THB"), (r"R\$", "BRL"))
CODE_NAMES = (
    "KES", "NGN", "ZAR", "TZS", "UGX", "GHS", "ETB", "INR", "JPY", "KRW", "IDR", "VND",
    "PHP", "THB", "MYR", "SGD", "HKD", "TWD", "PKR", "BDT", "LKR", "MMK", "CNY", "USD",
    "CAD", "MXN", "BRL", "COP", "CLP", "ARS", "PEN", "EUR", "GBP", "CHF", "SEK", "NOK",
    "DKK", "PLN", "CZK", "HUF", "RON", "RUB", "TRY", "AED", "SAR", "QAR", "OMR", "BHD",
    "KWD", "JOD", "ILS", "AUD", "NZD", "FJD",
)
CODES = (("Rs", "INR"), ("Rp", "IDR"), ("KSh", "KES"), ("RM", "MYR"), ("RMB", "CNY")) + tuple((c, c) for c in CODE_NAMES)
SCRIPTS = {
    "arabic": "؀-ۿݐ-ݿࢠ-ࣿ", "hebrew": "֐-׿", "cyrillic": "Ѐ-ԯ", "han": "一-鿿㐀-䶿", "hiragana": "぀-ゟ",
    "katakana": "゠-ヿ", "hangul": "가-힯ᄀ-ᇿ", "latin": "A-Za-zÀ-ÖØ-öø-ɏ",
}
SCRIPT_LANGUAGES = {"arabic": "ar", "hebrew": "he", "cyrillic": "ru", "hangul": "ko", "hiragana": "ja", "katakana": "ja"}
MIN_ALPHA, DOMINANT, KANA = 30, 0.60, 0.02
STREET = (
    "street", "st", "road", "rd", "avenue", "ave", "boulevard", "blvd", "lane", "ln", "drive", "dr",
    "way", "circle", "cir", "court", "ct", "place", "pl", "terrace", "ter", "parkway", "pkwy", "highway",
    "hwy", "nagar", "marg", "path", "gali", "colony", "sector", "cross", "main", "layout", "extension", "phase",
    "souq", "souk", "corniche", "madinat", "rue", "strasse", "straße", "calle", "via", "piazza", "platz", "allee",
    "paseo", "avenida", "rua", "block", "plot", "complex", "tower", "junction",
)
UNIT = (
    "apt", "apartment", "suite", "ste", "unit", "floor", "fl", "building", "bldg", "no", "room", "rm",
    "flat", "house", "villa", "plot", "shop", "office", "warehouse", "godown",
)
PLACES = (
    "usa", "canada", "india", "uk", "australia", "germany", "france", "italy", "spain", "japan", "china", "brazil", "mexico", "singapore", "malaysia", "thailand",
    "indonesia", "philippines", "south africa", "nigeria", "egypt", "turkey", "pakistan", "bangladesh", "sri lanka", "nepal", "california", "texas", "new york",
    "florida", "illinois", "delhi", "mumbai", "bangalore", "bengaluru", "hyderabad", "chennai", "kolkata", "pune", "ahmedabad", "jaipur", "lucknow", "maharashtra",
    "karnataka", "telangana", "tamil nadu", "kerala", "gujarat", "rajasthan", "uttar pradesh", "west bengal", "dubai", "abu dhabi", "sharjah", "riyadh", "jeddah",
    "doha", "muscat", "manama", "kuwait", "london", "paris", "berlin", "rome", "madrid", "amsterdam", "zurich", "geneva", "vienna", "brussels", "bangkok", "jakarta",
    "kuala lumpur", "manila", "ho chi minh", "toronto", "vancouver", "sydney", "melbourne", "auckland", "johannesburg", "cape town", "lagos", "nairobi",
)
POSTAL = ((r"\b[1-9]\d{5}\b", 2), (r"\b\d{5}(-\d{4})?\b", 2), (r"(?i)\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b", 2), (r"(?i)\b[A-Z]\d[A-Z]\s*\d[A-Z]\d\b", 2), (r"\b\d{4,5}\b", 1), (r"\b\d{3}-\d{4}\b", 2))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def number(text: Column) -> Column:
    """The number in a match: commas and signs dropped; null if there is none."""
    return F.regexp_replace(F.nullif(text, F.lit("")), "[^0-9.]", "").try_cast("double")


def amount(line: Column) -> Column:
    """The first amount of a line."""
    return number(F.regexp_extract(line, AMOUNT, 1))


def has_any(line: Column, words) -> Column:
    lower, out = F.lower(line), F.lit(False)
    for w in words:
        out = out | lower.contains(w)
    return out


def first_amount(all_lines: Column, words, most: float | None = None) -> Column:
    """The amount of the first line with one of the words and a valid amount."""
    found = F.transform(F.filter(all_lines, lambda x: has_any(x, words)), amount)
    valid = F.filter(found, lambda a: a.isNotNull() & ((a > 0) & (a < most) if most else F.lit(True)))
    return F.get(valid, F.lit(0))


def total(all_lines: Column) -> Column:
    """The amount of the last line with a word for totals."""
    found = F.filter(all_lines, lambda x: has_any(x, TOTAL_WORDS))
    return amount(F.get(found, F.size(found) - 1))


def _after_colon(line: Column) -> Column:
    return F.when(line.contains(":"), F.element_at(F.split(line, ":", -1), -1)).otherwise(line)


def tax(all_lines: Column) -> Column:
    """Sum of the amounts of all tax lines, after the last colon if there is one; null without any."""
    found = F.transform(F.filter(all_lines, lambda x: has_any(x, TAX_WORDS)), lambda x: amount(_after_colon(x)))
    some = F.filter(found, lambda a: a.isNotNull() & (a != 0))
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, x: a + x))


def tax_rate(all_lines: Column) -> Column:
    """The first rate in per cent on a tax line."""
    found = F.transform(F.filter(all_lines, lambda x: has_any(x, TAX_WORDS)), lambda x: F.regexp_extract(x, r"(\d+(?:\.\d+)?)\s*%", 1))
    return F.get(F.filter(found, lambda r: r != ""), F.lit(0)).cast("double")


def gst(all_lines: Column, part: str) -> Column:
    """The last amount of a component of Indian tax."""
    found = F.filter(F.transform(F.filter(all_lines, lambda x: has_any(x, GST_WORDS[part])), lambda x: amount(_after_colon(x))), lambda a: a.isNotNull())
    return F.get(found, F.size(found) - 1)


def item_amounts(all_lines: Column) -> Column:
    """Amounts of lines that look like an item: some text, then an amount at the end."""

    def item(line: Column) -> Column:
        about, value = F.trim(F.regexp_extract(line, ITEM, 1)), number(F.regexp_extract(line, ITEM, 2))
        letters = F.length(F.regexp_replace(line, r"\P{L}", ""))
        odd = F.lit(False)
        for pattern in NO_ITEM:
            odd = odd | line.rlike(pattern)
        shout = (about == F.upper(about)) & (about != F.lower(about))
        return F.when((F.length(line) >= 5) & ~odd & (letters >= 3) & (F.length(about) >= 3) & ~shout & (value > 0), value)

    return F.filter(F.transform(all_lines, lambda x: item(F.trim(x))), lambda a: a.isNotNull())


def item_confidence(n: Column) -> Column:
    return F.when(n == 0, 0.0).when(n == 1, 0.3).when(n <= 3, 0.6).otherwise(0.8)


def has_date(text: Column) -> Column:
    out = F.lit(False)
    for pattern in DATES:
        out = out | text.rlike(pattern)
    return out


def currencies(text: Column) -> Column:
    """Codes of all currencies in a text, symbols first, each once."""
    found = [F.when(text.rlike(p), code) for p, code in SYMBOLS] + [F.when(text.rlike(rf"(?i)\b{word}\b"), code) for word, code in CODES]
    return F.array_distinct(F.array_compact(F.array(*found)))


def spacing(text: Column) -> dict[str, Column]:
    """Runs of spaces and the mean and variance of the gaps between words."""
    rows = F.filter(lines(text), lambda x: F.length(F.trim(x)) >= 3)
    runs = F.flatten(F.transform(rows, lambda x: F.transform(F.regexp_extract_all(x, F.lit(" {2,}"), F.lit(0)), F.length)))
    gaps = F.flatten(F.transform(rows, lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"(?<=\S)\s+(?=\S)"), F.lit(0)), F.length)))
    n = F.size(gaps)
    one = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)
    two = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g.cast("long") * g)
    most = F.coalesce(F.array_max(runs), F.lit(0))
    mean = F.try_divide(one, n)
    variance = F.try_divide(two * n - one * one, n.cast("long") * n)
    return {
        "max_spaces": most,
        "n_excessive": F.size(F.filter(runs, lambda r: r >= 3)),
        "avg_gap": mean,
        "gap_variance": variance,
        "excessive": (most >= 3) & (n > 0),
        "inconsistent": F.coalesce((variance > 10) & (mean > 2), F.lit(False)),
    }


def count_of(text: Column, chars: str) -> Column:
    """How many code points of a class a text has."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]", ""))


def script_counts(text: Column) -> dict[str, Column]:
    counts = {name: count_of(text, chars) for name, chars in SCRIPTS.items()}
    return {"alpha": count_of(text, r"\p{L}"), **counts}


def address_score(text: Column) -> Column:
    """Points for a street, a unit, words like places, a postal code and a known place."""
    lower = F.lower(text)

    def any_word(words) -> Column:
        return lower.rlike(r"(?U)\b(?:" + "|".join(words) + r")\b")

    places = F.regexp_count(lower, F.lit(r"(?U)\b[a-zA-Z]{4,}\b"))
    postal = F.when(lower.rlike(r"(?U)\b[a-zA-Z0-9]{4,8}\b"), 1).otherwise(0)
    for pattern, points in reversed(POSTAL):
        postal = F.when(text.rlike("(?U)" + pattern), points).otherwise(postal)
    score = F.when(any_word(STREET), 2).otherwise(0) + F.when(any_word(UNIT), 1).otherwise(0) + F.when(places >= 3, 2).when(places >= 2, 1).otherwise(0) + postal
    return F.when(F.length(text) >= 10, score + F.when(any_word(PLACES), 1).otherwise(0)).otherwise(0)


def address_class(score: Column) -> Column:
    return F.when(score < 3, "NOT_AN_ADDRESS").when(score == 3, "WEAK_ADDRESS").when(score <= 5, "PLAUSIBLE_ADDRESS").otherwise("STRONG_ADDRESS")
