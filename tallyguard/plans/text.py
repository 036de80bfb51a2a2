"""Queries of text functions over rendered receipts and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import text as X
from ..sources.views import ORACLE_VIEWS, view, with_views
from .registry import query

_AMOUNT = r"(?i)(?:^|[^\w])(?:₹|rs\.?|inr)?\s*([0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{1,2})?|[0-9]+(?:\.[0-9]{1,2})?)"


def _any(words, line: str = "x") -> str:
    return "(" + " OR ".join(f"contains(lower({line}), '{w}')" for w in words) + ")"


def _num(s: str) -> str:
    return f"TRY_CAST(regexp_replace(nullif({s}, ''), '[^0-9.]', '', 'g') AS DOUBLE)"


def _amt(line: str) -> str:
    return _num(f"regexp_extract({line}, '{_AMOUNT}', 1)")


_COLON = "CASE WHEN contains(x, ':') THEN string_split(x, ':')[-1] ELSE x END"


def _found(words, line: str = "x") -> str:
    return f"list_filter(list_transform(list_filter(ls, lambda x: {_any(words)}), lambda x: {_amt(line)}), lambda a: a IS NOT NULL)"


_ODD = " OR ".join(f"regexp_matches(trim(x), '{p}')" for p in X.NO_ITEM)
_ABOUT, _VALUE = f"trim(regexp_extract(trim(x), '{X.ITEM}', 1))", _num(f"regexp_extract(trim(x), '{X.ITEM}', 2)")
_ITEM = f"CASE WHEN length(trim(x)) >= 5 AND NOT ({_ODD}) AND length(regexp_replace(x, '\\P{{L}}', '', 'g')) >= 3 AND length({_ABOUT}) >= 3 AND NOT ({_ABOUT} = upper({_ABOUT}) AND {_ABOUT} <> lower({_ABOUT})) AND {_VALUE} > 0 THEN {_VALUE} END"
ORACLE_VIEWS["amounts"] = f"""SELECT id, (list_transform([list_filter(ls, lambda x: {_any(X.TOTAL_WORDS)})[-1]], lambda x: {_amt('x')}))[1] AS total, {_found(X.SUBTOTAL_WORDS)}[1] AS subtotal,
  list_filter({_found(X.SHIPPING_WORDS)}, lambda a: a > 0 AND a < 10000)[1] AS shipping, list_filter({_found(X.DISCOUNT_WORDS)}, lambda a: a > 0 AND a < 50000)[1] AS discount,
  CASE WHEN len({_found(X.TAX_WORDS, _COLON)}) > 0 THEN list_sum({_found(X.TAX_WORDS, _COLON)}) END AS tax,
  CAST(list_filter(list_transform(list_filter(ls, lambda x: {_any(X.TAX_WORDS)}), lambda x: regexp_extract(x, '(\\d+(?:\\.\\d+)?)\\s*%', 1)), lambda r: r <> '')[1] AS DOUBLE) AS tax_rate,
  {_found(X.GST_WORDS['cgst'], _COLON)}[-1] AS cgst, {_found(X.GST_WORDS['sgst'], _COLON)}[-1] AS sgst, list_filter(list_transform(ls, lambda x: {_ITEM}), lambda a: a IS NOT NULL) AS items
FROM (SELECT id, string_split(full_text, chr(10)) AS ls FROM {{receipts}})"""


def amounts(spark, sf):
    ls = F.col("ls")
    cols = {"total": X.total(ls), "subtotal": X.first_amount(ls, X.SUBTOTAL_WORDS), "shipping": X.first_amount(ls, X.SHIPPING_WORDS, 10000), "discount": X.first_amount(ls, X.DISCOUNT_WORDS, 50000),
            "tax": X.tax(ls), "tax_rate": X.tax_rate(ls), "cgst": X.gst(ls, "cgst"), "sgst": X.gst(ls, "sgst"), "items": X.item_amounts(ls)}
    rows = view(spark, sf, "receipts").select("id", "full_text", X.lines(F.col("full_text")).alias("ls"))
    return rows.select("id", "full_text", *(c.alias(k) for k, c in cols.items()))


@query("receipt_amounts", with_views("SELECT id, total, subtotal, shipping, discount, tax, tax_rate, cgst, sgst FROM {amounts}"))
def receipt_amounts(spark, sf):
    return amounts(spark, sf).drop("items", "full_text")


@query("line_items", with_views("SELECT id, len(items) AS n_items, round(coalesce(list_sum(items), 0), 4) AS items_sum, CAST(CASE WHEN len(items) = 0 THEN 0.0 WHEN len(items) = 1 THEN 0.3 WHEN len(items) <= 3 THEN 0.6 ELSE 0.8 END AS DOUBLE) AS confidence FROM {amounts}"))
def line_items(spark, sf):
    n = F.size("items")
    return amounts(spark, sf).select("id", n.cast("long").alias("n_items"), F.round(F.aggregate("items", F.lit(0.0), lambda a, x: a + x), 4).alias("items_sum"), X.item_confidence(n).alias("confidence"))


@query("receipt_ids", with_views("""SELECT id, regexp_extract(full_text, 'Invoice No: (\\w+)', 1) AS invoice_no, regexp_extract(full_text, 'GSTIN: (\\w+)', 1) AS gstin, regexp_matches(full_text, '\\b(20\\d{2})[-/]([0-1]?\\d)[-/]([0-3]?\\d)\\b|\\b\\d{4}\\s*[/-]\\s*\\d{1,2}\\s*[/-]\\s*\\d{1,2}\\b') AS has_date FROM {receipts}"""))
def receipt_ids(spark, sf):
    t = F.col("full_text")
    return view(spark, sf, "receipts").select("id", F.regexp_extract(t, r"Invoice No: (\w+)", 1).alias("invoice_no"), F.regexp_extract(t, r"GSTIN: (\w+)", 1).alias("gstin"), X.has_date(t).alias("has_date"))


@query("text_stats", """SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, length(text) AS n_chars, round(len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 0 AND 2 * length(regexp_replace(x, '[^0-9]', '', 'g')) >= length(x))) / len(string_split(text, chr(10))), 6) AS numeric_line_ratio,
  len(list_distinct(string_split(text, ''))) AS n_unique_chars, round(length(regexp_replace(text, '[^A-Z]', '', 'g')) / nullif(length(regexp_replace(text, '[^A-Za-z]', '', 'g')), 0), 6) AS uppercase_ratio FROM documents""")
def text_stats(spark, sf):
    t, ls = F.col("text"), X.lines(F.col("text"))
    numeric = F.filter(ls, lambda x: (F.length(x) > 0) & (2 * X.count_of(x, "0-9") >= F.length(x)))
    return view(spark, sf, "documents").select(
        "doc_id", F.size(ls).cast("long").alias("n_lines"), F.length(t).cast("long").alias("n_chars"), F.round(F.size(numeric) / F.size(ls), 6).alias("numeric_line_ratio"),
        F.size(F.array_distinct(F.split(t, ""))).cast("long").alias("n_unique_chars"), F.round(F.try_divide(X.count_of(t, "A-Z"), X.count_of(t, "A-Za-z")), 6).alias("uppercase_ratio"),
    )


@query("spacing_anomalies", with_views("""SELECT id, coalesce(list_max(runs), 0) AS max_spaces, len(list_filter(runs, lambda r: r >= 3)) AS n_excessive, round(list_sum(gaps) / len(gaps), 6) AS avg_gap,
  round((list_sum(list_transform(gaps, lambda g: g * g)) * len(gaps) - list_sum(gaps) * list_sum(gaps)) / (len(gaps) * len(gaps)), 6) AS gap_variance FROM (
  SELECT id, flatten(list_transform(ls, lambda x: list_transform(regexp_extract_all(x, ' {2,}'), lambda r: length(r)))) AS runs, flatten(list_transform(ls, lambda x: list_transform(regexp_extract_all(trim(x), '\\s+'), lambda r: length(r)))) AS gaps
  FROM (SELECT id, list_filter(string_split(full_text, chr(10)), lambda x: length(trim(x)) >= 3) AS ls FROM {receipts}))"""))
def spacing_anomalies(spark, sf):
    s = X.spacing(F.col("full_text"))
    return view(spark, sf, "receipts").select("id", s["max_spaces"].cast("long").alias("max_spaces"), s["n_excessive"].cast("long").alias("n_excessive"), F.round(s["avg_gap"], 6).alias("avg_gap"), F.round(s["gap_variance"], 6).alias("gap_variance"))


_CONV = ", ".join(f"length(text) - length(regexp_replace(text, '[{c}]', '', 'g')) AS {n}" for n, c in {"alpha": r"\p{L}", **X.SCRIPTS}.items())


@query("script_stats", f"SELECT conv_id, turn, {_CONV} FROM conversations")
def script_stats(spark, sf):
    counts = X.script_counts(F.col("text"))
    return view(spark, sf, "conversations").select("conv_id", "turn", *(c.cast("long").alias(k) for k, c in counts.items()))


@query("language_by_script", f"""SELECT doc_id, CASE WHEN alpha < {X.MIN_ALPHA} OR latin >= {X.DOMINANT} * alpha THEN NULL WHEN arabic >= {X.DOMINANT} * alpha THEN 'ar' WHEN cyrillic >= {X.DOMINANT} * alpha THEN 'ru' WHEN hangul >= {X.DOMINANT} * alpha THEN 'ko'
  WHEN hebrew >= {X.DOMINANT} * alpha THEN 'he' WHEN hiragana >= {X.DOMINANT} * alpha OR katakana >= {X.DOMINANT} * alpha THEN 'ja' WHEN han >= {X.DOMINANT} * alpha THEN CASE WHEN hiragana + katakana >= 0.02 * alpha THEN 'ja' ELSE 'zh' END END AS lang_hint, alpha, latin FROM (
  SELECT doc_id, {_CONV} FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'абвгдежзийклмнопрстуфхцчшщ') WHEN 2 THEN translate(lower(text), 'aehinorst', '的一是不了人我在有') ELSE translate(lower(text), 'abcdefghij', 'ابتثجحخدذر') END AS text FROM documents))""")
def language_by_script(spark, sf):
    t, k = F.lower("text"), F.col("doc_id") % 5
    text = F.when(k == 0, F.col("text")).when(k == 1, F.translate(t, "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщ")).when(k == 2, F.translate(t, "aehinorst", "的一是不了人我在有")).otherwise(F.translate(t, "abcdefghij", "ابتثجحخدذر"))
    counted = view(spark, sf, "documents").select("doc_id", text.alias("text")).select("doc_id", *(c.cast("long").alias(n) for n, c in X.script_counts(F.col("text")).items()))
    most = lambda n: F.col(n) >= X.DOMINANT * F.col("alpha")
    hint = F.when((F.col("alpha") < X.MIN_ALPHA) | most("latin"), None)
    for script, lang in X.SCRIPT_LANGUAGES.items():
        hint = hint.when(most(script), lang)
    hint = hint.when(most("han"), F.when(F.col("hiragana") + F.col("katakana") >= X.KANA * F.col("alpha"), "ja").otherwise("zh"))
    return counted.select("doc_id", hint.alias("lang_hint"), "alpha", "latin")


_CODES = "list_distinct(list_filter([" + ", ".join([f"CASE WHEN regexp_matches(text, '{p}') THEN '{c}' END" for p, c in X.SYMBOLS] + [f"CASE WHEN regexp_matches(text, '(?i)\\b{w}\\b') THEN '{c}' END" for w, c in X.CODES]) + "], lambda x: x IS NOT NULL))"


@query("currency_symbols", f"SELECT doc_id, array_to_string(list_sort({_CODES}), ',') AS codes, len({_CODES}) AS n_codes FROM documents")
def currency_symbols(spark, sf):
    found = X.currencies(F.col("text"))
    return view(spark, sf, "documents").select("doc_id", found.alias("c")).select("doc_id", F.array_join(F.sort_array("c"), ",").alias("codes"), F.size("c").cast("long").alias("n_codes"))


def _word_sql(words) -> str:
    return "regexp_matches(lower(t), '\\b(?:" + "|".join(words) + ")\\b')"


_POSTAL = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN {n}" for p, n in X.POSTAL) + " WHEN regexp_matches(lower(t), '\\b[a-zA-Z0-9]{4,8}\\b') THEN 1 ELSE 0 END"
_ASCII = [w for w in X.STREET if w.isascii()]


@query("address_score", f"""SELECT *, CASE WHEN score < 3 THEN 'NOT_AN_ADDRESS' WHEN score = 3 THEN 'WEAK_ADDRESS' WHEN score <= 5 THEN 'PLAUSIBLE_ADDRESS' ELSE 'STRONG_ADDRESS' END AS class FROM (SELECT c_custkey AS id, CAST(CASE WHEN length(t) < 10 THEN 0 ELSE CASE WHEN {_word_sql(_ASCII)} THEN 2 ELSE 0 END + CASE WHEN {_word_sql(X.UNIT)} THEN 1 ELSE 0 END
  + CASE WHEN len(regexp_extract_all(lower(t), '\\b[a-zA-Z]{{4,}}\\b')) >= 3 THEN 2 WHEN len(regexp_extract_all(lower(t), '\\b[a-zA-Z]{{4,}}\\b')) >= 2 THEN 1 ELSE 0 END + {_POSTAL} + CASE WHEN {_word_sql(X.PLACES)} THEN 1 ELSE 0 END END AS INT) AS score
  FROM (SELECT c_custkey, concat(CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey AS VARCHAR) || ' Main Street' WHEN 1 THEN 'Flat ' || c_custkey || ', Nagar' WHEN 2 THEN c_mktsegment ELSE 'PO box' END, CASE c_custkey % 3 WHEN 0 THEN ', Pune 411001, India' WHEN 1 THEN ', London SW1A 1AA' ELSE ' x' END) AS t FROM customer))""")
def address_score(spark, sf):
    k = F.col("c_custkey")
    street = F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit(" Main Street"))).when(k % 4 == 1, F.concat(F.lit("Flat "), k.cast("string"), F.lit(", Nagar"))).when(k % 4 == 2, F.col("c_mktsegment")).otherwise("PO box")
    city = F.when(k % 3 == 0, ", Pune 411001, India").when(k % 3 == 1, ", London SW1A 1AA").otherwise(" x")
    score = X.address_score(F.col("t"))
    return view(spark, sf, "customer").select(k.alias("id"), F.concat(street, city).alias("t")).select("id", score.alias("score"), X.address_class(score).alias("class"))


_REP = " OR ".join(f"contains(d, '{str(i) * 5}')" for i in range(10))
_LAND = ", ".join(f"'{c}'" for c in I.LANDLINES)
_SEQ = " OR ".join(f"contains(d, '{s}')" for s in I.SEQUENCES)


@query("phone_check", with_views(f"""SELECT id, d AS digits, CAST(greatest(0, 10 - off) AS DOUBLE) / 10.0 AS confidence, 10 - off > 5 AS valid, repeated, sequential FROM (SELECT id, d, {_REP} AS repeated, {_SEQ} AS sequential,
  CASE WHEN length(d) = 10 AND d[1] NOT IN ('6', '7', '8', '9') THEN 4 WHEN length(d) <> 10 AND NOT (length(d) = 11 AND d[1] = '0') THEN 5 WHEN length(d) = 11 AND d[2:3] NOT IN ({_LAND}) AND d[2:4] NOT IN ({_LAND}) THEN 3 ELSE 0 END + CASE WHEN {_REP} THEN 5 ELSE 0 END + CASE WHEN {_SEQ} THEN 6 ELSE 0 END + CASE WHEN length(replace(d, d[1], '')) = 0 THEN 8 ELSE 0 END
  + CASE WHEN d IN ('1234567890', '9999999999', '0000000000', '1111111111') THEN 9 ELSE 0 END AS off FROM (SELECT id, CASE WHEN id % 3 = 0 THEN regexp_extract(full_text, 'Phone: (\\d+)', 1) WHEN id % 3 = 1 THEN CAST(id * 11111 AS VARCHAR) WHEN id % 2 = 0 THEN lpad(CAST(id AS VARCHAR), 10, '12345') ELSE '0' || CASE WHEN id % 7 = 0 THEN '22' ELSE '23' END || lpad(CAST(id AS VARCHAR), 8, '4') END AS d FROM {{receipts}}))"""))
def phone_check(spark, sf):
    own = F.regexp_extract("full_text", r"Phone: (\d+)", 1)
    raw = F.when(F.col("id") % 3 == 0, F.concat(F.lit("+91 "), own)).when(F.col("id") % 3 == 1, (F.col("id") * 11111).cast("string")).when(F.col("id") % 2 == 0, F.lpad(F.col("id").cast("string"), 10, "12345")).otherwise(F.concat(F.lit("0"), F.when(F.col("id") % 7 == 0, "22").otherwise("23"), F.lpad(F.col("id").cast("string"), 8, "4")))
    checked = I.indian_phone(F.col("raw"))
    return view(spark, sf, "receipts").select("id", raw.alias("raw")).select("id", *(c.alias(n) for n, c in checked.items()))


_ISSUE = "CASE WHEN length(g) <> 15 THEN 'wrong_length' WHEN NOT regexp_matches(g[1:2], '^\\d{2}$') THEN 'non_numeric_state_code' WHEN CAST(g[1:2] AS INT) NOT BETWEEN 1 AND 38 THEN 'invalid_state_code' WHEN NOT regexp_matches(g[3:12], '^[A-Z]{5}\\d{4}[A-Z]$') THEN 'invalid_pan_format' WHEN NOT regexp_matches(g[13], '[1-9Z]') THEN 'invalid_entity_code' WHEN g[14] <> 'Z' THEN 'missing_z_at_pos14' END"
_GSTIN = "concat(lpad(CAST(o_custkey % 45 AS VARCHAR), 2, '0'), CASE WHEN o_orderkey % 7 = 0 THEN 'AB1DE' ELSE 'ABCDE' END, lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0'), 'F', CAST(o_orderkey % 10 AS VARCHAR), CASE WHEN o_orderkey % 11 = 0 THEN 'Y' ELSE 'Z' END, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE CAST(o_custkey % 10 AS VARCHAR) END)"
_PART = f"(strpos('{I.ALPHABET}', g[i]) - 1) * CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END"


@query("gstin_check", f"""SELECT o_orderkey AS id, g AS gstin, {_ISSUE} AS issue, '{I.ALPHABET}'[CAST((36 - list_sum(list_transform(range(1, 15), lambda i: ({_PART}) // 36 + ({_PART}) % 36)) % 36) % 36 AS BIGINT) + 1] AS check_digit FROM (SELECT o_orderkey, {_GSTIN} AS g FROM orders)""")
def gstin_check(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    g = F.concat(F.lpad((c % 45).cast("string"), 2, "0"), F.when(k % 7 == 0, "AB1DE").otherwise("ABCDE"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("F"), (k % 10).cast("string"), F.when(k % 11 == 0, "Y").otherwise("Z"), F.when(k % 13 == 0, "").otherwise((c % 10).cast("string")))
    return view(spark, sf, "orders").select(k.alias("id"), g.alias("gstin")).select("id", "gstin", I.gstin_issue(F.col("gstin")).alias("issue"), I.gstin_check_digit(F.col("gstin")).alias("check_digit"))


# Words whose misspellings count.
KEYWORDS = ("total", "subtotal", "amount", "maximum", "invoice", "receipt", "payment", "balance", "discount", "quantity", "shipping", "service", "workshop")
_SPOILT = "CASE id % 5 WHEN 0 THEN replace(full_text, 'Total', 'Totla') WHEN 1 THEN replace(full_text, 'Invoice', 'Invoise') WHEN 2 THEN replace(full_text, 'service', 'servise') ELSE full_text END"


@query("keyword_typos", with_views(f"""SELECT id, count(*) AS n_typos, CAST(least(40, 20 * count(*)) AS DOUBLE) / 100 AS score, string_agg(k || ':' || w || ':' || levenshtein(w, k), ',' ORDER BY k, w) AS typos FROM (
  SELECT id, lower(t) AS t, unnest(list_distinct(regexp_extract_all(lower(t), '[a-z0-9_]+'))) AS w FROM (SELECT id, {_SPOILT} AS t FROM {{receipts}})) d,
  (SELECT unnest([{", ".join(f"'{k}'" for k in KEYWORDS)}]) AS k) WHERE NOT contains(t, k) AND contains(t, k[1:4]) AND abs(length(w) - length(k)) <= 2 AND levenshtein(w, k) IN (1, 2) GROUP BY id"""))
def keyword_typos(spark, sf):
    rule = F.col("id") % 5
    spoilt = F.when(rule == 0, F.replace("full_text", F.lit("Total"), F.lit("Totla"))).when(rule == 1, F.replace("full_text", F.lit("Invoice"), F.lit("Invoise"))).when(rule == 2, F.replace("full_text", F.lit("service"), F.lit("servise"))).otherwise(F.col("full_text"))
    rows = view(spark, sf, "receipts").select("id", F.lower(spoilt).alias("t"))
    tokens = rows.withColumn("w", F.array_distinct(F.regexp_extract_all("t", F.lit("[a-z0-9_]+"), F.lit(0))))

    def near(k: str):
        ok = ~F.col("t").contains(k) & F.col("t").contains(k[:4])
        found = F.filter("w", lambda w: (F.abs(F.length(w) - len(k)) <= 2) & F.levenshtein(w, F.lit(k)).isin(1, 2))
        return F.when(ok, F.transform(F.sort_array(found), lambda w: F.concat(F.lit(f"{k}:"), w, F.lit(":"), F.levenshtein(w, F.lit(k)).cast("string")))).otherwise(F.array().cast("array<string>"))

    typos = tokens.select("id", F.concat(*(near(k) for k in sorted(KEYWORDS))).alias("typos")).where(F.size("typos") > 0)
    return typos.select("id", F.size("typos").cast("long").alias("n_typos"), (F.least(F.lit(40), 20 * F.size("typos")) / 100.0).alias("score"), F.array_join("typos", ",").alias("typos"))
