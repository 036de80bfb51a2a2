"""Queries of lines and their order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import lines as L
from ..sources.views import ORACLE_VIEWS, VIEWS, view, with_views
from . import text as _text
from .registry import query

#: Receipts of which some have their total on top, and some a label alone on its line.
VIEWS["laid_out"] = """SELECT id, CASE WHEN id % 4 = 0 THEN concat_ws(chr(10), 'Grand Total: 99.00', full_text) WHEN id % 4 = 1 THEN concat_ws(chr(10), full_text, 'Due Date:', '2001-01-01', 'Thank you') ELSE full_text END AS full_text FROM {receipts}"""
ORACLE_VIEWS["numbered"] = "SELECT id, i - 1 AS line_no, ls[i] AS x FROM (SELECT id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT id, string_split(full_text, chr(10)) AS ls FROM {laid_out}))"
_TOTAL = f"{_text._any(X.TOTAL_WORDS)} AND NOT {_text._any(X.SUBTOTAL_WORDS)}"


@query("structure_order", with_views(f"""SELECT *, coalesce(n_lines >= 5 AND n_items >= 2 AND first_total < first_item, false) AS out_of_order FROM (SELECT id, count(*) AS n_lines, CAST(min(line_no) FILTER ({_TOTAL}) AS INT) AS first_total, CAST(min(line_no) FILTER (({_text._ITEM}) IS NOT NULL) AS INT) AS first_item,
  count(*) FILTER (({_text._ITEM}) IS NOT NULL) AS n_items FROM {{numbered}} WHERE trim(x) <> '' GROUP BY id)"""))
def structure_order(spark, sf):
    return L.structure_order(view(spark, sf, "laid_out"))


@query("labelled_values", with_views("""SELECT id, CAST(line_no AS INT) AS line_no, CASE WHEN own <> '' THEN own ELSE trim(below) END AS value, own = '' AS from_below FROM (SELECT *, trim(regexp_extract(x, '^[^:]*:(.*)$', 1)) AS own, lead(x) OVER (PARTITION BY id ORDER BY line_no) AS below FROM {numbered}) WHERE starts_with(lower(x), 'due date') OR starts_with(lower(x), 'date')"""))
def labelled_values(spark, sf):
    rows = view(spark, sf, "laid_out")
    return L.labelled_values(rows, "due date").union(L.labelled_values(rows, "date"))


_SCORE = f"CASE WHEN length(x) - length(regexp_replace(x, '\\p{{L}}', '', 'g')) >= 3 THEN 4 ELSE 0 END + (10 - line_no) + CASE WHEN regexp_matches(lower(x), '\\b(ltd|llc|inc|gmbh|store|stores|motors|market|supplier)\\b|supplier#') THEN 6 ELSE 0 END - CASE WHEN length(regexp_replace(x, '[^0-9]', '', 'g')) > length(x) - length(regexp_replace(x, '\\p{{L}}', '', 'g')) THEN 5 ELSE 0 END - CASE WHEN {_text._any(L.TITLES)} THEN 8 ELSE 0 END"


@query("merchant_guess", with_views(f"""SELECT id, trim(x) AS merchant, CAST(score AS INT) AS score, CAST(score - coalesce(second, 0) AS INT) AS margin FROM (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM (SELECT *, {_SCORE} AS score FROM {{numbered}} WHERE line_no < 10 AND trim(x) <> '') WINDOW w AS (PARTITION BY id ORDER BY score DESC, line_no)) WHERE n = 1"""))
def merchant_guess(spark, sf):
    return L.merchant_guess(view(spark, sf, "laid_out"))


@query("document_type", with_views(f"""SELECT id, CASE WHEN {_text._any(L.TAX_INVOICE_WORDS)} AND NOT {_text._any(L.RECEIPT_WORDS)} THEN 'tax_invoice' WHEN {_text._any(L.INVOICE_WORDS)} AND {_text._any(L.RECEIPT_WORDS)} THEN 'ambiguous' WHEN {_text._any(L.INVOICE_WORDS)} THEN 'invoice' WHEN {_text._any(L.RECEIPT_WORDS)} THEN 'receipt' ELSE 'unknown' END AS doc_type
  FROM (SELECT id, full_text AS x FROM {{laid_out}})"""))
def document_type(spark, sf):
    return view(spark, sf, "laid_out").select("id", L.document_type(F.col("full_text")).alias("doc_type"))
