"""Queries of dates and times in whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dates as DT
from ..sources.views import ORACLE_VIEWS, VIEWS, view, with_views
from .registry import query

_D = "CAST(CAST(r.receipt_date AS DATE) + CAST(r.id % 205 - 4 AS INT) AS STRING)"
_MONTH = "CASE substr(d, 6, 2) " + " ".join(f"WHEN '{i:02d}' THEN '{m}'" for i, m in enumerate(("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"), 1)) + " END"
_DMY, _MDY = "substr(d, 9, 2), {0}, substr(d, 6, 2), {0}", "substr(d, 6, 2), {0}, substr(d, 9, 2), {0}"
#: Receipts with a second date in one of many forms, some of them in addresses, and times.
VIEWS["dated"] = f"""SELECT id, receipt_date, concat_ws(chr(10), full_text, CASE id % 17
  WHEN 0 THEN concat('Due ', {_DMY.format("'/'")}, substr(d, 1, 4)) WHEN 1 THEN concat('Paid ', {_MDY.format("'/'")}, substr(d, 1, 4), ' 4:', substr(d, 9, 2), ' PM') WHEN 2 THEN concat('due ', {_DMY.format("'-'")}, substr(d, 1, 4))
  WHEN 3 THEN concat('Sent ', substr(d, 9, 2), ' ', substr({_MONTH}, 1, 3), ' ', substr(d, 1, 4)) WHEN 4 THEN concat('Sent ', substr({_MONTH}, 1, 3), ' ', substr(d, 9, 2), ', ', substr(d, 1, 4)) WHEN 5 THEN concat('Sent ', {_MONTH}, ' ', substr(d, 9, 2), ' ', substr(d, 1, 4))
  WHEN 6 THEN concat('Paid ', {_MDY.format("'/'")}, substr(d, 3, 2), ' 14:', substr(d, 9, 2)) WHEN 7 THEN concat('#9-4-', substr(d, 3, 2), ' Lake View') WHEN 8 THEN concat('No.', {_DMY.format("'-'")}, substr(d, 1, 4)) WHEN 9 THEN concat({_DMY.format("'/'")}, '2024, Main Road')
  WHEN 10 THEN concat('Due ', substr(d, 1, 4), '/', substr(d, 6, 2), '/', substr(d, 9, 2)) WHEN 11 THEN concat('Due 30/02/', substr(d, 1, 4)) WHEN 12 THEN concat({_DMY.format("' / '")}, '2024 and 05-06-2024 at 11:59am, 10:00') WHEN 13 THEN concat('Sent ', {_MONTH}, chr(10), substr(d, 9, 2), chr(10), '2024')
  WHEN 14 THEN concat('x', {_DMY.format("'/'")}, '2024 ', substr(d, 9, 2), ' sept. 2024') WHEN 15 THEN 'Open 24/7, 9:00 to 12:15 am' END) AS full_text FROM (SELECT r.id, r.receipt_date, r.full_text, {_D} AS d FROM {{receipts}} r)"""
VIEWS["dated_types"] = "SELECT d.*, CASE d.id % 6 WHEN 0 THEN 'POS_RETAIL' WHEN 1 THEN 'pos_fuel' WHEN 2 THEN 'MISC' WHEN 3 THEN 'TAX_INVOICE' END AS doc_subtype FROM {dated} d"

_S = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
_L = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
_DATE_SQL = (
    r"\b[0-3]?\d[/-][0-1]?\d[/-](?:20)?\d{2}\b", r"\b20\d{2}[-/][0-1]?\d[-/][0-3]?\d\b", r"\b\d{1,2}\s*/\s*\d{1,2}\s*/\s*\d{2,4}\s+\d{1,2}:\d{2}\s*(?:AM|PM|am|pm)\b",
    r"\b\d{1,2}\s*/\s*\d{1,2}\s*/\s*\d{2,4}\s+\d{1,2}:\d{2}\b", r"\b\d{1,2}\s*[/-]\s*\d{1,2}\s*[/-]\s*\d{2,4}\b", r"\b\d{4}\s*[/-]\s*\d{1,2}\s*[/-]\s*\d{1,2}\b",
    rf"(?i)\b\d{{1,2}}\s+{_S}\s+\d{{2,4}}\b", rf"(?i)\b{_S}\s+\d{{1,2}},?\s+\d{{2,4}}\b", rf"(?i)\b{_S}\.?\s+[0-3]?\d,?\s+20\d{{2}}\b", rf"(?i)\b[0-3]?\d\s+{_S}\.?\s+20\d{{2}}\b", rf"(?i)\b{_L}\s+[0-3]?\d,?\s+20\d{{2}}\b",
)
_ADDRESS = "(?i)^(, )?(nagar|road|rd|street|st,|lane|marg|avenue|ave|colony|sector|block|plot|house|floor|building|bldg|cross|main)"


def _tried(s: str, forms: tuple[str, ...]) -> str:
    """The first of DuckDB's forms that reads ``s`` whole, where its shape is the form's."""
    shape = {"%d": r"\d{1,2}", "%m": r"\d{1,2}", "%Y": r"\d{4}", "%y": r"\d{2}", "%b": "[A-Za-z]{3}", "%B": "[A-Za-z]{3,9}", " ": r"\s+"}
    out = []
    for form in forms:
        pattern = form
        for k, v in shape.items():
            pattern = pattern.replace(k, v) if k != " " else pattern
        pattern = pattern.replace(" ", r"\s+")
        out.append(f"CASE WHEN regexp_full_match({s}, '{pattern}') THEN try_strptime(regexp_replace({s}, '\\s+', ' ', 'g'), '{form}') END")
    return "CAST(CAST(coalesce(" + ", ".join(out) + ") AS DATE) AS VARCHAR)"


_NAMED = ("%d %b %Y", "%d %B %Y", "%b %d, %Y", "%b %d %Y", "%B %d, %Y", "%B %d %Y")
#: Each match between two marks; its neighbours tell whether it stands in an address.
ORACLE_VIEWS["date_marks"] = "SELECT id, k, i, m FROM (" + " UNION ALL ".join(f"""SELECT id, {k} AS k, i, string_split(p[i], chr(2))[1] AS m, right(replace(p[i - 1], chr(2), ''), 3) AS a, left(replace(string_split(p[i], chr(2))[2] || array_to_string(p[i + 1:i + 7], ''), chr(2), ''), 30) AS b
  FROM (SELECT id, p, unnest(range(2, len(p) + 1)) AS i FROM (SELECT id, string_split(regexp_replace(full_text, '{p}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS p FROM {{dated}}))""" for k, p in enumerate(_DATE_SQL)) + f") WHERE NOT regexp_matches(a, '(#\\s*|[Nn]o\\.)$') AND NOT regexp_matches(ltrim(b, ' ' || chr(10)), '{_ADDRESS}')"
ORACLE_VIEWS["date_first"] = "SELECT id, coalesce(" + _tried("m", ("%d/%m/%Y", "%d-%m-%Y", "%Y-%m-%d", "%m/%d/%Y", "%d.%m.%Y", *_NAMED)) + ", m) AS first_date FROM (SELECT id, m, row_number() OVER (PARTITION BY id ORDER BY k, i) AS n FROM {date_marks}) WHERE n = 1"
ORACLE_VIEWS["date_lists"] = "SELECT id, list(v ORDER BY k, i) AS ds FROM (SELECT id, v, min_by(k, (k, i)) AS k, min_by(i, (k, i)) AS i FROM (SELECT id, k, i, " + _tried("w", ("%m/%d/%Y", "%m/%d/%y", "%d/%m/%Y", "%d/%m/%y", "%Y-%m-%d", "%d-%m-%Y", *_NAMED)) + " AS v FROM (SELECT *, CASE WHEN contains(m, ' ') THEN regexp_extract(m, '^\\S+') ELSE m END AS w FROM {date_marks})) WHERE v IS NOT NULL GROUP BY id, v) GROUP BY id"
ORACLE_VIEWS["date_times"] = "SELECT id, CASE WHEN x <> '' THEN lpad(CAST(CASE WHEN x ILIKE '%pm' AND h <> 12 THEN h + 12 WHEN x ILIKE '%am' AND h = 12 THEN 0 ELSE h END AS VARCHAR), 2, '0') || regexp_extract(x, ':\\d{2}') WHEN y <> '' THEN lpad(y, 5, '0') END AS first_time FROM (SELECT *, TRY_CAST(regexp_extract(x, '^\\d+') AS INT) AS h FROM (SELECT id, regexp_extract(full_text, '\\b\\d{1,2}:\\d{2}\\s*(AM|PM|am|pm)\\b') AS x, regexp_extract(full_text, '\\b\\d{1,2}:\\d{2}\\b') AS y FROM {dated}))"


@query("document_dates", with_views("SELECT d.id, f.first_date, coalesce(array_to_string(l.ds, ','), '') AS all_dates, CASE WHEN len(l.ds) > 1 THEN CAST(date_diff('day', CAST(list_min(l.ds) AS DATE), CAST(list_max(l.ds) AS DATE)) AS INT) END AS date_span, t.first_time FROM {dated} d LEFT JOIN {date_first} f USING (id) LEFT JOIN {date_lists} l USING (id) LEFT JOIN {date_times} t USING (id)"))
def document_dates(spark, sf):
    """First date, all dates, their span and the first time, of whole texts."""
    rows = DT.scanned(view(spark, sf, "dated"))
    return rows.select("id", "first_date", F.array_join("all_dates", ",").alias("all_dates"), "date_span", "first_time")


@query("date_conflicts", with_views("SELECT id, 'R_DATE_CONFLICT' AS rule_id, len(ds) AS n_dates, CAST(date_diff('day', CAST(list_min(ds) AS DATE), CAST(list_max(ds) AS DATE)) AS INT) AS date_span, 'CRITICAL' AS severity, CASE WHEN lower(doc_subtype) LIKE 'pos\\_%' ESCAPE '\\' THEN 35 ELSE 25 END AS hundredths FROM {date_lists} JOIN {dated_types} USING (id) WHERE date_diff('day', CAST(list_min(ds) AS DATE), CAST(list_max(ds) AS DATE)) > 30"))
def date_conflicts(spark, sf):
    """Receipts whose own dates lie over 30 days apart, in place of a given span."""
    return DT.conflicts(DT.scanned(view(spark, sf, "dated_types")))
