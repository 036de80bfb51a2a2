"""Claim, receipt and feedback views over the star-schema tables.

Every view is one SQL text that both Spark and DuckDB run, so an oracle starts
from the same rows. Money is whole cents until the last step: sums are exact in
either engine, in any order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: "Today" of rules that compare with it: inside the orders' and the events' ranges.
CLAIMS_AS_OF, EVENTS_AS_OF = "2001-01-31", "2024-01-31"


class _Views(dict):
    """Texts by name; a name is given once, so that no module replaces another's view."""

    def __setitem__(self, name: str, text: str) -> None:
        if name in self:
            raise ValueError(f"two views are named {name}")
        super().__setitem__(name, text)


VIEWS: dict[str, str] = _Views()

VIEWS["order_sums"] = """
SELECT l_orderkey AS id, min(l_partkey) AS part_id, min(l_suppkey) AS dealer, count(*) AS n_items,
  CAST(floor(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 300.0) AS BIGINT) AS parts_c,
  CAST(floor(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT)) / 10000.0) AS BIGINT) AS labor_c,
  CAST(floor(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_tax * 100) AS BIGINT)) / 30000.0) AS BIGINT) AS tax_c
FROM {lineitem} GROUP BY l_orderkey
"""

VIEWS["claims"] = """
SELECT o.o_orderkey AS id, o.o_custkey AS customer,
  CASE WHEN o.o_custkey % 11 = 0 THEN concat('1F', CAST(o.o_custkey AS STRING))
    ELSE concat(CASE o.o_custkey % 6 WHEN 0 THEN '1G' WHEN 1 THEN '1F' WHEN 2 THEN 'JH' WHEN 3 THEN '4T' WHEN 4 THEN 'XX' ELSE 'JM' END,
      lpad(CAST(o.o_custkey AS STRING), 7, '0'), CASE o.o_custkey % 5 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN 'A' WHEN 3 THEN 'O' ELSE 'U' END,
      lpad(CAST((o.o_custkey * 13) % 10000000 AS STRING), 7, '0')) END AS vin,
  CAST(s.dealer AS STRING) AS dealer_id, sup.s_name AS dealer_name,
  CASE o.o_custkey % 7 WHEN 0 THEN 'Honda' WHEN 1 THEN 'Toyota' WHEN 2 THEN 'Chevrolet' WHEN 3 THEN 'Ford' WHEN 4 THEN 'Subaru' WHEN 5 THEN 'Mazda' END AS brand,
  concat('M', CAST(p.p_size % 10 AS STRING)) AS model, CAST(1986 + o.o_custkey % 18 AS INT) AS year,
  CAST((o.o_orderkey * 7919) % 150000 AS INT) AS odometer,
  CASE s.part_id % 12 WHEN 0 THEN 'Fuel pump issue' WHEN 1 THEN 'Battery drainage' WHEN 2 THEN 'Transmission fluid leak' WHEN 3 THEN 'Oil leak'
    WHEN 4 THEN 'Power steering failure' WHEN 5 THEN 'Alternator malfunction' WHEN 6 THEN 'Starter motor failure' WHEN 7 THEN 'AC compressor failure'
    WHEN 8 THEN 'Radiator leak' WHEN 9 THEN 'Brake system issue' WHEN 10 THEN 'Engine oil leak' ELSE p.p_name END AS issue,
  CAST(CAST(o.o_orderdate AS DATE) AS STRING) AS claim_date,
  CAST(CAST(o.o_orderdate AS DATE) + CAST(o.o_orderkey % 205 - 4 AS INT) AS STRING) AS decision_date,
  s.parts_c, CASE WHEN o.o_orderkey % 17 = 0 THEN 0 ELSE s.labor_c END AS labor_c, CASE WHEN o.o_orderkey % 101 = 0 THEN -s.tax_c ELSE s.tax_c END AS tax_c,
  s.parts_c + s.labor_c + s.tax_c + CASE WHEN o.o_orderkey % 7 = 0 THEN 2500 ELSE 0 END AS total_c,
  CASE o.o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'P' THEN 'Rejected' ELSE 'Pending' END AS status,
  CASE o.o_orderkey % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'IN' ELSE 'FR' END AS country_code,
  CAST(o.o_orderkey % 50 AS DOUBLE) / 2 AS labor_hours, CAST(o.o_orderkey % 5 AS INT) AS image_count
FROM {orders} o JOIN {order_sums} s ON o.o_orderkey = s.id JOIN {part} p ON s.part_id = p.p_partkey JOIN {supplier} sup ON s.dealer = sup.s_suppkey
"""

#: Pairs of claims found to be duplicates; the first is the later one.
VIEWS["matches"] = """
SELECT a.id AS claim_id_1, b.id AS claim_id_2, 'VIN_ISSUE_DUPLICATE' AS match_type,
  CAST(100 - abs(datediff('day', CAST(a.claim_date AS DATE), CAST(b.claim_date AS DATE))) AS DOUBLE) / 100 AS similarity
FROM {claims} a JOIN {claims} b ON a.vin = b.vin AND a.issue = b.issue AND a.id > b.id
WHERE abs(datediff('day', CAST(a.claim_date AS DATE), CAST(b.claim_date AS DATE))) < 100
UNION ALL
SELECT a.id, b.id, 'IMAGE_EXACT', 1.0 FROM {claims} a JOIN {claims} b ON a.parts_c = b.parts_c AND a.dealer_id = b.dealer_id AND a.id > b.id
UNION ALL
SELECT a.id, b.id, 'IMAGE_SIMILAR', 0.85 FROM {claims} a JOIN {claims} b ON a.id = b.id + 997 AND b.id % 29 = 0
"""

#: A verdict of the system and one of an adjuster for an event.
VIEWS["feedback"] = """
SELECT event_id AS feedback_id, user_id AS receipt_id, ts AS created_at,
  CASE WHEN value < 20 THEN 'real' WHEN value < 60 THEN 'suspicious' ELSE 'fake' END AS system_verdict,
  CASE event_type WHEN 'purchase' THEN 'real' WHEN 'signup' THEN 'real' WHEN 'view' THEN 'suspicious' WHEN 'error' THEN 'fake' ELSE 'fake' END AS correct_verdict,
  event_type, value, props, CASE WHEN event_id % 3 = 0 THEN 'CONFIRMED_FRAUD' ELSE 'FALSE_POSITIVE' END AS verdict
FROM {events}
"""

VIEWS["receipts"] = """
SELECT c.id, c.dealer_name AS merchant, c.claim_date AS receipt_date, c.parts_c AS subtotal_c, c.tax_c, c.total_c - c.labor_c AS total_c,
  concat_ws(chr(10), c.dealer_name, concat('Invoice No: ', CAST(c.id AS STRING)), concat('Date: ', c.claim_date), concat('Phone: 98', lpad(CAST((c.id * 9973) % 100000000 AS STRING), 8, '0')),
    concat('GSTIN: 29ABCDE', lpad(CAST(c.id % 10000 AS STRING), 4, '0'), 'F1Z5'),
    concat(c.issue, ' part  ', CAST(c.parts_c // 200 AS STRING), '.', lpad(CAST(c.parts_c % 100 AS STRING), 2, '0')),
    concat('Workshop service ', CAST(c.image_count + 3 AS STRING), '.50'),
    concat('Subtotal: ', CAST(c.parts_c // 100 AS STRING), '.', lpad(CAST(c.parts_c % 100 AS STRING), 2, '0')),
    concat('CGST @ 9%: ', CAST(abs(c.tax_c) // 200 AS STRING), '.00'), concat('SGST @ 9%: ', CAST(abs(c.tax_c) // 200 + CASE WHEN c.id % 19 = 0 THEN 7 ELSE 0 END AS STRING), '.00'),
    CASE WHEN c.id % 3 = 0 THEN 'Shipping: 12.00' END, CASE WHEN c.id % 5 = 0 THEN 'Discount: 5.25' END,
    concat('Total: ', CASE WHEN c.id % 2 = 0 THEN 'Rs ' ELSE 'USD ' END, CAST((c.total_c - c.labor_c) // 100 AS STRING), '.', lpad(CAST((c.total_c - c.labor_c) % 100 AS STRING), 2, '0'))) AS full_text
FROM {claims} c
"""

#: Views that only oracles use, in DuckDB's SQL; operators compute the same rows.
ORACLE_VIEWS: dict[str, str] = {}

_NAME = re.compile(r"\{([a-z_]\w*)\}")


def view(spark: SparkSession, sf_dir: str, name: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """A table or view as a DataFrame; views of ``given`` stand as they are."""
    if given and name in given:
        return given[name]
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name].replace("datediff('day', ", "date_diff(DAY, ").replace("//", " div ")
    # date_diff counts from the first date to the second in both engines
    return spark.sql(text, **{x: view(spark, sf_dir, x, given) for x in sorted(set(_NAME.findall(VIEWS[name])))})


def _needs(text: str, own: dict[str, str]) -> list[str]:
    found: list[str] = []
    for name in _NAME.findall(text):
        text_of = own.get(name) or VIEWS.get(name) or ORACLE_VIEWS.get(name)
        if text_of and name not in found:
            found += [x for x in _needs(text_of, own) if x not in found]
            found.append(name) if name not in found else None
    return found


def with_views(select: str, recursive: bool = False, own: dict[str, str] | None = None) -> str:
    """``select`` with the views it names in braces put before it, for DuckDB; texts of ``own`` go before views of their names."""
    own = own or {}
    names = _needs(select, own)
    parts = [f"{n} AS ({_NAME.sub(r'\1', own.get(n) or VIEWS.get(n) or ORACLE_VIEWS[n])})" for n in names]
    body = _NAME.sub(r"\1", select).strip()
    if not parts:
        return body
    lead = "WITH RECURSIVE " if recursive else "WITH "
    if body[:5].upper() == "WITH ":
        return lead + ", ".join(parts) + ", " + body[5:]
    return lead + ", ".join(parts) + " " + body
