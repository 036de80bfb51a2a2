"""Queries over duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import SUFFIXES
from ..operators import duplicates as P
from ..sources.views import ORACLE_VIEWS, view, with_views
from .registry import query

#: Names that differ in suffix and case for one merchant, so that keys have something to fold.
_MERCHANT = "CASE WHEN id % 3 = 0 THEN concat(upper(merchant), ' PVT LTD') WHEN id % 3 = 1 THEN concat(merchant, '  Inc') ELSE merchant END"
#: Few merchants, months and totals, so that receipts collide.
_RECEIPTS = f"""SELECT id, {_MERCHANT} AS merchant, concat(receipt_date[1:7], '-01') AS receipt_date, CAST(total_c % 4000 AS DOUBLE) / 100 AS total FROM {{receipts}}"""


def _key() -> str:
    name = "lower(trim(merchant))"
    for suffix in SUFFIXES:
        escaped = suffix.replace(".", "\\.")
        name = f"regexp_replace({name}, '\\b{escaped}\\b', '', 'g')"
    return f"trim(regexp_replace({name}, '\\s+', ' ', 'g'))"


ORACLE_VIEWS["printed"] = f"""SELECT id, substr(sha256(concat_ws('|', {_key()}, receipt_date, format('{{:.2f}}', total))), 1, 32) AS exact_fp,
  substr(sha256(concat_ws('|', {_key()}, receipt_date, CASE WHEN total <= 0 THEN 'zero' ELSE concat('bucket_', CAST(floor(total / 10) * 10 AS BIGINT), '_', CAST(floor(total / 10) * 10 + 10 AS BIGINT)) END)), 1, 32) AS fuzzy_fp
FROM ({_RECEIPTS})"""


def _receipts(spark, sf):
    r = view(spark, sf, "receipts")
    merchant = F.when(F.col("id") % 3 == 0, F.concat(F.upper("merchant"), F.lit(" PVT LTD"))).when(F.col("id") % 3 == 1, F.concat("merchant", F.lit("  Inc"))).otherwise(F.col("merchant"))
    return r.select("id", merchant.alias("merchant"), F.concat(F.substring("receipt_date", 1, 7), F.lit("-01")).alias("receipt_date"), (F.col("total_c") % 4000 / 100.0).alias("total"))


#: Hashes as images have them: the file's of the text, the perceptual one of its first words.
ORACLE_VIEWS["images"] = """SELECT doc_id AS image_id, sha256(text) AS file_hash, substr(sha256(text[1:24]), 1, 11) || substr(sha256(text), 1, 1) || substr(sha256(text[1:24]), 13, 4) AS phash,
  doc_id // 3 AS claim_id, n_chars * 3 AS size, CAST(n_chars % 1500 AS INT) AS width, CAST((n_chars * 7) % 900 AS INT) AS height FROM {documents}"""


def _images(spark, sf):
    lead = F.sha2(F.substring("text", 1, 24), 256)
    phash = F.concat(F.substring(lead, 1, 11), F.substring(F.sha2("text", 256), 1, 1), F.substring(lead, 13, 4))
    return view(spark, sf, "documents").select(
        F.col("doc_id").alias("image_id"), F.expr("doc_id div 3").alias("claim_id"), F.sha2("text", 256).alias("file_hash"), phash.alias("phash"), (F.col("n_chars") * 3).alias("size"),
        (F.col("n_chars") % 1500).cast("int").alias("width"), (F.col("n_chars") * 7 % 900).cast("int").alias("height"),
    )


@query("receipt_fingerprint", with_views("SELECT * FROM {printed}"))
def receipt_fingerprint(spark, sf):
    return P.fingerprinted(_receipts(spark, sf)).select("id", "exact_fp", "fuzzy_fp")


@query("duplicate_registry", with_views("""SELECT id, CASE WHEN id = of THEN 'new' WHEN exact_fp = of_exact THEN 'exact' ELSE 'fuzzy' END AS status, CASE WHEN id <> of THEN of END AS duplicate_of
  FROM (SELECT *, first_value(id) OVER w AS of, first_value(exact_fp) OVER w AS of_exact FROM {printed} WINDOW w AS (PARTITION BY fuzzy_fp ORDER BY id))"""))
def duplicate_registry(spark, sf):
    return P.duplicate_registry(_receipts(spark, sf))


_ELIGIBLE = "(width > 0 AND height > 0 AND CAST(width AS DOUBLE) / height <= 5.0 AND CAST(height AS DOUBLE) / width <= 5.0)"


@query("image_exact_duplicates", with_views(f"""SELECT a.image_id, min(b.image_id) AS matched_id, any_value(c.n) AS n_claims FROM {{images}} a JOIN (SELECT * FROM {{images}} WHERE {_ELIGIBLE}) b ON a.file_hash = b.file_hash AND a.claim_id <> b.claim_id
  JOIN (SELECT file_hash, count(DISTINCT claim_id) AS n FROM {{images}} GROUP BY file_hash) c ON a.file_hash = c.file_hash GROUP BY a.image_id"""))
def image_exact_duplicates(spark, sf):
    return P.exact_images(_images(spark, sf))


_HAMMING = "bit_count(xor(CAST('0x' || a.phash[1:8] AS BIGINT), CAST('0x' || b.phash[1:8] AS BIGINT))) + bit_count(xor(CAST('0x' || a.phash[9:16] AS BIGINT), CAST('0x' || b.phash[9:16] AS BIGINT)))"


ORACLE_VIEWS["seen_images"] = f"SELECT *, min(image_id) OVER (PARTITION BY phash) AS rep, {_ELIGIBLE} AS eligible FROM {{images}}"


@query("image_members", with_views("SELECT image_id, claim_id, phash, rep, eligible FROM {seen_images}"))
def image_members(spark, sf):
    return P.image_members(_images(spark, sf))


@query("image_near_duplicates", with_views(f"""SELECT *, CASE WHEN distance <= 5 THEN 'IMAGE_LIKELY_SAME' ELSE 'IMAGE_SIMILAR' END AS match_type FROM (
  SELECT DISTINCT least(a.rep, b.rep) AS image_1, greatest(a.rep, b.rep) AS image_2, CAST({_HAMMING} AS INT) AS distance
  FROM {{seen_images}} a JOIN {{seen_images}} b ON a.claim_id <> b.claim_id AND b.eligible) WHERE distance <= 10"""))
def image_near_duplicates(spark, sf):
    """Links between images of different claims, every pair of images held against the limit in the SQL."""
    return P.near_images(P.image_members(_images(spark, sf)))


@query("near_hash_claims", with_views(f"""SELECT a.phash, count(DISTINCT b.claim_id) FILTER (a.phash = b.phash) AS n_claims, count(DISTINCT b.claim_id) AS n_near_claims
  FROM (SELECT DISTINCT phash FROM {{seen_images}}) a JOIN (SELECT DISTINCT phash, claim_id FROM {{seen_images}}) b ON {_HAMMING} <= 5 GROUP BY a.phash"""))
def near_hash_claims(spark, sf):
    """Distinct claims within five bits of every hash; the SQL holds every pair of hashes against the limit."""
    return P.near_hash_claims(P.image_members(_images(spark, sf)))


@query("template_image_filter", with_views("""SELECT *, reason IS NOT NULL AS is_template FROM (SELECT image_id, n AS n_claims, CASE WHEN size > 0 AND size < 5000 THEN 'small file' WHEN width > 0 AND height > 0 AND width > 5.0 * height THEN 'banner'
  WHEN width > 0 AND height > 0 AND width < 0.2 * height THEN 'vertical banner' WHEN height > 0 AND height < 200 AND width > height * 3 THEN 'header' WHEN width > 0 AND width < 200 AND height > width * 3 THEN 'sidebar' WHEN n >= 3 THEN 'common template' END AS reason
  FROM {images} JOIN (SELECT file_hash, count(DISTINCT claim_id) AS n FROM {images} GROUP BY file_hash) USING (file_hash))"""))
def template_image_filter(spark, sf):
    return P.template_images(_images(spark, sf))


_STOP = "[" + ", ".join(f"'{w}'" for w in P.STOP_WORDS) + "]"


@query("claim_duplicates", with_views(f"""SELECT *, (issue_similarity + date_proximity) / 2 AS similarity FROM (
  SELECT a.id AS claim_id_1, b.id AS claim_id_2, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS issue_similarity,
    CASE WHEN abs(a.d - b.d) >= 90 THEN 0.0 ELSE 1.0 - abs(a.d - b.d) / 90 END AS date_proximity
  FROM (SELECT id, vin, CAST(claim_date AS DATE) AS d, list_filter(list_distinct(string_split(lower(issue), ' ')), lambda x: NOT list_contains({_STOP}, x)) AS w FROM {{claims}}) a
  JOIN (SELECT id, vin, CAST(claim_date AS DATE) AS d, list_filter(list_distinct(string_split(lower(issue), ' ')), lambda x: NOT list_contains({_STOP}, x)) AS w FROM {{claims}}) b ON a.vin = b.vin AND a.id > b.id)
  WHERE issue_similarity > 0.7 AND date_proximity > 0.5"""))
def claim_duplicates(spark, sf):
    return P.claim_duplicates(view(spark, sf, "claims"))
