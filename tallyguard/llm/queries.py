"""The queries of this subpackage, by name, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align
from .chat import digests, format_conversations, streamed
from .common import table
from .jaccard import near_duplicates
from .langid import predict_language
from .mixing import mix
from .packing import pack
from .pii import find_pii
from .quality import BOILERPLATE, judge_quality
from .syncmers import fingerprints
from .toxicity import score_toxicity
from .urls import judge_urls, rule_table
from .vector_codes import encode
from .vector_links import link_vectors


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text."""
    return find_pii(table(spark, sf_dir, "documents"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: five words, similarity 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copy_of")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(concat_ws('|', 'mix-1', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 3 * source_size AS cap FROM s
), r AS (
  SELECT *, (sum(source_size) OVER ()) - coalesce(sum(cap) OVER before, 0) AS rest,
    (sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0) AS open,
    row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place
  FROM w WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT rest, open FROM r WHERE cap * open >= rest * weight ORDER BY place LIMIT 1
), t AS (
  SELECT r.source, r.source_size,
    CASE WHEN level.open IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), CAST(weight * level.rest AS DOUBLE) / CAST(level.open AS DOUBLE)) END AS target
  FROM r LEFT JOIN level ON true
), p AS (
  SELECT d.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
    CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - start)) AS BIGINT) AS taken
FROM e
"""


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, each row a stream of events, folded and formatted, as read back from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ok = F.lit("</s>[INST] ok [/INST]").alias("text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), ok)
    return digests(format_conversations(streamed(rows.unionByName(own))))


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), m AS (
  SELECT *, coalesce(len(regexp_extract_all(role || ' ' || text, '\\')), 0)
    + coalesce(len(regexp_extract_all(role || ' ' || text, '<\||</?s>|\[/?INST\]')), 0)
    + len(role) - len(replace(role, chr(10), '')) AS extra FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(len(role) + len(text) + extra + 17) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(table(spark, sf_dir, "documents"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text."""
    return predict_language(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole text."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict of every whole text."""
    return judge_quality(table(spark, sf_dir, "documents")).drop("cleaned")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules."""
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts' tokens by two vocabularies, aligned, with the corpus-wide counts of their links."""
    return align(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors by integer codebooks."""
    return encode(table(spark, sf_dir, "embeddings"))


def _op12_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds written out, one after another, on plain squared distances."""
    nearest = """(SELECT p, i, e, d FROM (SELECT v.p, v.i, c.e, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN {c} c ON v.p = c.p AND v.pos = c.pos GROUP BY v.p, v.i, c.e)
  QUALIFY row_number() OVER (PARTITION BY p, i ORDER BY d, e) = 1)"""
    out = f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS i, vec_id, label, embedding AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: isfinite(x)))
), flat AS (SELECT i, unnest(q) AS x, unnest(range(len(q))) AS k_at, len(q) // {parts} AS wide FROM k
), v AS (SELECT i, k_at // wide AS p, k_at % wide AS pos, CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM flat
), c0 AS (SELECT p, i - 1 AS e, pos, x FROM v WHERE i <= {entries}
)"""
    for r in range(1, rounds + 1):
        out += f""", n{r} AS {nearest.format(c=f"c{r - 1}")}, m{r} AS (
  SELECT v.p, n.e, v.pos, CAST(floor(CAST(sum(v.x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM v JOIN n{r} n ON v.p = n.p AND v.i = n.i GROUP BY v.p, n.e, v.pos
), c{r} AS (SELECT c.p, c.e, c.pos, coalesce(m.x, c.x) AS x FROM c{r - 1} c LEFT JOIN m{r} m ON c.p = m.p AND c.e = m.e AND c.pos = m.pos)"""
    return (
        out
        + f""", last AS {nearest.format(c=f"c{rounds}")}, coded AS (
  SELECT i, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY i
), labelled AS (SELECT k.vec_id, k.label, coded.code, coded.error FROM k JOIN coded ON k.i = coded.i
), digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, pos)) AS s FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest.s AS codebooks_sha256 FROM labelled, digest
"""
    )


def op13_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all vectors with a label: cosine 0.93."""
    return link_vectors(table(spark, sf_dir, "embeddings"))


OP13_SQL = r"""
WITH RECURSIVE e AS (
  SELECT row_number() OVER () AS i, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), good AS (
  SELECT i, vec_id, label, v FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) = len(list_filter(v, lambda x: isfinite(x))) AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.i AS a, b.i AS b FROM good a JOIN good b ON a.label = b.label AND a.i <> b.i AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach(a, b) AS (SELECT i, i FROM e UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), class AS (SELECT r.a, min(e.vec_id) AS component_id FROM reach r JOIN e ON r.b = e.i GROUP BY r.a
), degree AS (SELECT a, count(*) AS k FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(degree.k, 0) AS BIGINT) AS n_links, class.component_id, e.vec_id = class.component_id AS kept
FROM e JOIN class ON e.i = class.a LEFT JOIN degree ON e.i = degree.a
"""


_WS = "[\\x20\\x09-\\x0D]"
_PIECE = r"[^\x00-\x20|•·»›>/.!?。।]+( [^\x00-\x20|•·»›>/.!?。।]+){0,2}"
_NAV = rf"^\s*{_PIECE}( *[|•·»›>] *{_PIECE}){{2,}}\s*$"
_BOILER = " OR ".join(f"contains(lower(l), '{x}')" for x in BOILERPLATE)
OP9_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), again AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1)) GROUP BY r
), lines AS (
  SELECT r, l, length(regexp_replace(l, '{_WS}+', '', 'g')) AS chars, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS words,
    len(regexp_extract_all(l, '[#*$%&|<>][^\x20\x09-\x0D]*')) AS symbols, len(regexp_extract_all(l || ' ', '!!{_WS}')) AS shouts
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
), kept AS (
  SELECT r, count(*) FILTER (words > 0) - count(DISTINCT CASE WHEN words > 0 THEN l END) AS n_dup_lines, sum(chars) FILTER (NOT (words > 0 AND (10 * symbols >= 3 * words OR 10 * shouts >= 3 * words
    OR (words >= 25 AND NOT regexp_matches(l, '\p{{P}}')) OR regexp_matches(l, '{_NAV}') OR (words <= 25 AND ({_BOILER}))))) AS chars FROM lines GROUP BY r
), base AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_WS}+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, coalesce(kept.chars, 0) AS chars FROM d JOIN kept ON d.r = kept.r LEFT JOIN again ON d.r = again.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * chars >= word_chars AS kept FROM base
"""
OP10_SQL = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), r(action, r_host, r_path) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), keys AS (SELECT DISTINCT host, path FROM u
), best AS (
  SELECT host, path, arg_max({'rule': r_host || r_path, 'action': action}, len(r_host || r_path) * 10000 + len(r_host)) AS b
  FROM keys JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY host, path
)
SELECT page_id, u.host, u.path, b.rule AS rule, coalesce(b.action, 'allow') AS verdict
FROM u LEFT JOIN best ON u.host = best.host AND u.path = best.path
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_packing": op1_packing, "op2_pii": op2_pii, "op3_jaccard": op3_jaccard, "op4_mixing": op4_mixing, "op5_chat": op5_chat, "op6_fingerprints": op6_fingerprints, "op7_langid": op7_langid, "op8_toxicity": op8_toxicity, "op9_quality": op9_quality, "op10_urls": op10_urls, "op11_alignment": op11_alignment, "op12_vector_codes": op12_vector_codes, "op13_vector_links": op13_vector_links}


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w
), copies AS (
  SELECT g, min(doc_id) AS rep, count(*) AS cnt FROM g WHERE len(g) > 0 GROUP BY g
), s AS (SELECT rep, cnt, len(g) AS n, unnest(g) AS x FROM copies
), common AS (
  SELECT a.rep AS a, b.rep AS b, any_value(b.cnt) AS cnt, count(*) AS c, any_value(a.n) + any_value(b.n) AS n
  FROM s a JOIN s b ON a.x = b.x AND a.rep <> b.rep GROUP BY a.rep, b.rep
), links AS (SELECT a, b, cnt FROM common WHERE c >= 0.8 * (n - c)
), reach(a, b) AS (
  SELECT rep, rep FROM copies UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), class AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a
), degree AS (SELECT a AS rep, sum(cnt) AS k FROM links GROUP BY a)
SELECT g.doc_id, coalesce(class.class_id, g.doc_id) AS class_id,
  CAST(coalesce(degree.k, 0) + coalesce(copies.cnt - 1, 0) AS BIGINT) AS n_links, coalesce(copies.rep, g.doc_id) AS copy_of
FROM g LEFT JOIN copies ON g.g = copies.g LEFT JOIN class ON copies.rep = class.rep LEFT JOIN degree ON copies.rep = degree.rep
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard": OP3_SQL, "op4_mixing": OP4_SQL, "op5_chat": OP5_SQL, "op9_quality": OP9_SQL, "op10_urls": OP10_SQL, "op12_vector_codes": _op12_sql(), "op13_vector_links": OP13_SQL}
