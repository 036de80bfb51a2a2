"""Queries of names, normal forms and language packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.unicode import strip_accents
from ..operators import merchants as M
from ..sources.views import view
from .registry import query


@query("accent_stripping", "SELECT conv_id, turn, strip_accents(text) AS plain FROM conversations")
def accent_stripping(spark, sf):
    return view(spark, sf, "conversations").select("conv_id", "turn", strip_accents("text").alias("plain"))


_HITS = ", ".join("len(list_filter(w, lambda x: list_contains([" + ", ".join(f"'{x}'" for x in ws) + f"], x))) AS {p}" for p, ws in sorted(M.PACKS.items()))


@query("language_packs", f"""SELECT doc_id, CASE WHEN greatest(de, en, es, fr) = 0 THEN NULL WHEN de = greatest(de, en, es, fr) THEN 'de' WHEN en = greatest(de, en, es, fr) THEN 'en' WHEN es = greatest(de, en, es, fr) THEN 'es' ELSE 'fr' END AS pack, CAST(greatest(de, en, es, fr) AS BIGINT) AS hits,
  round(coalesce(100 * greatest(de, en, es, fr) / nullif(len(w), 0), 0.0), 6) AS per_100 FROM (SELECT doc_id, w, {_HITS} FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda x: x <> '') AS w FROM documents))""")
def language_packs(spark, sf):
    return M.route_packs(view(spark, sf, "documents"))


@query("merchant_fuzzy_match")
def merchant_fuzzy_match(spark, sf):
    """Suppliers' names with a letter changed, against the names themselves."""
    s = view(spark, sf, "supplier")
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, F.col("s_name")).when(k % 3 == 1, F.replace("s_name", F.lit("pp"), F.lit("p"))).otherwise(F.concat(F.lit("zq"), F.substring("s_name", 12, 9)))
    return M.fuzzy_matches(s.select(k.alias("id"), name.alias("name")), s.select(F.col("s_name").alias("known")))
