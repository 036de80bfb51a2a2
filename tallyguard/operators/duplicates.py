"""Duplicate receipts, claims and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fingerprints
from .warranty import parse_date, words

# Words that carry no meaning in an issue, and thresholds.
STOP_WORDS = ("the", "a", "an", "is", "was", "be", "to", "of", "and", "or", "for", "in", "on")
SIMILAR_BITS, SAME_BITS, WINDOW_DAYS = 10, 5, 90
MIN_BYTES, MAX_ASPECT, MIN_ASPECT, MIN_SIDE, TEMPLATE_CLAIMS = 5000, 5.0, 0.2, 200, 3


def fingerprinted(receipts: DataFrame) -> DataFrame:
    """Receipts with ``exact_fp`` and ``fuzzy_fp``."""
    exact, fuzzy = fingerprints(F.col("merchant"), F.col("receipt_date"), F.col("total"))
    return receipts.withColumns({"exact_fp": exact, "fuzzy_fp": fuzzy})


def duplicate_registry(receipts: DataFrame, arrival: str = "id") -> DataFrame:
    """What the registry says of every receipt on arrival: new, exact or fuzzy, and of which one.

    A receipt is registered only if it is new, so a fuzzy key has one
    representative: its first arrival. That is an aggregate with partial sums,
    joined back, so a key that many receipts share is never one task's work.
    """
    known = fingerprinted(receipts)
    rep = known.where("fuzzy_fp IS NOT NULL").groupBy(F.col("fuzzy_fp").alias("key")).agg(F.min(F.struct(F.col(arrival).alias("of"), "exact_fp")).alias("rep"))
    known = known.join(rep, known["fuzzy_fp"] == rep["key"], "left")
    same = F.col("rep.of") == F.col(arrival)
    status = F.when(F.col("rep").isNull() | same, "new").when(F.col("rep.exact_fp") == F.col("exact_fp"), "exact").otherwise("fuzzy")
    return known.select(F.col(arrival).alias("id"), status.alias("status"), F.when(status != "new", F.col("rep.of")).alias("duplicate_of"))


def not_banner() -> Column:
    """Sides are known and neither is over ``MAX_ASPECT`` times the other."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    return F.coalesce((w > 0) & (h > 0) & (F.try_divide(w, h) <= MAX_ASPECT) & (F.try_divide(h, w) <= MAX_ASPECT), F.lit(False))


def hash_claims(images: DataFrame) -> DataFrame:
    """For each file hash, ``n_claims``, the distinct claims that have it: an aggregate of an aggregate, no window, no set of a hot hash."""
    once = images.where("claim_id IS NOT NULL").groupBy("file_hash", "claim_id").agg(F.count("*").alias("n"))
    return once.groupBy("file_hash").agg(F.count("*").alias("n_claims"))


def exact_images(images: DataFrame) -> DataFrame:
    """For each image the lowest image of the same file hash in another claim that is no banner; images without one are left out.

    Each claim's lowest such image stands for the claim. Of these the lowest and
    the lowest of any other claim answer for all images of the hash, so no pair
    of a hot hash is made. ``n_claims``: the distinct claims with the hash.
    """
    of_claim = images.where(not_banner() & F.col("claim_id").isNotNull()).groupBy("file_hash", "claim_id").agg(F.min("image_id").alias("image_id"))
    first = of_claim.groupBy(F.col("file_hash").alias("h")).agg(F.min(F.struct("image_id", "claim_id")).alias("first"))
    others = of_claim.join(first, of_claim["file_hash"] == first["h"]).where("claim_id <> first.claim_id")
    second = others.groupBy("h").agg(F.min("image_id").alias("second")).withColumnRenamed("h", "h2")
    answers = first.join(second, first["h"] == second["h2"], "left").join(hash_claims(images), first["h"] == F.col("file_hash")).select("h", "first", "second", "n_claims")
    matched = F.when(F.col("claim_id") == F.col("first.claim_id"), F.col("second")).otherwise(F.col("first.image_id"))
    found = images.where("claim_id IS NOT NULL").join(answers, images["file_hash"] == answers["h"])
    return found.select("image_id", matched.alias("matched_id"), "n_claims").where("matched_id IS NOT NULL")


def image_members(images: DataFrame) -> DataFrame:
    """Each image with a hash and a claim: ``rep``, the lowest image of its hash, and whether it may be found (``eligible``).

    Banners aren't found: sides are known and neither is over ``MAX_ASPECT`` times the other.
    """
    known = images.where(F.col("phash").rlike("^[0-9a-fA-F]{16}$") & F.col("claim_id").isNotNull()).withColumns({"phash": F.lower("phash"), "eligible": not_banner()})
    reps = known.groupBy("phash").agg(F.min("image_id").alias("rep"))
    return known.join(reps, "phash").select("image_id", "claim_id", "phash", "rep", "eligible")


def near_images(members: DataFrame, bits: int = SIMILAR_BITS) -> DataFrame:
    """Pairs of perceptual hashes at most ``bits`` apart, by the hashes' lowest images; ``members`` tells their other images.

    A pair stands for a link between images of different claims of which one
    may be found, whichever of a hash's images that is; a hash is paired with
    itself where its own images are so linked. Equal hashes fold into one row
    first.
    """
    found = F.when(F.col("eligible"), F.col("claim_id"))
    claims = [f(c).alias(n) for n, f, c in (("c_lo", F.min, F.col("claim_id")), ("c_hi", F.max, F.col("claim_id")), ("e_lo", F.min, found), ("e_hi", F.max, found))]
    hashes = members.groupBy("phash", F.col("rep").alias("image_id")).agg(*claims)
    rows = hashes.select("image_id", "phash", F.struct("c_lo", "c_hi", "e_lo", "e_hi").alias("c"))
    near = near_hashes(rows, bits)

    def links(any_of: str, found_of: str):
        """Whether an image of one hash finds one of the other, of another claim."""
        one, two = F.col(f"c_{any_of}"), F.col(f"c_{found_of}")
        alone = (one["c_lo"] == one["c_hi"]) & (two["e_lo"] == two["e_hi"]) & (one["c_lo"] == two["e_lo"])
        return F.coalesce(two["e_lo"].isNotNull() & ~alone, F.lit(False))

    pairs = near.where(links("a", "b") | links("b", "a")).select("image_1", "image_2", "distance").distinct()
    same = hashes.where("e_lo IS NOT NULL AND c_lo <> c_hi").select(F.col("image_id").alias("image_1"), F.col("image_id").alias("image_2"), F.lit(0).alias("distance"))
    return pairs.union(same).withColumn("match_type", F.when(F.col("distance") <= SAME_BITS, "IMAGE_LIKELY_SAME").otherwise("IMAGE_SIMILAR"))


def near_hashes(hashes: DataFrame, bits: int) -> DataFrame:
    """Pairs of different hashes at most ``bits`` apart: image_1 < image_2, their ``c`` as c_a and c_b, distance; a pair can come more than once.

    ``hashes`` has one row for each: image_id, phash, c. Cut into ``bits // 2 +
    1`` bands, two hashes differ by one bit at most in some band, or they would
    differ by more than ``bits`` in all. So one side is keyed by its bands and
    the other by its bands and all their one-bit changes; the distance is
    verified on the pairs that meet, on integers made once for each hash.
    """
    n = bits // 2 + 1
    cut = [64 * k // n for k in range(n + 1)]
    halves = [F.conv(F.substring("phash", k, 8), 16, 10).cast("long") for k in (1, 9)]
    binary = F.concat(*(F.lpad(F.conv(F.substring("phash", 1 + 4 * k, 4), 16, 2), 16, "0") for k in range(4)))
    rows = hashes.select("image_id", halves[0].alias("hi"), halves[1].alias("lo"), binary.alias("binary"), "c")

    def band(k: int, flip: int = -1):
        """Band ``k`` with its number; the bit at ``flip`` changed."""
        start, size = cut[k] + 1, cut[k + 1] - cut[k]
        if flip < 0:
            return F.concat(F.lit(f"{k}:"), F.substring("binary", start, size))
        changed = F.translate(F.substring("binary", start + flip, 1), "01", "10")
        return F.concat(F.lit(f"{k}:"), F.substring("binary", start, flip), changed, F.substring("binary", start + flip + 1, size - flip - 1))

    plain = [band(k) for k in range(n)]
    changed = [band(k, i) for k in range(n) for i in range(cut[k + 1] - cut[k])]
    a = rows.select("image_id", "hi", "lo", "c", F.explode(F.array(*plain, *changed)).alias("band")).alias("a")
    b = rows.select("image_id", "hi", "lo", "c", F.explode(F.array(*plain)).alias("band")).alias("b")
    met = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.image_id") < F.col("b.image_id")))
    apart = F.bit_count(F.col("a.hi").bitwiseXOR(F.col("b.hi"))) + F.bit_count(F.col("a.lo").bitwiseXOR(F.col("b.lo")))
    near = met.withColumn("distance", apart).where(F.col("distance") <= bits)
    return near.select(F.col("a.image_id").alias("image_1"), F.col("b.image_id").alias("image_2"), F.col("a.c").alias("c_a"), F.col("b.c").alias("c_b"), "distance")


def near_hash_claims(members: DataFrame, bits: int = SAME_BITS) -> DataFrame:
    """For each perceptual hash ``n_claims``, the distinct claims with it, and ``n_near_claims``, those with it or one at most ``bits`` apart.

    Neighbours are found once for each hash; each hash's claims, once each, go
    to its neighbours, and (hash, claim) is reduced before it is counted.
    """
    claims = members.groupBy("phash", "claim_id").agg(F.min("rep").alias("rep"))
    hashes = claims.groupBy("phash").agg(F.min("rep").alias("image_id"), F.count("*").alias("n_claims"))
    pairs = near_hashes(hashes.select("image_id", "phash", F.col("phash").alias("c")), bits).select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct()
    both = pairs.union(pairs.select("b", "a"))
    reached = both.join(claims.select(F.col("phash").alias("b"), "claim_id"), "b").select(F.col("a").alias("phash"), "claim_id")
    counts = reached.union(claims.select("phash", "claim_id")).groupBy("phash", "claim_id").agg(F.count("*").alias("n")).groupBy("phash").agg(F.count("*").alias("n_near_claims"))
    return hashes.select("phash", "n_claims").join(counts, "phash")


def template_images(images: DataFrame) -> DataFrame:
    """Why an image is a template, if it is: size, aspect, sides, or how many distinct claims have its file hash."""
    w, h, size = F.col("width"), F.col("height"), F.col("size")
    by = hash_claims(images).withColumnRenamed("file_hash", "h")
    known = images.join(by, images["file_hash"] == by["h"], "left").withColumn("n_claims", F.coalesce("n_claims", F.lit(0)))
    ratio = F.try_divide(w.cast("double"), h.cast("double"))
    reason = (
        F.when((size > 0) & (size < MIN_BYTES), "small file")
        .when((w > 0) & (h > 0) & (ratio > MAX_ASPECT), "banner")
        .when((w > 0) & (h > 0) & (ratio < MIN_ASPECT), "vertical banner")
        .when((h > 0) & (h < MIN_SIDE) & (w > h * 3), "header")
        .when((w > 0) & (w < MIN_SIDE) & (h > w * 3), "sidebar")
        .when(F.col("n_claims") >= TEMPLATE_CLAIMS, "common template")
    )
    return known.select("image_id", "n_claims", reason.alias("reason"), reason.isNotNull().alias("is_template"))


def claim_duplicates(claims: DataFrame) -> DataFrame:
    """Pairs of claims of one vehicle with similar issues (Jaccard over 0.7) at close dates (proximity over 0.5)."""
    meaning = F.array_except(words(F.col("issue")), F.array(*map(F.lit, STOP_WORDS)))
    rows = claims.select("id", "vin", meaning.alias("w"), parse_date(F.col("claim_date")).alias("d"))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.vin") == F.col("b.vin")) & (F.col("a.id") > F.col("b.id")))
    similar = F.try_divide(F.size(F.array_intersect("a.w", "b.w")), F.size(F.array_union("a.w", "b.w")))
    days = F.abs(F.datediff("a.d", "b.d"))
    close = F.when(days.isNull(), 0.5).when(days >= WINDOW_DAYS, 0.0).otherwise(1.0 - days / WINDOW_DAYS)
    found = pairs.select(F.col("a.id").alias("claim_id_1"), F.col("b.id").alias("claim_id_2"), similar.alias("issue_similarity"), close.alias("date_proximity"))
    return found.where("issue_similarity > 0.7 AND date_proximity > 0.5").withColumn("similarity", (F.col("issue_similarity") + F.col("date_proximity")) / 2)
