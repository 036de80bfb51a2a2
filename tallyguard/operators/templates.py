"""Template fingerprints and matching, merchants and document types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Weights in hundredths, fake words, and intents by subtype.
WEIGHTS = {"merchant": 25, "header": 10, "footer": 10, "line_count": 10, "amount_count": 10, "has_tax": 8, "has_subtotal": 7, "has_total": 5, "has_time": 5, "has_separator": 5, "has_table": 5}
FAKE_WORDS = ("test", "sample", "dummy", "fake", "xxx", "zzz", "abc", "temp")
INTENTS = {
    "POS_RETAIL": "PURCHASE", "POS_RESTAURANT": "PURCHASE", "FUEL": "PURCHASE", "PARKING": "PURCHASE", "MISC": "PURCHASE", "TRANSPORT": "TRANSPORT", "TAX_INVOICE": "BILLING",
    "COMMERCIAL_INVOICE": "BILLING", "SERVICE_INVOICE": "BILLING", "CREDIT_NOTE": "REIMBURSEMENT", "UTILITY": "SUBSCRIPTION", "SHIPPING_BILL": "TRANSPORT", "PAYMENT_RECEIPT": "PROOF_OF_PAYMENT", "STATEMENT": "STATEMENT",
}


#: Templates, of a few kilobytes each, that may be broadcast.
FEW_TEMPLATES = 2000


def keywords(lines: Column) -> Column:
    """Words of four letters or more, each once."""
    return F.array_distinct(F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(F.lower(x), F.lit("[a-z]{4,}"), F.lit(0)))))


def fingerprint(text: Column) -> dict[str, Column]:
    """What a template is compared by: words of the first, next and last lines, counts and flags."""
    ls, lower = F.split(text, "\n", -1), F.lower(text)
    n = F.size(ls)
    return {
        "merchant": keywords(F.slice(ls, 1, 5)),
        "header": keywords(F.slice(ls, 2, 4)),
        "footer": keywords(F.slice(ls, F.greatest(n - 4, F.lit(1)), 5)),
        "line_count": n,
        "amount_count": F.regexp_count(text, F.lit(r"\d+\.\d{2}")),
        "has_tax": lower.rlike("tax|gst|vat"),
        "has_subtotal": lower.contains("subtotal"),
        "has_total": lower.contains("total"),
        "has_time": text.rlike(r"\b\d{1,2}:\d{2}\b"),
        "has_separator": text.rlike("(?m)^[-=*]{3,}$"),
        "has_table": lower.rlike("qty|quantity"),
    }


def learn(receipts: DataFrame) -> DataFrame:
    """A template for every merchant: words in common use, ranges of counts, flags that hold for any of its receipts."""
    fp = fingerprint(F.col("full_text"))
    rows = receipts.select("merchant_name", *(c.alias(k) for k, c in fp.items()))
    words = {k: F.array_sort(F.array_distinct(F.flatten(F.collect_set(k)))).alias(k) for k in ("merchant", "header", "footer")}
    counts = [f(k).alias(f"{k}_{n}") for k in ("line_count", "amount_count") for n, f in (("lo", F.min), ("hi", F.max))]
    return rows.groupBy("merchant_name").agg(*words.values(), *counts, *(F.max(k).alias(k) for k in WEIGHTS if k.startswith("has_")))


#: Flags that a template takes by majority.
FLAGS = ("has_tax", "has_subtotal", "has_total", "has_time", "has_separator", "has_table")


def cluster(receipts: DataFrame, key: str = "id", text: str = "full_text", company: str | None = None) -> DataFrame:
    """Groups of receipts by the first word of their ``company`` or, without one, the first of their head's words in order.

    A group is what its receipts add up to: counts, bounds, how many have each
    flag, and words. Two tables of groups make one by ``merge_groups``. Words are
    made distinct before they are gathered, so that a group's size is its
    vocabulary's. Receipts without a word are the group ``unknown``; null and
    empty texts are left out.
    """
    t = F.concat_ws("\n", F.filter(F.transform(F.split(F.col(text), "\n", -1), lambda x: F.trim(x)), lambda x: x != ""))
    fp = fingerprint(F.col("text"))
    rows = receipts.select(F.col(key).alias("id"), t.alias("text"), (F.col(company) if company else F.lit(None).cast("string")).alias("company")).where("text <> ''")
    rows = rows.select("id", "company", *(c.alias(k) for k, c in fp.items()))
    named = F.nullif(F.split(F.trim(F.lower("company")), r"\s+")[0], F.lit(""))
    rows = rows.withColumn("name", F.substring(F.coalesce(named, F.array_min("merchant"), F.lit("unknown")), 1, 20))
    # a receipt's own bounds are wide; a group's lie about the lowest and highest lower bound
    low = {"line_count": F.greatest(F.lit(1), F.col("line_count") - 10), "amount_count": F.greatest(F.lit(1), F.col("amount_count") - 5)}
    numbers = [f(c).alias(f"{k}_{n}") for k, c in low.items() for n, f in (("min", F.min), ("max", F.max))]
    groups = rows.groupBy("name").agg(F.count("*").alias("n"), *numbers, *(F.count_if(k).alias(k) for k in FLAGS))
    return groups.join(_gathered(rows), "name", "left")


def _gathered(rows: DataFrame) -> DataFrame:
    roles = ("merchant", "header", "footer")
    sets = F.explode(F.array(*(F.struct(F.lit(k).alias("role"), F.col(k).alias("words")) for k in roles))).alias("w")
    words = rows.select("name", sets).select("name", "w.role", F.explode("w.words").alias("word")).distinct()
    return words.groupBy("name").agg(*(F.array_sort(F.collect_list(F.when(F.col("role") == k, F.col("word")))).alias(k) for k in roles))


def merge_groups(*groups: DataFrame) -> DataFrame:
    """Tables of groups as one, as if all their receipts had been grouped at once."""
    rows = groups[0]
    for g in groups[1:]:
        rows = rows.unionByName(g)
    bounds = [f(f"{k}_{n}").alias(f"{k}_{n}") for k in ("line_count", "amount_count") for n, f in (("min", F.min), ("max", F.max))]
    empty = F.array().cast("array<string>")
    words = rows.withColumns({k: F.coalesce(k, empty) for k in ("merchant", "header", "footer")})
    return rows.groupBy("name").agg(F.sum("n").alias("n"), *bounds, *(F.sum(k).alias(k) for k in FLAGS)).join(_gathered(words), "name", "left")


def generate(groups: DataFrame, least: int = 3) -> DataFrame:
    """Templates of groups of ``least`` receipts or more, in the form that ``match`` takes: bounds with slack, flags that most receipts have."""
    slack = {"line_count": (5, 5), "amount_count": (3, 5)}
    bounds = [c.cast("int").alias(f"{k}_{n}") for k, (down, up) in slack.items() for n, c in (("lo", F.greatest(F.lit(1), F.col(f"{k}_min") - down)), ("hi", F.col(f"{k}_max") + up))]
    empty = F.array().cast("array<string>")
    return groups.where(F.col("n") >= least).select(F.col("name").alias("merchant_name"), "n", *(F.coalesce(k, empty).alias(k) for k in ("merchant", "header", "footer")), *bounds, *((F.col(k) > F.floor(F.col("n") / 2)).alias(k) for k in FLAGS))


def _jaccard(a: Column, b: Column) -> Column:
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 0.5).otherwise(F.coalesce(F.try_divide(both, any_), F.lit(0.0)))


def _in_range(x: Column, lo: Column, hi: Column) -> Column:
    away = F.greatest(lo - x, x - hi, F.lit(0))
    return F.greatest(F.lit(0.0), 1.0 - away * 0.1)


def match(receipts: DataFrame, templates: DataFrame, top: int = 3, least: float = 0.5) -> DataFrame:
    """The ``top`` templates of each receipt that reach ``least``, of all templates.

    No word has to be shared: counts and flags alone can reach ``least``. So
    each receipt meets every template. Up to ``FEW_TEMPLATES`` of them are
    broadcast, in blocks, as the set that receipts are asked against; more are
    dealt over parts of the receipts instead.
    """
    fp = fingerprint(F.col("full_text"))
    r = receipts.select("id", *(c.alias(f"r_{k}") for k, c in fp.items()))
    if templates.count() <= FEW_TEMPLATES:
        j = r.withColumn("part", F.lit(0)).join(F.broadcast(templates.withColumn("part", F.lit(0))), "part")
    else:
        parts = int(receipts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = templates.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        j = r.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).join(dealt.hint("merge"), "part")
    parts = [_jaccard(F.col(f"r_{k}"), F.col(k)) * WEIGHTS[k] for k in ("merchant", "header", "footer")]
    parts += [_in_range(F.col(f"r_{k}"), F.col(f"{k}_lo"), F.col(f"{k}_hi")) * WEIGHTS[k] for k in ("line_count", "amount_count")]
    parts += [F.when(F.col(f"r_{k}") == F.col(k), 1.0).otherwise(0.5) * w for k, w in WEIGHTS.items() if k.startswith("has_")]
    scored = j.withColumn("score", F.round(sum(parts, F.lit(0.0)) / 100.0, 6)).where(F.col("score") >= least)
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "merchant_name"))
    return scored.select("id", "merchant_name", "score", rank.alias("rank")).where(F.col("rank") <= top)


def merchant_check(name: Column) -> dict[str, Column]:
    """Issues of a merchant's name, by what they take off the confidence (hundredths)."""
    lower = F.lower(name)
    upper = (name == F.upper(name)) & (name != lower)
    rules = (
        ("repeated", name.rlike(r"(.)\1\1"), 40), ("special", name.rlike(r"[^a-zA-Z0-9\s\-&'.()]"), 20), ("capitals", upper & (F.length(name) > 5), 15), ("short", F.length(name) < 3, 30),
        ("long", F.length(name) > 50, 20), ("fake", lower.rlike("|".join(FAKE_WORDS)), 60), ("digits", F.replace(name, F.lit(" ")).rlike(r"^\d+$"), 50), ("punctuation", F.length(F.regexp_replace(name, r"[\w\s]", "")) > 5, 20),
    )
    off = sum((F.when(c, w).otherwise(0) for _, c, w in rules), F.lit(0))
    return {"issues": F.array_join(F.array_compact(F.array(*(F.when(c, n) for n, c, _ in rules))), ","), "confidence": F.greatest(F.lit(0), 100 - off) / 100.0, "valid": 100 - off > 50}


def intent(subtype: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in INTENTS.items() for x in pair))
    return F.coalesce(table[F.upper(subtype)], F.lit("UNKNOWN"))


def domain(records: DataFrame, packs: list[dict]) -> DataFrame:
    """The best domain pack of every record: satisfied groups over all groups; a missing group of all or a forbidden word gives 0."""
    fields = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), c) for c in ("merchant", "total", "tax", "receipt_date", "cgst", "shipping"))))
    rows = records.select("id", fields.alias("have"), F.lower(F.coalesce("producer", F.lit(""))).alias("text"))
    scored = []
    for i, p in enumerate(packs):
        any_hits = [F.arrays_overlap("have", F.array(*map(F.lit, g))) for g in p.get("required_any", ())]
        all_hits = [F.size(F.array_intersect("have", F.array(*map(F.lit, g)))) == len(g) for g in p.get("required_all", ())]
        n = len(any_hits) + len(all_hits)
        hits = sum((F.when(h, 1).otherwise(0) for h in (*any_hits, *all_hits)), F.lit(0))
        barred = F.lit(False)
        for word in p.get("forbidden", ()):
            barred = barred | F.col("text").contains(word)
        for h in all_hits:
            barred = barred | ~h
        conf = F.when(barred, 0.0).otherwise(hits / float(max(1, n)))
        scored.append(F.struct(conf.alias("confidence"), F.lit(-i).alias("order"), F.lit(p["id"]).alias("domain")))
    best = F.array_max(F.array(*scored))
    return rows.select("id", F.when(best["confidence"] > 0, best["domain"]).alias("domain"), best["confidence"].alias("confidence"))
