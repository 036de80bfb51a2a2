"""Signals, risk and triage of warranty claims.

Stateless checks are one array expression over the claim; checks against a
claim's history are window functions and joins on the vehicle or the dealer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Thresholds, weights and lists of the checks.
MAX_LABOR_TO_PARTS, MAX_TAX_RATE, MAX_AGE = 2.0, 0.15, 10
Z_LIMIT = 2.5
WEIGHTS = {"HIGH": 0.4, "MEDIUM": 0.2, "LOW": 0.1}
DUPLICATE_WEIGHTS = {"IMAGE_EXACT": 0.5, "IMAGE_LIKELY_SAME": 0.4, "IMAGE_SIMILAR": 0.2, "VIN_ISSUE_DUPLICATE": 0.3}
DUPLICATE_SIGNALS = {"IMAGE_EXACT": "DUPLICATE_IMAGE_EXACT", "IMAGE_LIKELY_SAME": "DUPLICATE_IMAGE_SIMILAR", "VIN_ISSUE_DUPLICATE": "POTENTIAL_DUPLICATE_CLAIM"}
INVESTIGATE, REVIEW = 0.7, 0.3
ALWAYS_INVESTIGATE = ("NEGATIVE_TAX", "FUTURE_CLAIM_DATE", "CLAIM_BEFORE_MANUFACTURE", "DECISION_BEFORE_CLAIM", "HIGH_RISK_DEALER")
COMPLEX_REPAIRS = ("transmission", "engine", "steering", "suspension")
WMI = {
    "1G": "Chevrolet", "2G": "Chevrolet", "1F": "Ford", "1FA": "Ford", "1FB": "Ford", "1H": "Honda", "2H": "Honda", "JH": "Honda", "1N": "Nissan", "JN": "Nissan",
    "2T": "Toyota", "4T": "Toyota", "JT": "Toyota", "WA": "Audi", "WV": "Volkswagen", "WB": "BMW", "JM": "Mazda", "4F": "Mazda", "KM": "Hyundai", "5N": "Hyundai",
    "KN": "Kia", "JF": "Subaru", "4S": "Subaru",
}
YEARS = {
    "A": 2010, "B": 2011, "C": 2012, "D": 2013, "E": 2014, "F": 2015, "G": 2016, "H": 2017, "J": 2018, "K": 2019,
    "L": 2020, "M": 2021, "N": 2022, "P": 2023, "R": 2024, "S": 2025, "T": 2026, "V": 2027, "W": 2028, "X": 2029,
    "1": 2001, "2": 2002, "3": 2003, "4": 2004, "5": 2005, "6": 2006, "7": 2007, "8": 2008, "9": 2009,
}
TYPICAL_HOURS = {"battery": 2, "oil leak": 4, "brake": 4, "alternator": 3, "fuel pump": 5, "transmission": 12, "engine": 20, "steering": 6}
TAX_RATES = {"US": (0.04, 0.12), "CA": (0.05, 0.15), "UK": (0.20, 0.20), "DE": (0.19, 0.19), "IN": (0.05, 0.28), "AE": (0.05, 0.05)}


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def money(claims: DataFrame) -> DataFrame:
    """Claims with their cents as the amounts that the checks take."""
    return claims.withColumns({k: F.col(f"{k}_c") / 100.0 for k in ("parts", "labor", "tax", "total")})


def _signal(name: str, severity: str, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(name).alias("signal_type"), F.lit(severity).alias("severity")))


def math_signals() -> list[Column]:
    parts, labor, tax, total = (F.col(x) for x in ("parts", "labor", "tax", "total"))
    subtotal = parts + labor
    return [
        _signal("NEGATIVE_TAX", "HIGH", tax < 0),
        _signal("NEGATIVE_PARTS_COST", "HIGH", parts < 0),
        _signal("NEGATIVE_LABOR_COST", "HIGH", labor < 0),
        _signal("TOTAL_MISMATCH", "MEDIUM", F.abs(parts + labor + tax - total) > 1.0),
        _signal("LABOR_PARTS_RATIO_HIGH", "MEDIUM", (parts > 0) & (F.try_divide(labor, parts) > MAX_LABOR_TO_PARTS)),
        _signal("TAX_RATE_HIGH", "MEDIUM", (parts != 0) & (labor != 0) & (subtotal > 0) & (F.try_divide(tax, subtotal) > MAX_TAX_RATE)),
    ]


def parse_date(text: Column) -> Column:
    """The first of year-month-day, month/day/year and day/month/year that fits."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "M/d/yyyy", "d/M/yyyy")))


def date_signals(as_of: str) -> list[Column]:
    claim, decision = parse_date(F.col("claim_date")), parse_date(F.col("decision_date"))
    age = F.year(claim) - F.col("year")
    return [
        _signal("FUTURE_CLAIM_DATE", "HIGH", claim > F.lit(as_of).cast("date")),
        _signal("VEHICLE_TOO_OLD", "MEDIUM", (F.col("year") != 0) & (age > MAX_AGE)),
        _signal("CLAIM_BEFORE_MANUFACTURE", "HIGH", (F.col("year") != 0) & (age < 0)),
        _signal("DECISION_BEFORE_CLAIM", "HIGH", F.datediff(decision, claim) < 0),
    ]


def pattern_signals() -> list[Column]:
    total = F.col("total")
    cents = F.filter(F.array(*(F.when(F.col(x) > 0, F.floor(F.col(x) * 100 % 100)) for x in ("parts", "labor", "tax"))), lambda c: c.isNotNull())
    known = F.col("parts").isNotNull() & F.col("labor").isNotNull() & F.col("tax").isNotNull()
    complex_repair = F.lower("issue").rlike("|".join(COMPLEX_REPAIRS))
    return [
        _signal("ROUND_TOTAL", "LOW", (total > 100) & (total == F.floor(total))),
        _signal("MATCHING_CENTS", "LOW", known & (F.size(cents) >= 2) & (F.size(F.array_distinct(cents)) == 1) & (F.get(cents, F.lit(0)) != 0)),
        _signal("ZERO_LABOR_COMPLEX_REPAIR", "MEDIUM", (F.col("labor") == 0) & complex_repair),
    ]


def vin_signals() -> list[Column]:
    vin = F.upper("vin")
    expected = F.coalesce(_map(WMI)[F.substring(vin, 1, 3)], _map(WMI)[F.substring(vin, 1, 2)])
    year = _map(YEARS)[F.substring(vin, 10, 1)]
    return [
        _signal("VIN_INVALID_FORMAT", "MEDIUM", F.length("vin") != 17),
        _signal("VIN_INVALID_FORMAT", "MEDIUM", vin.rlike("[IOQ]")),
        _signal("VIN_MODEL_MISMATCH", "HIGH", (F.length("vin") >= 3) & (F.lower("brand") != F.lower(expected))),
        _signal("VIN_MODEL_MISMATCH", "HIGH", (F.length("vin") >= 10) & (F.col("year") != 0) & (F.abs(year - F.col("year")) > 1)),
    ]


def labor_signals() -> list[Column]:
    hours, rate = F.col("labor_hours"), F.try_divide(F.col("labor"), F.col("labor_hours"))
    most = F.coalesce(*(F.when(F.lower("issue").contains(k), v) for k, v in TYPICAL_HOURS.items()))
    return [
        _signal("LABOR_RATE_OUTLIER", "MEDIUM", (hours > 0) & ((rate < 30) | (rate > 300))),
        _signal("EXCESSIVE_LABOR_HOURS_FOR_PART", "MEDIUM", hours > 2 * most),
    ]


def tax_geo_signals() -> list[Column]:
    rate = F.try_divide(F.col("tax"), F.col("total"))
    off = F.lit(False)
    for country, (low, high) in TAX_RATES.items():
        off = off | ((F.col("country_code") == country) & ((rate < low - 0.02) | (rate > high + 0.02)))
    return [_signal("TAX_INCONSISTENT_WITH_GEO", "MEDIUM", (F.col("total") > 0) & off)]


def image_signals() -> list[Column]:
    least = F.when(F.lower("issue").rlike("engine|transmission|body"), 3).otherwise(2)
    return [_signal("IMAGE_COUNT_MISMATCH", "LOW", F.col("image_count") < least)]


def stateless_signals(claims: DataFrame, as_of: str) -> DataFrame:
    """Claims with ``signals``: an array of (signal_type, severity) in the order of the checks."""
    every = [*math_signals(), *date_signals(as_of), *pattern_signals(), *vin_signals(), *labor_signals(), *tax_geo_signals(), *image_signals()]
    return money(claims).withColumn("signals", F.array_compact(F.array(*every)))


def _of(rows: DataFrame, name: Column | str, severity: Column | str) -> DataFrame:
    """``rows``' ids with a signal each."""
    return rows.select("id", *((F.lit(x) if isinstance(x, str) else x).alias(n) for n, x in (("signal_type", name), ("severity", severity))))


def history_signals(claims: DataFrame, matches: DataFrame, benchmarks: DataFrame, feedback: DataFrame, as_of: str) -> DataFrame:
    """``id``, ``signal_type``, ``severity``: what benchmarks, the vehicle's and the dealer's history and duplicates say of each claim."""
    scored = benchmark_scores(claims, benchmarks)
    above = (("TOTAL_ABOVE_BENCHMARK", "MEDIUM", "total_above"), ("PARTS_COST_ABOVE_BENCHMARK", "LOW", "parts_above"), ("LABOR_COST_ABOVE_BENCHMARK", "LOW", "labor_above"))
    found = scored.select("id", F.explode(F.array_compact(F.array(*(_signal(n, s, F.col(c)) for n, s, c in above)))).alias("s")).select("id", "s.signal_type", "s.severity")
    found = found.union(vehicle_signals(claims)).union(_of(repeat_claims(claims), "REPEAT_CLAIM_SAME_PART_SHORT_WINDOW", "MEDIUM"))

    confirmed = feedback.where("verdict = 'CONFIRMED_FRAUD'").groupBy(F.col("receipt_id").alias("f_id")).agg(F.count("*").alias("frauds"))
    known = claims.join(confirmed, claims["id"] == confirmed["f_id"], "left").groupBy("dealer_id").agg(F.count("*").alias("total_claims"), F.sum(F.coalesce("frauds", F.lit(0))).alias("fraud_confirmed"))
    risky = dealer_history_signals(known.withColumn("duplicate_count", F.lit(0))).where("signal IS NOT NULL").select("dealer_id", F.lit("HIGH_RISK_DEALER").alias("signal_type"), F.lit("HIGH").alias("severity"))
    spikes = dealer_spikes(claims, as_of).where("spike").select("dealer_id", F.lit("DEALER_SPIKE_IN_CLAIMS"), F.lit("MEDIUM"))
    found = found.union(claims.select("id", "dealer_id").join(risky.union(spikes), "dealer_id").select("id", "signal_type", "severity"))

    twin = matches.select(F.col("claim_id_1").alias("id"), _map(DUPLICATE_SIGNALS)[F.col("match_type")].alias("signal_type")).where("signal_type IS NOT NULL")
    return found.union(_of(twin, F.col("signal_type"), F.when(F.col("signal_type") == "POTENTIAL_DUPLICATE_CLAIM", "MEDIUM").otherwise("HIGH")))


def risk_and_triage(signalled: DataFrame, matches: DataFrame, columns: list[str] | None = None, history: DataFrame | None = None) -> DataFrame:
    """``columns`` (``id`` alone by default), ``risk_score``, ``triage_class``, ``is_suspicious`` and ``n_signals`` of every claim.

    Risk sums the weights of a claim's signals, its own and those of
    ``history``, and of the duplicates found for it, up to 1. Weights are
    tenths, so sums are of whole tenths; history is summed by claim before it
    is joined.
    """
    tenths = _map({k: int(v * 10) for k, v in WEIGHTS.items()})
    if history is None:
        history = signalled.select("id", F.lit("").alias("signal_type"), F.lit("").alias("severity")).limit(0)
    is_high = F.col("severity") == "HIGH"
    past = history.groupBy(F.col("id").alias("h_id")).agg(
        F.sum(tenths[F.col("severity")]).alias("h_tenths"), F.count("*").alias("h_n"), F.max(is_high).alias("h_high"), F.max(is_high & F.col("signal_type").isin(*ALWAYS_INVESTIGATE)).alias("h_grave")
    )
    signalled = signalled.join(past, signalled["id"] == past["h_id"], "left")
    found = matches.groupBy(F.col("claim_id_1").alias("m_id")).agg(
        F.sum(F.coalesce(_map({k: int(v * 10) for k, v in DUPLICATE_WEIGHTS.items()})[F.col("match_type")], F.lit(0))).alias("m_tenths"),
        F.max((F.col("match_type") == "IMAGE_EXACT").cast("int")).alias("exact"),
        F.count("*").alias("m_n"),
    )
    joined = signalled.join(found, signalled["id"] == found["m_id"], "left")
    own = F.aggregate("signals", F.lit(0), lambda a, s: a + tenths[s["severity"]])
    none = F.lit(False)
    risk = F.least(F.lit(10), own + F.coalesce("h_tenths", F.lit(0)) + F.coalesce("m_tenths", F.lit(0))) / 10.0
    grave = F.coalesce("h_grave", none) | F.exists("signals", lambda s: (s["severity"] == "HIGH") & s["signal_type"].isin(*ALWAYS_INVESTIGATE))
    high = F.coalesce("h_high", none) | F.exists("signals", lambda s: s["severity"] == "HIGH")
    triage = F.when((F.coalesce("exact", F.lit(0)) == 1) | grave | (risk >= INVESTIGATE), "INVESTIGATE").when(risk >= REVIEW, "REVIEW").otherwise("AUTO_APPROVE")
    return joined.select(
        *(columns or ["id"]),
        risk.alias("risk_score"),
        triage.alias("triage_class"),
        ((risk >= REVIEW) | (F.coalesce("m_n", F.lit(0)) > 0) | high).alias("is_suspicious"),
        (F.size("signals") + F.coalesce("h_n", F.lit(0))).cast("long").alias("n_signals"),
    )


def benchmark_scores(claims: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """z-scores of total, parts and labor against the brand's benchmark of the issue, else the generic one."""
    b = benchmarks.select(F.col("brand").alias("b_brand"), F.col("issue_type"), *(F.col(f"{s}_{k}") for s in ("avg", "std") for k in ("parts", "labor", "total")))
    own, generic = b.where("b_brand IS NOT NULL"), b.where("b_brand IS NULL").drop("b_brand")
    generic = generic.select(F.col("issue_type").alias("g_issue"), *(F.col(c).alias(f"g_{c}") for c in generic.columns if c != "issue_type"))
    c = money(claims)
    j = c.join(own, (c["brand"] == own["b_brand"]) & (c["issue"] == own["issue_type"]), "left").join(generic, c["issue"] == generic["g_issue"], "left")
    out = {}
    for k in ("parts", "labor", "total"):
        avg = F.when(F.col("b_brand").isNotNull(), F.col(f"avg_{k}")).otherwise(F.col(f"g_avg_{k}"))
        std = F.when(F.col("b_brand").isNotNull(), F.col(f"std_{k}")).otherwise(F.col(f"g_std_{k}"))
        out[f"z_{k}"] = F.when((avg != 0) & (std > 0), (F.col(k) - avg) / std)
    j = j.withColumns(out)
    return j.select(
        "id", F.coalesce("b_brand", F.when(F.col("g_issue").isNotNull(), "generic")).alias("benchmark"), *out,
        *((F.col(f"z_{k}") > Z_LIMIT).alias(f"{k}_above") for k in ("parts", "labor", "total")),
    )


def set_back(claims: DataFrame) -> DataFrame:
    """Claims whose vehicle had a larger odometer in an earlier claim: one window, without which claim it was. Null vehicles have none."""
    before = W.partitionBy("vin").orderBy("claim_date", "id").rowsBetween(W.unboundedPreceding, -1)
    return claims.where("vin IS NOT NULL").withColumn("most", F.max("odometer").over(before)).where("most > odometer")


def vehicle_signals(claims: DataFrame) -> DataFrame:
    """``id``, ``signal_type``, ``severity``: how many claims a claim's vehicle has, and whether its odometer was set back.

    Both from one shuffle and one sort by vehicle. Claims without a vehicle count together, by a sum and not in a window,
    as they may be many; their odometers tell nothing.
    """
    order = W.partitionBy("vin").orderBy("claim_date", "id")
    rows = claims.where("vin IS NOT NULL").select("id", "vin", "claim_date", "odometer").withColumns({
        "n": F.count("*").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), "most": F.max("odometer").over(order.rowsBetween(W.unboundedPreceding, -1)),
    })
    many = F.when(F.col("n") >= 4, F.struct(F.lit("VIN_EXCESSIVE_CLAIMS").alias("signal_type"), F.lit("HIGH").alias("severity"))).when(F.col("n") == 3, F.struct(F.lit("VIN_MULTIPLE_CLAIMS").alias("signal_type"), F.lit("MEDIUM").alias("severity")))
    told = rows.select("id", F.explode(F.array(many, _signal("ODOMETER_REGRESSION", "HIGH", F.col("most") > F.col("odometer")))).alias("s")).where("s IS NOT NULL").select("id", "s.signal_type", "s.severity")
    nameless = vin_history(claims.where("vin IS NULL")).where("signal IS NOT NULL")
    return told.union(_of(nameless, F.col("signal"), F.when(F.col("signal") == "VIN_EXCESSIVE_CLAIMS", "HIGH").otherwise("MEDIUM")))


def odometer_regressions(claims: DataFrame) -> DataFrame:
    """Claims whose vehicle had a larger odometer in an earlier claim, with the latest such claim.

    A running maximum over the vehicle's earlier claims finds them; only those
    claims are joined with their vehicle's others.
    """
    found = set_back(claims.select("id", "vin", "claim_date", "odometer")).select("id", "vin", "claim_date", "odometer")
    prior = claims.select(F.col("vin").alias("p_vin"), F.col("id").alias("p_id"), F.col("claim_date").alias("p_date"), F.col("odometer").alias("p_odometer"))
    earlier = F.struct("p_date", "p_id") < F.struct(F.col("claim_date").alias("p_date"), F.col("id").alias("p_id"))
    joined = found.join(prior, (F.col("vin") == F.col("p_vin")) & (F.col("p_odometer") > F.col("odometer")) & earlier)
    latest = joined.groupBy("id", "odometer").agg(F.max_by(F.struct("p_id", "p_odometer", "p_date"), F.struct("p_date", "p_id")).alias("p"))
    return latest.select("id", F.col("odometer").alias("current_odometer"), F.col("p.p_id").alias("prior_claim_id"), F.col("p.p_odometer").alias("prior_odometer"), F.col("p.p_date").alias("prior_claim_date"))


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def repeat_claims(claims: DataFrame, days: int = 90, common: int = 2) -> DataFrame:
    """Claims with an earlier claim of the same vehicle within ``days`` that shares ``common`` words; the lowest id is named."""
    a = claims.select("id", "vin", F.to_date("claim_date").alias("d"), words(F.col("issue")).alias("w"))
    b = a.select(F.col("id").alias("p_id"), F.col("vin").alias("p_vin"), F.col("d").alias("p_d"), F.col("w").alias("p_w"))
    near = F.datediff("d", "p_d").between(0, days) & (F.col("p_id") != F.col("id")) & (F.struct("p_d", "p_id") < F.struct(F.col("d").alias("p_d"), F.col("id").alias("p_id")))
    pairs = a.join(b, (F.col("vin") == F.col("p_vin")) & near).where(F.size(F.array_intersect("w", "p_w")) >= common)
    return pairs.groupBy("id").agg(F.min("p_id").alias("prior_claim_id"), F.count("*").alias("n_similar"))


def vin_history(claims: DataFrame) -> DataFrame:
    """How many other claims a claim's vehicle has, over what dates and cents, and the signal of it."""
    per = claims.groupBy(F.col("vin").alias("h_vin")).agg(F.count("*").alias("n"), F.sum("total_c").alias("sum_c"), F.min("claim_date").alias("first_claim"), F.max("claim_date").alias("last_claim"))
    rows = claims.join(per, claims["vin"].eqNullSafe(per["h_vin"])).select(
        "id", "vin", (F.col("n") - 1).alias("other_claims"), (F.col("sum_c") - F.col("total_c")).alias("other_total_c"), "first_claim", "last_claim"
    )
    return rows.withColumn("signal", F.when(F.col("other_claims") >= 3, "VIN_EXCESSIVE_CLAIMS").when(F.col("other_claims") >= 2, "VIN_MULTIPLE_CLAIMS"))


def dealer_spikes(claims: DataFrame, as_of: str, days: int = 30, factor: float = 2.5) -> DataFrame:
    """Claims by dealer in the last ``days`` and in the ``days`` before, by string comparison of dates."""
    today = F.lit(as_of).cast("date")
    recent = F.col("claim_date") >= F.date_sub(today, days).cast("string")
    prior = (F.col("claim_date") >= F.date_sub(today, 2 * days).cast("string")) & ~recent
    counted = claims.groupBy("dealer_id").agg(F.count_if(recent).alias("recent"), F.count_if(prior).alias("prior"))
    return counted.withColumn("spike", (F.col("prior") > 0) & (F.col("recent") > F.col("prior") * factor))


def dealer_statistics(claims: DataFrame, matches: DataFrame, feedback: DataFrame) -> DataFrame:
    """Counts, means and dates of every dealer of ``claims`` (with ``is_suspicious``), with its duplicates and confirmed frauds.

    A match counts once for each of its sides that is the dealer's: the
    disjunctive join becomes a union of two equi-joins, pre-counted by claim.
    """
    sides = matches.select(F.col("claim_id_1").alias("side")).union(matches.select("claim_id_2")).groupBy("side").agg(F.count("*").alias("dups"))
    both_one = matches.where("claim_id_1 = claim_id_2").groupBy(F.col("claim_id_1").alias("same")).agg(F.count("*").alias("twice"))
    frauds = feedback.where("verdict = 'CONFIRMED_FRAUD'").groupBy(F.col("receipt_id").alias("f_id")).agg(F.count("*").alias("frauds"))
    c = claims
    c = c.join(sides, c["id"] == sides["side"], "left").join(both_one, c["id"] == both_one["same"], "left").join(frauds, c["id"] == frauds["f_id"], "left")
    zero = F.lit(0)
    n = F.count("*")
    return c.groupBy("dealer_id").agg(
        n.alias("total_claims"), F.count_if(F.col("status") == "Approved").alias("approved_claims"), F.count_if(F.col("status") == "Rejected").alias("rejected_claims"),
        F.sum(F.coalesce("frauds", zero)).alias("fraud_confirmed"), F.sum(F.coalesce("dups", zero) - F.coalesce("twice", zero)).alias("duplicate_count"),
        F.count_if("is_suspicious").alias("suspicious_count"), (F.sum("total_c") / n / 100.0).alias("avg_claim_amount"), (F.sum("parts_c") / n / 100.0).alias("avg_parts_cost"),
        (F.sum("labor_c") / n / 100.0).alias("avg_labor_cost"), F.min("claim_date").alias("first_claim_date"), F.max("claim_date").alias("last_claim_date"),
    )


def dealer_history_signals(statistics: DataFrame) -> DataFrame:
    """Dealers of more than five claims by their share of confirmed frauds."""
    rate = F.try_divide("fraud_confirmed", "total_claims")
    enough = (F.col("fraud_confirmed") > 0) & (F.col("total_claims") > 5)
    return statistics.select(
        "dealer_id", rate.alias("fraud_rate"), F.when(enough & (rate > 0.1), "HIGH_RISK_DEALER").alias("signal"),
        F.when(enough & (rate > 0.05) & (rate <= 0.1), "elevated fraud rate").alias("warning"), (F.col("duplicate_count") > 2).alias("many_duplicates"),
    )
