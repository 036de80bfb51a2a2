"""Geography against currency and tax, on records written out."""

from tallyguard.operators import geo_rules as Q

COUNTRIES = [("IN", ["INR"], "STRICT"), ("US", ["USD"], "STRICT"), ("AU", ["AUD"], "RELAXED")]
TAXES = [("IN", "GST", "2020-01-01", None), ("IN", "OLD", "2000-01-01", "2019-12-31"), ("US", "SALES_TAX", "2020-01-01", None)]


def events(spark, **given):
    row = {"id": 1, "merchant": "Shop", "full_text": "thanks", "geos": ["US"], "geo_country": "US", "geo_conf": 0.9, "currency": None, "tax_regime": None} | given
    schema = "id long, merchant string, full_text string, geos array<string>, geo_country string, geo_conf double, currency string, tax_regime string"
    found = Q.consistency(
        spark.createDataFrame([tuple(row.values())], schema),
        spark.createDataFrame(COUNTRIES, "country string, currencies array<string>, tier string"),
        spark.createDataFrame(TAXES, "country string, tax_name string, effective_from string, effective_to string"),
        "2024-01-31",
    )
    return [(r.rule_id, r.severity, r.thousandths) for r in found.orderBy("ordinal").collect()]


def test_events(spark):
    assert events(spark) == []
    assert events(spark, currency="EUR") == [("GEO_CURRENCY_MISMATCH", "CRITICAL", 175.0)]
    assert events(spark, currency="EUR", geo_conf=0.5) == [("GEO_CURRENCY_MISMATCH", "INFO", 0.0)]
    assert events(spark, currency="EUR", full_text="Grand HOTEL") == [("GEO_CURRENCY_MISMATCH", "WARNING", 105.0), ("GEO_TRAVEL_SOFTENER", "INFO", 0.0)]
    assert events(spark, geo_country="AU", geos=["AU"], currency="EUR", full_text="hotel") == [("GEO_CURRENCY_MISMATCH", "CRITICAL", 175.0)]
    assert events(spark, tax_regime="VAT") == [("GEO_TAX_MISMATCH", "CRITICAL", 126.0)]
    assert events(spark, geos=["IN"], geo_country="IN", tax_regime="OLD") == [("GEO_TAX_MISMATCH", "CRITICAL", 126.0)]
    assert events(spark, geos=["IN"], geo_country="IN", tax_regime="VAT", full_text="VAT TIN 9") == []
    assert events(spark, geos=["IN"], geo_country="IN", tax_regime="VAT", full_text="VAT TIN 9, VAT 5%") == [("GEO_TAX_MISMATCH", "CRITICAL", 126.0)]
    assert events(spark, geos=["US", "IN"], currency="EUR", tax_regime="VAT") == [("GEO_CROSS_BORDER_HINTS", "INFO", 0.0)]
    assert events(spark, geos=None, currency="EUR") == events(spark, geos=[], tax_regime="GST") == [("GEO_NO_REGION_HINT", "INFO", 0.0)]
    assert events(spark, geo_country="UNKNOWN", currency="EUR") == []
    assert events(spark, merchant="City Dental", currency="CAD", geo_conf=0.1) == [("GEO_CURRENCY_MISMATCH", "INFO", 0.0), ("MERCHANT_CURRENCY_IMPLAUSIBLE", "CRITICAL", 154.0)]
    assert events(spark, merchant="Available goods", currency="USD") == events(spark, merchant=None, full_text=None) == []


def test_known_words_are_those_that_stand_alone_or_at_an_end(spark):
    from pyspark.sql import functions as F

    from tallyguard.operators import geo

    texts = ["gst paid in new york today", "gstin", "a gst", "agst b", "pin code", "newyork pan", "", " rs "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    found = [set(r[0]) for r in rows.orderBy("i").select(geo.known_words(F.col("t"))).collect()]
    naive = [{w for w in geo.WORDS if f" {w} " in f" {t} " or t.startswith(w) or t.endswith(w)} for t in texts]
    assert found == naive
    assert naive[0] == {"gst", "new york"} and naive[7] == {"rs"}
