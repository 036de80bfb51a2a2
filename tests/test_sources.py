"""Readers, sinks, hashing and streams on small fixtures."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyguard.functions import hashing
from tallyguard.operators import calibration, duplicates, geo
from tallyguard.sources import readers, sinks
from tallyguard.streaming import registry


def test_decisions_round_trip(spark, tmp_path):
    nested = spark.createDataFrame([("a.pdf", "real", 0.1, (3,), (9.5,))], "filename string, label string, score double, file struct<num_pages:int>, text struct<total_amount:double>")
    flat = sinks.flatten(nested)
    assert flat.columns == ["filename", "label", "score", "file_num_pages", "text_total_amount"]
    log = flat.selectExpr("filename", "label", "score", "'2024' AS timestamp_utc", "file_num_pages", "text_total_amount", "1 AS text_num_lines", "2 AS layout_num_lines", "0.5 AS forensic_uppercase_ratio")
    for _ in range(2):
        sinks.append(log, f"{tmp_path}/log", "csv")
    log = readers.decisions(spark, f"{tmp_path}/log").cache()
    assert log.count() == 2 and log.where("_corrupt IS NOT NULL").count() == 0
    (tmp_path / "odd.csv").write_text("filename,label,score,timestamp_utc,file_num_pages,text_total_amount,text_num_lines,layout_num_lines,forensic_uppercase_ratio\na.pdf,real,0.5,t,1,2.0,3,4,0.1\nb.pdf,real,much,t,1,2.0,3,4,0.1\n")
    odd = readers.decisions(spark, f"{tmp_path}/odd.csv").cache()
    assert [(r.filename, r.score) for r in odd.where("_corrupt IS NOT NULL").collect()] == [("b.pdf", None)] and odd.count() == 2


def test_feedback_gate_and_labels(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for i in range(5):
        (tmp_path / "f" / f"{i}.json").write_text(json.dumps({"feedback_id": str(i), "image_path": "x", "status": "trained" if i == 4 else "pending_training"}))
    assert readers.feedback(spark, f"{tmp_path}/f", least=4).count() == 4
    assert readers.feedback(spark, f"{tmp_path}/f", least=5).count() == 0
    (tmp_path / "l.jsonl").write_text('{"doc_id": "1", "annotator_judgments": [{"doc_outcome": "GENUINE"}]}\n{broken\n')
    rows = readers.labels(spark, f"{tmp_path}/l.jsonl").cache()
    assert sorted(r._corrupt is None for r in rows.collect()) == [False, True]


def test_upsert_delete_replace_export(spark, tmp_path):
    now = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, t int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 0)], "id long, v string, t int")
    merged = sinks.upserted(now, new, ["id"], "t")
    assert sorted(map(tuple, merged.collect())) == [(1, "a", 1), (2, "c", 1), (3, "d", 0)]
    left = sinks.deleted(merged, spark.createDataFrame([(1,)], "id long"))
    for _ in range(2):
        sinks.replace(left, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    sinks.export(left.withColumn("feedback_id", F.col("id").cast("string")), f"{tmp_path}/e")
    assert spark.read.json(f"{tmp_path}/e").count() == 2
    assert sinks.compact(spark, f"{tmp_path}/t", 1).rdd.getNumPartitions() == 1


def test_packs(spark, tmp_path):
    (tmp_path / "en.yaml").write_text("id: en\nwords: total")
    rows = readers.packs(spark, f"{tmp_path}/en.yaml", lambda text: (text.split("\n")[0][4:], text)).collect()
    assert rows[0].id == "en"


@pytest.mark.parametrize(("a", "b", "d"), [("0" * 16, "f" * 16, 64), ("ffffffffffffffff", "fffffffffffffffe", 1), ("8000000000000000", "0" * 16, 1), ("x", "0" * 16, 64), (None, "0" * 16, 64)])
def test_hamming(spark, a, b, d):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert (df.select(hashing.hamming(F.col("a"), F.col("b")).alias("d")).first().d or 64) == d


def test_near_images_by_brute_force(spark):
    import random

    rng, rows = random.Random(4), []
    for i in range(60):
        base = rng.getrandbits(64)
        for j in range(4):
            for bit in rng.sample(range(64), rng.randrange(8)):
                base ^= 1 << bit
            rows.append((i * 4 + j, f"{base:016x}"))
    rows = list({h: (i, h) for i, h in reversed(rows)}.values())  # equal hashes answer by their first
    got = {(r.image_1, r.image_2, r.distance) for r in duplicates.near_images(duplicates.image_members(spark.createDataFrame([(i, i, h, 300, 300) for i, h in rows], "image_id long, claim_id long, phash string, width int, height int"))).collect()}
    want = {(a, b, (int(x, 16) ^ int(y, 16)).bit_count()) for a, x in rows for b, y in rows if a < b and x != y and (int(x, 16) ^ int(y, 16)).bit_count() <= 10}
    assert {w[:2] for w in want} == {g[:2] for g in got} and want == got


def test_merchant_key_and_dates(spark):
    df = spark.createDataFrame([("NAYARA ENERGY PVT LTD", "3/4/2024"), (None, "2024-04-03"), ("Nayara  Energy", "x")], "m string, d string")
    rows = df.select(hashing.merchant_key(F.col("m")).alias("m"), hashing.date_key(F.col("d")).alias("d")).collect()
    assert [tuple(r) for r in rows] == [("nayara energy", "2024-04-03"), ("", "2024-04-03"), ("nayara energy", "x")]


def test_calibration_edges(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (0.05,), (1.0,), (2.0,), (None,)], "p double")
    got = [r.c for r in df.select(calibration.calibrate(F.col("p")).alias("c")).collect()]
    assert got[:2] == [0.05, 0.05] and got[2] == pytest.approx(0.085) and got[3:5] == [0.97, 0.97] and got[5] is None


def test_geo_by_example(spark):
    texts = ["GSTIN 29ABCDE1234F1Z5 PIN Code 560001 CGST 9% SGST 9% Bangalore", "Rechnung MwSt Berlin 10115 EUR", "", None, "hello"]
    rows = geo.infer(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.country for r in rows] == ["IN", "DE", "UNKNOWN", "UNKNOWN", "UNKNOWN"]


def test_stream_agrees_with_batch_over_several_batches(spark, tmp_path):
    schema = "id long, exact_fp string, fuzzy_fp string"
    for i, rows in enumerate([[(1, "a", "k"), (2, "b", "k")], [(3, "a", "k"), (4, "c", "m")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = registry.drained(registry.duplicates(stream), f"{tmp_path}/out", f"{tmp_path}/check").collect()
    assert len(out) == 4 and sum(r.status == "new" for r in out) == 2


def test_windows_close_with_the_watermark(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(day, "a"), (day + dt.timedelta(days=2), "a")], "ts timestamp, event_type string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(f"{tmp_path}/in")
    out = registry.drained(registry.windowed(stream), f"{tmp_path}/out", f"{tmp_path}/check").collect()
    assert [r.n for r in out] == [1]


def test_addresses_are_counted_once(spark):
    from tallyguard.operators import profiles

    texts = ["12 Main Street\nPune 411001\nMaharashtra India", "12 Main Street\nPune 411001\nThank you\nFlat 7, Baker Street\nLondon 12345\nUnited Kingdom", "hello\nthere", "", None]
    rows = profiles.multi_address(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()
    assert {r.id: r.status for r in rows} == {0: "SINGLE", 1: "MULTIPLE", 2: "UNKNOWN", 3: "UNKNOWN", 4: "UNKNOWN"}


def test_fuzzy_names_by_brute_force(spark):
    import difflib

    from tallyguard.operators import merchants

    known = ["Walmart Supercenter", "Whole Foods Market", "Trader Joe's Store", "Costco Wholesale"]
    names = ["walmart supercentre", "Whole Food Market", "Costco Wholesale", "Nothing alike here", "Trader Joes Stor", None]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    got = {r.id: (r.known, r.match) for r in merchants.fuzzy_matches(df, spark.createDataFrame([(k,) for k in known], "known string")).collect()}
    for i, name in enumerate(names):
        ratio, best = max((difflib.SequenceMatcher(None, name.lower(), k.lower()).ratio(), k.lower()) for k in known) if name else (0, None)
        assert got[i] == ((best, "exact" if ratio == 1 else "hit" if ratio > 0.85 else "typo") if ratio >= 0.7 else (None, None))


def test_fuzzy_names_with_spread_substitutions(spark, monkeypatch):
    import difflib
    import random

    from tallyguard.operators import merchants

    rng = random.Random(3)
    known = ["walmart", "supermarket", "aldi", "lidl", "a", ""] + ["".join(rng.choice("abcdeo") for _ in range(rng.randrange(3, 14))) for _ in range(30)]
    names = ["wolmort", "sapermorkat", "", "b", "Aldo"] + ["".join(rng.choice("aeo") if rng.random() < 0.25 else c for c in rng.choice(known)) for _ in range(60)]
    monkeypatch.setattr(merchants, "BLOCK", 16, raising=False)
    got = {r.id: (r.known, r.ratio) for r in merchants.fuzzy_matches(spark.createDataFrame(list(enumerate(names)), "id long, name string"), spark.createDataFrame([(k,) for k in known], "known string")).collect()}
    for i, name in enumerate(names):
        less, best = min((-difflib.SequenceMatcher(None, name.lower(), k).ratio(), k) for k in known)
        assert got[i] == ((best, round(-less, 6)) if -less >= 0.7 else (None, None))


def test_annotated_receipts(spark, tmp_path):
    from tallyguard.operators import templates
    from tallyguard.sources import readers

    boxes, entities = tmp_path / "box", tmp_path / "entities"
    boxes.mkdir()
    entities.mkdir()
    (boxes / "a1.txt").write_text("1,2,3,4,5,6,7,8,ACME, Ltd\r\n\n1,2,3,4,5,6,7,8,\nplain text\n1,2,short\n")
    (boxes / "a2.txt").write_text("1,2,3,4,5,6,7,8,Acme shop")
    (boxes / "a3.txt").write_text("other words")
    (boxes / "empty.txt").write_text("\n\n")
    (entities / "a1.txt").write_text('{"company": "ACME LTD", "total": "RM 1,234.50", "date": "01/02/2018"}')
    (entities / "a2.txt").write_text('{"company": "acme", "total": ""}')
    (entities / "a3.txt").write_text("no json")
    rows = readers.annotated_receipts(spark, str(boxes), str(entities))
    found = {r.receipt_id: (r.full_text, r.company, r.date, r.total) for r in rows.collect()}
    assert found == {"a1": ("ACME, Ltd\nplain text", "ACME LTD", "01/02/2018", 1234.5), "a2": ("Acme shop", "acme", None, None), "a3": ("other words", None, None, None)}
    groups = templates.cluster(rows, key="receipt_id", company="company")
    assert {r["name"]: r.n for r in groups.collect()} == {"acme": 2, "other": 1}


def test_packs_are_whole_files(spark, tmp_path):
    from tallyguard.sources import readers

    (tmp_path / "en.yaml").write_text("id: en\nwords:\n- total\n- tax\n")
    rows = readers.packs(spark, str(tmp_path), lambda text: (text.split("\n")[0][4:], str(text.count("\n"))))
    assert [tuple(r) for r in rows.collect()] == [("en", "4")]


def test_a_view_is_given_once():
    """A second view of a name would replace the first one under the queries that read it."""
    import tallyguard.plans  # noqa: F401
    from tallyguard.sources.views import VIEWS

    assert "n_geos" in VIEWS["geo_located"] and "address" in VIEWS["located"]
    with pytest.raises(ValueError):
        VIEWS["located"] = "SELECT 1 AS id"
