"""Operators on small cases that a shortcut would lose."""

import difflib
import random

import pytest

from tallyguard.operators import duplicates, layout, merchants, profiles, templates, warranty
from tallyguard.plans import QUERIES
from tallyguard.sources import sinks

DATA = "/root/testdata/sf0.001"


def test_fuzzy_names_by_brute_force(spark):
    known = ["walmart", "metro mart", "central park", "abcdefghij", "supermarket", "q", ""]
    names = ["valmert", "netra mort", "cantrel pbrk", "axcdxfgxij", "sapermorkat", "wolmort", "walmart", "zzz", None, ""]
    got = merchants.fuzzy_matches(spark.createDataFrame(list(enumerate(names)), "id int, name string"), spark.createDataFrame([(k,) for k in known], "known string"))
    for r in got.collect():
        name = names[r.id]
        best = None if name is None else max(((difflib.SequenceMatcher(None, name, k).ratio(), k) for k in known), key=lambda x: x[0])
        want = best[1] if best and best[0] >= merchants.TYPO else None
        assert r.known == want, name


def test_image_links_of_equal_hashes(spark):
    rows = [(1, 10, "00000000000000ff", 300, 300), (2, 20, "00000000000000FF", 300, 300), (3, 10, "00000000000000fe", 300, 300), (4, 30, "ff00000000000000", 3000, 300), (5, 30, "ff00000000000000", 300, 300), (6, 40, "f0f0f0f0f0f0f0f0", 3000, 300), (7, 50, "f0f0f0f0f0f0f0f0", 3000, 300)]
    members = duplicates.image_members(spark.createDataFrame(rows, "image_id long, claim_id long, phash string, width int, height int"))
    assert sorted((r.image_id, r.rep) for r in members.collect()) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 6), (7, 6)]
    pairs = {(r.image_1, r.image_2, r.distance) for r in duplicates.near_images(members).collect()}
    assert pairs == {(1, 1, 0), (1, 3, 1)}  # 4 and 5 are of one claim, 6 and 7 are banners


def test_templates_without_a_common_word(spark):
    text = "{}\nitem 1.00\nitem 2.00\ntax 0.30\ntotal 3.30\n"
    rows = [(i, n, text.format(n)) for i, n in enumerate(("alpha stores", "gamma hall"))]
    df = spark.createDataFrame(rows, "id long, merchant_name string, full_text string")
    for few in (0, 2000):
        held, templates.FEW_TEMPLATES = templates.FEW_TEMPLATES, few
        found = {(r.id, r.merchant_name) for r in templates.match(df, templates.learn(df)).collect()}
        templates.FEW_TEMPLATES = held
        assert found == {(0, "alpha stores"), (0, "gamma hall"), (1, "alpha stores"), (1, "gamma hall")}


def test_address_bounds_are_parameters(spark):
    rng = random.Random(1)
    streets = [f"{rng.choice(['Oak', 'Elm', 'Ash', 'Fir'])}{'abcdefghij'[i]} Avenue Block\nPune {411001 + 100 * i}\nMaharashtra India" for i in range(9)]
    df = spark.createDataFrame([(1, "\n\nThank you so much\n".join(streets)), (2, None)], "id long, text string")
    few, every = (profiles.multi_address(df, max_candidates=n, max_block=b).collect() for n, b in ((6, 250), (None, None)))
    count = lambda rows: {r.id: r.n_addresses for r in rows}
    assert count(every)[1] > count(few)[1] and count(every)[2] == count(few)[2] == 0


def test_replace_keeps_a_table_at_all_times(spark, tmp_path):
    path = f"{tmp_path}/t"
    for n in (3, 5):
        sinks.replace(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    assert not (tmp_path / "t.old").exists() and not (tmp_path / "t.next").exists()


@pytest.mark.parametrize("name", ["dealer_statistics", "dashboard_overview", "root_causes", "risk_and_triage", "warranty_signals"])
def test_lines_of_orders_are_read_once(spark, name):
    """What builds claims is written once; the query's own plan reads that."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_extendedprice" not in plan


def _greedy(boxes, share):
    kept = []
    for k, x0, y0, x1, y1 in sorted(boxes, key=lambda b: (-(b[3] - b[1]) * (b[4] - b[2]), b[0])):
        area = (x1 - x0) * (y1 - y0)
        for _, a, b, c, d in kept:
            both = max(0, min(x1, c) - max(x0, a)) * max(0, min(y1, d) - max(y0, b))
            if both > (area + (c - a) * (d - b) - both) * share:
                break
        else:
            kept.append((k, x0, y0, x1, y1))
    return {b[0] for b in kept}


def test_regions_as_one_by_one(spark):
    import random

    rng = random.Random(5)
    pages = {}
    for page in range(6):
        boxes = []
        for i in range(60):
            x, y, w, h = rng.randrange(40), rng.randrange(40), rng.choice((10, 11, 14, 30, 100)), rng.choice((10, 12, 15, 40))
            boxes.append((i, x, y, x + w, y + h))
        # a chain in which each box nearly covers the next, and equal boxes
        boxes += [(100 + i, 500 + 2 * i, 0, 520 + 2 * i, 10) for i in range(12)] + [(200 + i, 900, 0, 950, 10) for i in range(5)]
        pages[page] = boxes
    rows = [(p, *map(float, b[1:]), b[0]) for p, bs in pages.items() for b in bs] + [(9, 1.0, 1.0, 1.0, 5.0, 1), (9, None, 1.0, 1.0, 5.0, 2)]
    df = spark.createDataFrame(rows, "page long, x0 double, y0 double, x1 double, y1 double, region_id long")
    found = {}
    for r in layout.distinct_regions(df).collect():
        found.setdefault(r.page, {})[r.region_id] = r.rank
    for page, boxes in pages.items():
        assert set(found[page]) == _greedy(boxes, 0.7)
        assert sorted(found[page].values()) == list(range(1, len(found[page]) + 1))
    assert set(found[9]) == {1, 2}
    assert layout.distinct_regions(df.limit(0)).count() == 0


@pytest.mark.parametrize("together", [60, 50_000])
def test_regions_of_crowded_pages_form_no_pairs(spark, together, monkeypatch):
    """Pages cut into cells and rounds keep what is kept one by one, pages without a number are a page, and no written table outgrows the boxes."""
    rng = random.Random(8)
    draw = lambda i, far: (lambda x, y, w, h: (i, x, y, x + w, y + h))(rng.randrange(far), rng.randrange(far), rng.choice((20, 21, 23, 26, 50)), rng.choice((20, 22, 25)))
    pages = {1: [draw(i, 12) for i in range(400)], None: [draw(i, 90) for i in range(200)], 3: [draw(i, 12) for i in range(5)]}
    rows = [(p, *map(float, b[1:]), b[0]) for p, bs in pages.items() for b in bs] + [(1, 0.0, 0.0, float("inf"), 5.0, 900), (1, float("nan"), 0.0, 9.0, 5.0, 901)]
    df = spark.createDataFrame(rows, "page long, x0 double, y0 double, x1 double, y1 double, region_id long")
    written = []
    monkeypatch.setattr(layout, "stored", lambda t: written.append(sinks.stored(t)) or written[-1])
    monkeypatch.setattr(layout, "TOGETHER", together, raising=False)
    found = {}
    for r in layout.distinct_regions(df).collect():
        found.setdefault(r.page, set()).add(r.region_id)
    assert max(t.count() for t in written) <= len(rows)
    assert found.pop(1) == _greedy(pages[1], 0.7) | {900, 901}
    assert found == {p: _greedy(pages[p], 0.7) for p in (None, 3)}
    assert (len(written) > 1) == (together == 60)


def test_template_groups_and_their_merge(spark):
    rows = [(1, "Zebra Shop\nTotal 1.00\nTax 2.00\n\n  "), (2, "Zebra Shop\nTotal 1.00"), (3, "shop zebra\n1.00\n2.00\n3.00\n4.00\n5.00\n6.00\n7.00"), (4, "12\n34"), (5, ""), (6, None), (7, "Alpha Beta")]
    df = spark.createDataFrame(rows, "id long, full_text string")
    whole = templates.cluster(df)
    merged = templates.merge_groups(templates.cluster(df.where("id < 3")), templates.cluster(df.where("id >= 3")))
    key = lambda r: r["name"]
    assert sorted((r.asDict() for r in whole.collect()), key=key) == sorted((r.asDict() for r in merged.select(*whole.columns).collect()), key=key)
    found = {r.merchant_name: r for r in templates.generate(whole, least=1).collect()}
    # the first of the head's words in order: shop before total and zebra
    assert {k: r.n for k, r in found.items()} == {"shop": 3, "unknown": 1, "alpha": 1}
    shop = found["shop"]
    assert (shop.merchant, shop.line_count_lo, shop.line_count_hi, shop.amount_count_lo, shop.amount_count_hi) == (["shop", "total", "zebra"], 1, 6, 1, 7)
    # two of three have a total, one a tax
    assert (shop.has_total, shop.has_tax) == (True, False)
    assert found["unknown"].merchant == []
    # templates made this way are matched as learned ones are
    assert templates.match(df.where("id = 1"), templates.generate(whole, least=3).drop("n")).first().merchant_name == "shop"


def test_groups_by_company(spark):
    df = spark.createDataFrame([(1, "ACME Ltd", "x y"), (2, " acme ", "zzzz"), (3, " ", "word"), (4, None, "word")], "id long, company string, full_text string")
    assert {r["name"]: r.n for r in templates.cluster(df, company="company").collect()} == {"acme": 2, "word": 2}


def test_set_back_odometers_are_those_of_the_regressions(spark):
    """The signal needs no join with the vehicle's other claims, and names each claim that the regressions name, once."""
    rows = [(1, "A", "2020-01-01", 50), (2, "A", "2020-02-01", 40), (3, "A", "2020-02-01", 45), (4, "B", "2020-01-01", 9), (5, "B", "2020-01-02", 9), (6, None, "2020-01-01", 8), (7, None, "2020-01-02", 7), (8, "A", None, 1), (9, "A", "2020-03-01", None)]
    claims = spark.createDataFrame(rows, "id long, vin string, claim_date string, odometer int")
    found = warranty.set_back(claims)
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in warranty.odometer_regressions(claims).collect()) == [2, 3]
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_near_names_need_no_blocks(spark):
    """Names settled by equi-joins have the same best known name as among all, and those a letter away are settled."""
    rng = random.Random(5)
    known = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(80)} | {"supplier#01", "x" * 70})
    names = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 8))) for _ in range(80)} | {"suplier#01", "x" * 70, "x" * 69, "é"})
    got = {r.name: (r.known, r.ratio) for r in merchants.near_matches(spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x,) for x in known], "known string")).collect()}
    best = {x: min((-difflib.SequenceMatcher(None, x, k).ratio(), k) for k in known) for x in names}
    assert got == {x: (best[x][1], -best[x][0]) for x in got}
    assert {x for x in names if x in known} | {"suplier#01"} <= set(got) and "x" * 69 not in got and "é" not in got


def test_vehicle_signals_take_one_shuffle_and_count_claims_without_a_vehicle(spark):
    rows = [(1, "A", "2020-01-01", 50, 1), (2, "A", "2020-02-01", 40, 1), (3, "A", "2020-03-01", 60, 1), *((i, "B", "2020-01-01", 9, 1) for i in range(4, 8)), (8, "C", "2020-01-01", 3, 1), *((i, None, "2020-01-02", 20 - i, 1) for i in range(9, 12))]
    claims = spark.createDataFrame(rows, "id long, vin string, claim_date string, odometer int, total_c long")
    found = {tuple(r) for r in warranty.vehicle_signals(claims).collect()}
    many = {(i, "VIN_MULTIPLE_CLAIMS", "MEDIUM") for i in (1, 2, 3, 9, 10, 11)} | {(i, "VIN_EXCESSIVE_CLAIMS", "HIGH") for i in range(4, 8)}
    assert found == many | {(2, "ODOMETER_REGRESSION", "HIGH")}


def test_addresses_are_counted_in_their_own_row(spark):
    from tallyguard.operators import profiles

    docs = spark.createDataFrame([(1, "7 Main Street\nPune 411001\nMaharashtra India\nThank you\nFlat 7, Baker Street\nLondon 12345\nUnited Kingdom"), (2, None)], "id long, text string")
    counted = profiles.multi_address(docs)
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    assert [(r.id, r.status) for r in counted.orderBy("id").collect()] == [(1, "MULTIPLE"), (2, "UNKNOWN")]


def test_events_are_made_once(spark):
    from pyspark.sql import functions as F

    from tallyguard.operators import rules

    records = spark.createDataFrame([(1, 5), (2, None), (3, 0)], "id long, n int")
    events = rules.exploded(rules.evaluate(records, [rules.RuleSpec("A", F.col("n") > 1, "INFO", 1), rules.RuleSpec("B", F.col("n") > 2, "INFO", 1)]))
    assert "size(" not in events._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.id, r.e.rule_id) for r in events.orderBy("id", "e.ordinal").collect()] == [(1, "A"), (1, "B")]
