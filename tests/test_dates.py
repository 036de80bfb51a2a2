"""Dates and times of texts, with values written out."""

from tallyguard.functions import dates as D
from tallyguard.operators import dates as O


def scan(spark, *texts):
    rows = O.scanned(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, full_text string")).orderBy("id").collect()
    return [(r.first_date, list(r.all_dates), r.first_time) for r in rows]


def test_dates(spark):
    cases = [
        ("Date 03/04/2024", "2024-04-03", ["2024-03-04"]),  # day first, then month first
        ("Date 25/12/2024", "2024-12-25", ["2024-12-25"]),
        ("Date 12/25/2024", "2024-12-25", ["2024-12-25"]),
        ("25-12-2024", "2024-12-25", ["2024-12-25"]),
        ("2024-02-30", "2024-02-30", []),  # no such day: as written, and in no list
        ("12/25/24", "12/25/24", ["2024-12-25"]),  # two digits: only in the list
        ("12/25/71", "12/25/71", ["1971-12-25"]),
        ("1/2/68 and 1/2/69", "1/2/68", ["2068-01-02", "1969-01-02"]),
        ("14 Nov 2025", "2025-11-14", []),  # a list reads the first word alone
        ("14\nNov\n2025", "2025-11-14", ["2025-11-14"]),  # no space: read whole
        ("Nov 14, 2025", "2025-11-14", []),
        ("november 14 2025", "2025-11-14", []),
        ("Nov. 14, 2025", "Nov. 14, 2025", []),
        ("12/25/2024 4:05 PM", "12/25/2024 4:05 PM", ["2024-12-25"]),  # the time's pattern goes before the plain one
        ("2024/12/25", "2024/12/25", []),
        ("25.12.2024", None, []),  # no pattern finds it
        ("1996-01-02 then 05/03/1997", "1997-03-05", ["1997-05-03", "1996-01-02"]),  # by pattern, not by place
        ("#9-4-82 Nanal", None, []), ("#  9-4-82", None, []), ("#   9-4-82", "9-4-82", []), ("No.9-4-82", None, []), ("No. 9-4-82", "9-4-82", []),
        ("9-4-82 Nanal Nagar", "9-4-82", []), ("9-4-82, Nagar", None, []), ("9-4-82\n  MAIN st", None, []), ("9-4-82,  road", "9-4-82", []),
        ("9-4-82" + " " * 24 + "street", None, []), ("9-4-82" + " " * 25 + "street", "9-4-82", []),
        ("9/4/2020 Road 1/2/2021", "2021-02-01", ["2021-01-02"]),
        ("9/4/2020 9/4/2020", "2020-04-09", ["2020-09-04"]),
        ("19/4/20201", None, []), ("x9/4/2020", None, []), ("é9/4/2020", None, []), ("", None, []), (None, None, []),
    ]
    found = scan(spark, *(text for text, _, _ in cases))
    assert [(text, *row[:2]) for (text, _, _), row in zip(cases, found, strict=True)] == cases


def test_a_hidden_match_uses_its_characters_up(spark):
    # 1-2-03 is hidden; 2-03-4 within it must not come up in its place
    assert scan(spark, "#1-2-03-4-20")[0][:2] == (None, [])


def test_times(spark):
    cases = [("at 4:05 PM", "16:05"), ("12:00am", "00:00"), ("12:30 PM", "12:30"), ("14:30 then 4:05 pm", "16:05"), ("99:99", "99:99"), ("9:5", None), ("123:45", None), ("7:08", "07:08"), (None, None)]
    assert [row[2] for row in scan(spark, *(text for text, _ in cases))] == [time for _, time in cases]


def test_long_texts_are_read_to_their_end(spark):
    text = "word " * 200_000 + "paid 25/12/2024 at 4:05 PM"
    assert scan(spark, text) == [("2024-12-25", ["2024-12-25"], "16:05")]


def test_conflicts(spark):
    docs = spark.createDataFrame(
        [(1, "1/1/2024 2/1/2024", "POS_RETAIL"), (2, "1/1/2024 1/31/2024", "POS_RETAIL"), (3, "1/1/2024 2/1/2024", None), (4, "1/1/2024", "MISC"), (5, None, "MISC")],
        "id long, full_text string, doc_subtype string",
    )
    assert [tuple(r) for r in O.conflicts(O.scanned(docs)).orderBy("id").collect()] == [
        (1, "R_DATE_CONFLICT", 2, 31, "CRITICAL", 35),
        (3, "R_DATE_CONFLICT", 2, 31, "CRITICAL", 25),
    ]
    assert O.conflicts(O.scanned(docs.where("false"))).count() == 0


def test_patterns_read_as_the_standard_library_reads_them(spark):
    """``read`` against ``strptime`` over forms and strings."""
    import datetime
    import itertools

    strings = [f"{a}{s}{b}{s}{c}" for s in "/-. " for a, b, c in itertools.product(("1", "01", "13", "31", "2024", "Feb"), ("2", "12", "30", "Mar", "March"), ("24", "2024", "5", "0000"))]
    strings += ["Feb 3, 2024", "February 3, 2024", "1/ 2/2024", "1/2/2024 4:05 PM", "1/2/24 13:05 PM", "feb 29 2023"]
    forms = sorted(set(D.DAY_FIRST + D.MONTH_FIRST))
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    for row in df.select("s", *(D.read(D.F.col("s"), f).alias(str(i)) for i, f in enumerate(forms))).collect():
        for i, form in enumerate(forms):
            try:
                want = datetime.datetime.strptime(row.s, form).strftime("%Y-%m-%d")
            except ValueError:
                want = None
            assert row[str(i)] == want, (row.s, form)


def test_only_stretches_around_dates_are_read_again(spark):
    texts = ["word " * 1000, "x" * 500 + " 1/2/2024 " + "y" * 500, "1/2/2024" + " " * 33 + "3/4/2024", None]
    near = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").orderBy("i").select(D.near(D.F.col("t"))).collect()]
    assert near[0] == "_" and near[3] is None
    assert "1/2/2024" in near[1] and len(near[1]) < 60
    assert near[2].endswith(texts[2])  # one stretch, so nothing between them is lost
