"""Anchor expansion against the patterns themselves."""

import hashlib
import random
import re

from tallyguard.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(x[-9:]) > 255 or len(x.lstrip("0")) > 3 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def base(text, automaton=pii.anchors()):
    return [s for s in pii.find(text, automaton) if s[0] in pii.BASE_KINDS]


def test_random_texts_match_the_patterns():
    rng = random.Random(7)
    for alphabet in ("12.+@a- ", "0123456789 -.", "a@.b-_é", "+1() .-9x", "4111 -", "12.@+\nİa"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(45)))
            assert base(text) == brute(text), repr(text)


def test_valid_cards_and_long_digit_runs():
    text = "x 4111 1111 1111 1111 y 4111-1111-1111-1111 z " + "1" * 6000 + " 4012888888881881"
    assert base(text) == brute(text)
    assert sum(s[0] == "card" for s in base(text)) == 2


def test_added_kinds_and_redaction():
    text = "see https://joe:secret@host.example/x, IBAN DE89 3704 0044 0532 0130 00; account no. 12345678, a@b.co"
    spans = pii.find(text, pii.anchors())
    assert {s[0] for s in spans} >= {"email", "login", "iban", "account"}
    assert pii.redact(text, spans) == "see <LOGIN>/x, IBAN <IBAN>; account no. <ACCOUNT>, <EMAIL>"
    assert pii.find("", pii.anchors()) == []


def test_labels_and_groups_after_a_cue():
    numbers = {
        "Account Number: {}": "12345678", "Account No. {}": "12345678", "Passport No: {}": "X1234567", "Social Security Number: {}": "123-45-6789",
        "the account number is {}": "12345678", "SSN {}": "123 45 6789", "Steuernummer: {}": "12/345/67890", "account {}": "1234 5678 9012",
        "Konto Nr. {}": "123.456.7890", "passport no. {}": "x1234567", "account no {}": "12345678",
    }
    for form, number in numbers.items():
        for tail in ("", ", and", ". Then 3", " was", " 9th", "\n77"):
            text = form.format(number) + tail
            assert [text[a:b] for k, a, b in pii.find(text, pii.anchors()) if k == "account"] == [number], text
    assert pii.redact("IBAN Number DE89 3704 0044 0532 0130 00.", pii.find("IBAN Number DE89 3704 0044 0532 0130 00.", pii.anchors())) == "IBAN Number <IBAN>."
    row = "account 12345678 " + " ".join(map(str, range(10, 40)))
    assert [(a, row[a:b].startswith("12345678 10"), b - a <= 34) for k, a, b in pii.find(row, pii.anchors()) if k == "account"] == [(8, True, True)]
    for text in ("account balance 12345.50", "Account holder Jane", "account 1234", "Account", "the account of Mr Smith has 12345678"):
        assert pii.find(text, pii.anchors()) == [], text


def test_frames(spark):
    df = spark.createDataFrame([(1, "a@b.co", 6, "x"), (None, None, None, "y"), (1, "", 0, "z")], "doc_id long, text string, n_chars long, spans string")
    rows = pii.find_pii(df).collect()
    assert [(r.doc_id, r.n_email, r.spans) for r in rows] == [(1, 1, "email:0:6"), (None, 0, ""), (1, 0, "")]
    digests = [hashlib.sha256(x).hexdigest() for x in (b"email:0:6", b"", b"")]
    assert [r.base_sha256 for r in rows] == digests
    several = spark.createDataFrame([(1, "+49 30 1234567 é 10.0.0.1 a@b.co 4111 1111 1111 1111 c@d.ef")], "doc_id long, text string")
    assert pii.find_pii(several).first().base_sha256 == hashlib.sha256(b"email:26:32,email:53:59,ip:17:25,card:33:52,phone:0:14").hexdigest()
    long = spark.createDataFrame([(1, "x" * 400_000 + " a@b.co " + "y " * 400_000, "t")], "doc_id long, text string, n_email string")
    assert pii.find_pii(long).first().spans == "email:400001:400007" and pii.redact_pii(long).first().text[400_001:400_008] == "<EMAIL>"
    assert pii.redact_pii(df.limit(0)).count() == 0
    assert [tuple(r) for r in pii.redact_pii(df).collect()] == [(1, "<EMAIL>", 7, "x"), (None, None, None, "y"), (1, "", 0, "z")]
    assert pii.find_pii(df.limit(0)).count() == 0


def test_dates_are_no_accounts():
    automaton = pii.anchors()
    for text in ("account opened 2023-10-12", "account 2024/2025", "Account opened 12.10.2023 here", "konto 2023/10/12"):
        assert not [s for s in pii.find(text, automaton) if s[0] == "account"], text
    for text in ("account number ending in 12345678", "account no. 20231012", "Konto Nr. 1234 5678"):
        assert [s for s in pii.find(text, automaton) if s[0] == "account"], text
    assert not [s for s in pii.find("account of the many people in town 12345678", automaton) if s[0] == "account"]
