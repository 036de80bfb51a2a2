"""Folding against a plain loop, rendering by exact round trip."""

import random

from pyspark.sql import functions as F

from tallyguard.llm import chat

EVENTS = "conv_id long, turn long, message long, seq long, kind string, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", "<|end|>\n", "a\\<|turn|>user\n", "\\", "\\\\<\\|", "", "<|<||>|", "[INST][/INST]<s>", "é\n\n</s>\\"]


def messages(spark, events, **options):
    rows = chat.format_conversations(spark.createDataFrame(events, EVENTS), **options).collect()
    return {r.conv_id: [(m.role, m.text) for m in r.messages] for r in rows}, {r.conv_id: r.formatted for r in rows}


def low(x):
    """Nulls first."""
    return (x is not None, x if x is not None else 0)


def brute(events):
    """The log read in sequence, a turn's messages kept in a list."""
    done, out = {}, {}
    for conv, turn, message, seq, kind, role, text in events:
        later = [e[3] for e in events if e[0] == conv and low(e[1]) < low(turn) and e[4] == "regenerate" and e[3] is not None]
        if seq is not None and any(seq < s for s in later):
            continue
        done.setdefault((conv, turn, message), []).append((low(seq), role or "", kind or "message", text or "", seq))
    for (conv, turn, _), log in done.items():
        found, before = [], None
        for order, role, kind, text, _ in sorted(log):
            if not found or kind not in ("edit", "regenerate") and not (kind == "delta" and before == role):
                found.append([order, role, "", False])
            last, before = found[-1], role
            last[2] = "" if kind == "regenerate" else last[2] + text if kind == "delta" else text
            last[3] = last[3] or kind != "regenerate"
        out.setdefault(conv, []).extend((low(turn), order, role, text) for order, role, text, said in found if said)
    return {c: [(m[2], m[3]) for m in sorted(ms)] for c, ms in out.items() if ms}


def test_random_logs(spark):
    rng = random.Random(5)
    for trial in range(4):
        events = [
            (rng.choice([1, 2, None]), rng.choice([None, 0, 1, 2, 3, 70, 5000, 9000]), rng.choice([None, None, 7, 8]), rng.choice([None, *range(12)]), rng.choice(["message", "delta", "delta", "edit", "regenerate", "other", None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bc", "", None, "<|end|>"]))
            for _ in range(40 * (trial + 1))
        ]
        for chunk in (1, 64):
            assert messages(spark, events, chunk_turns=chunk)[0] == brute(events)


def test_control_strings_round_trip(spark):
    events = [(1, i, None, i, "message", role, text) for i, (role, text) in enumerate((r, t) for r in ("user", "assistant", "odd\nrole\\", "<|end|>\n") for t in NASTY)]
    for chunk in (1, 4, 64):
        got, formatted = messages(spark, events, chunk_turns=chunk)
        assert got == {1: [(e[5], e[6]) for e in events]}
        assert formatted[1].count(chat.END) == len(events) and "[INST]" not in formatted[1]


def test_fold(spark):
    events = [
        (1, 0, None, 0, "delta", "user", "Hel"), (1, 0, None, 1, "delta", "user", "lo"),
        (1, 1, None, 5, "delta", "assistant", "wrong"), (1, 1, None, 7, "regenerate", "assistant", None), (1, 1, None, 8, "delta", "assistant", "Hi "), (1, 1, None, 9, "delta", "assistant", "you"),
        (1, 2, None, 6, "message", "user", "to the wrong answer"), (1, 2, None, 10, "message", "user", "draft"), (1, 2, None, 11, "edit", "user", "final"), (1, 2, None, 12, "delta", "user", "!"),
        (1, 3, None, 13, "regenerate", "assistant", None), (1, 4, None, 14, "edit", "user", "alone"), (1, 0, None, 15, "edit", "user", "Hello there"),
        (2, None, None, None, None, None, None), (2, 0, None, 0, "message", "user", "x"), (2, 0, None, 0, "message", "user", "x"),
        (None, 0, None, 0, "message", "user", "y"), (3, 0, None, 1, "regenerate", "user", "z"),
    ]
    got, _ = messages(spark, events)
    assert got[1] == [("user", "Hello there"), ("assistant", "Hi you"), ("user", "final!"), ("user", "alone")]
    assert got[2] == [("", ""), ("user", "x"), ("user", "x")] and got[None] == [("user", "y")] and 3 not in got
    df = spark.createDataFrame(events, EVENTS)
    assert chat.format_conversations(df.limit(0)).count() == 0
    clash = df.withColumns({"messages": F.lit(1), "part": F.lit(2), "void": F.lit(3), "at": F.lit(4), "log": F.lit(5)})
    assert chat.format_conversations(clash).count() == 3
    assert chat.format_conversations(df.drop("message")).count() == 3


def test_streams_restore_their_rows(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", None]), "".join(rng.choice("ab é<|\\") for _ in range(rng.randrange(9)))) for c in (1, 2, None) for t in (None, *range(9), 2**63 - 1, -(2**63))]
    rows += [(1, 2, "user", "same"), (1, 2, "user", "same"), (1, 3, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.streamed(df)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    got = {r.conv_id: [(m.role, m.text) for m in r.messages] for r in chat.format_conversations(log.repartition(5)).collect()}
    for c in (1, 2, None):
        assert got[c] == [m[1:] for m in sorted((low(t), r or "", x or "") for k, t, r, x in rows if k == c)]


def test_very_long_conversation(spark):
    rows = spark.range(30_000).selectExpr("9L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "IF(id = 7, repeat('long ', 400000), concat('text <|', id)) AS text")
    out = chat.digests(chat.format_conversations(chat.streamed(rows))).first()
    words = [("long " * 400_000) if i == 7 else f"text <|{i}" for i in range(1, 30_000, 2)]
    assert out.n_turns == 30_000 and out.loss_chars == sum(map(len, words))
