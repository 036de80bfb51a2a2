"""Base figures against a plain loop."""

import random
import re
from collections import Counter

from tallyguard.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    again = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            again |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), n < 50 or 100 * len(again) > 50 * n


def test_figures(spark):
    rng = random.Random(3)
    texts = ["", " \n\t", "a", "a a a", "a a a a", "a b c a b c", "x" * 5000, "the end\n" * 60, "é|# ü"]
    for size in (5, 40, 400, 3000):
        for vocabulary in (3, 12, 400):
            words = [f"w{i}" for i in range(vocabulary)] + ["#", "a|b", "é"]
            texts.append("".join(rng.choice(words) + rng.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(size)))
    df = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.judge_quality(df).collect()}
    for i, text in [*enumerate(texts), (None, "")]:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), text[:200]
        assert not (r.kept and r.base_failed)
    assert quality.judge_quality(df.limit(0)).count() == 0


def test_lines(spark):
    prose = "This is a plain sentence with some words, as one would write it."
    text = "\n".join([prose, "All rights reserved", "Home | News | Sport | About", "BUY!! NOW!! CHEAP!! PILLS!!", "", prose])
    row = quality.judge_quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.cleaned == f"{prose}\n\n{prose}"


def test_lines_of_many_scripts(spark):
    """Thirty different words to a line, each line ended by the script's own stop."""
    scripts = {"latin": ("a", "."), "devanagari": ("अ", "।"), "armenian": ("ա", "։"), "amharic": ("አ", "።"), "arabic": ("ا", "۔"), "greek": ("α", "."), "thai": ("ก", "ฯ"), "chinese": ("一", "。")}
    rows = []
    for name, (letter, stop) in scripts.items():
        first = ord(letter)
        lines = [" ".join(f"{chr(first + i % 20)}{chr(first + j % 20)}{chr(first + (i + j) % 20)}" for j in range(30)) + stop for i in range(6)]
        rows.append((name, "\n".join(lines)))
    got = {r.doc_id: r for r in quality.judge_quality(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()}
    assert [n for i, (n, _) in enumerate(rows) if not got[i].kept and not got[i].base_failed] == []


def test_navigation_by_shape(spark):
    prose = "This is a plain sentence with some words, as one would write it."
    menus = ["Start | Nachrichten | Sport", "Home > Garden tools > Rakes", "Inicio · Noticias · Deportes · Contacto", "首页 | 新闻 | 体育"]
    kept = ["Either a | b, he said. Or not.", "one · two", "One or two", "Price | 12.50 each"]
    rows = [(i, f"{prose}\n{t}\n{prose}") for i, t in enumerate(menus + kept)]
    got = {r.doc_id: r.cleaned for r in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] == f"{prose}\n{prose}" for i in range(len(rows))] == [True] * len(menus) + [False] * len(kept)
