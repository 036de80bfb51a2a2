"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors in a text: at-signs, schemes, a
plus or a dot before a digit, pairs of digits with or without a separator, and
cues of identifiers such as "iban" or "passport". A deterministic parser for
each kind then expands an anchor to both sides and validates what it found.
The parsers of the base kinds return what the leftmost, non-overlapping matches
of these patterns are:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, each part at most 255
* card ``[0-9]([\\x20-]?[0-9])+``, 16 to 19 digits that pass Luhn
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]``, 8 to 15 digits

Matches that fail their test are dropped and not tried again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import numbered

BASE_KINDS = ("email", "ip", "card", "phone")
#: The kinds that the method adds: a credential in an address, an account
#: number after a cue, and an international bank account number.
MORE_KINDS = ("login", "account", "iban")
KINDS = BASE_KINDS + MORE_KINDS

# Cues that name an identifier, and the schemes whose addresses can hold a login.
CUES = (
    "account", "acct", "compte", "cuenta", "iban", "konto", "kontonummer", "nif", "passport",
    "passeport", "pasaporte", "reisepass", "routing", "social security", "ssn", "steuernummer",
)
SCHEMES = ("ftp://", "http://", "https://", "mysql://", "postgres://", "sftp://", "ssh://")

_DIGITS = frozenset("0123456789")
_LABEL = _DIGITS | frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ-")
_LOCAL = _LABEL | frozenset("._%+")
_PHONE = _DIGITS | frozenset(" ().-")
_ALNUM = _LABEL - {"-"}
_URL_END = frozenset(" \t\n\r\x0b\x0c\"'<>()[]{}")
#: Longest distance between a cue and its number: over any words, and over words that name a number.
CUE_GAP, LABEL_GAP = 12, 32
#: Words that name a number that follows.
LABEL_WORDS = frozenset("number no nr num id code is ending ends in with my your the new".split())
_ACCOUNT_LEAST, _ACCOUNT_MOST = 6, 34
_DATE = re.compile(r"(?:(?:19|20)\d\d([-/. ])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/. ])(?:0?[1-9]|[12]\d|3[01])\2(?:19|20)\d\d|(?:19|20)\d\d[-/](?:19|20)\d\d)")

Span = tuple[str, int, int]


def anchors():
    """The automaton: anchor string to the parser that it starts."""
    import ahocorasick

    found = ahocorasick.Automaton()
    words = {"@": "email"}
    for d in sorted(_DIGITS):
        words["+" + d] = "phone"
        words["." + d] = "ip"
        for e in sorted(_DIGITS):
            for sep in ("", " ", "-"):
                words[d + sep + e] = "card"
    words |= {x: "login" for x in SCHEMES} | {x: "cue" for x in CUES}
    for word, kind in words.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _email(text: str, at: int, free: int) -> tuple[Span | None, int]:
    """The address around the at-sign at ``at``; ``free``: where the last match of the kind ends."""
    start = at
    while start > free and text[start - 1] in _LOCAL:
        start -= 1
    end, n, last = at + 1, len(text), -1
    if start == at:
        return None, free
    while True:
        label = end
        while end < n and text[end] in _LABEL:
            end += 1
        if end == label:
            break
        if label > at + 1:
            last = end
        if end + 1 < n and text[end] == "." and text[end + 1] in _LABEL:
            end += 1
        else:
            break
    return (("email", start, last), last) if last > 0 else (None, free)


def _ips(text: str, dot: int, free: int) -> tuple[list[Span], int]:
    """All addresses in the chain of numbers and single dots around the dot at ``dot``."""
    start, n = dot, len(text)
    while start > free and (text[start - 1] in _DIGITS or text[start - 1] == "." and start - 2 >= free and text[start - 2] in _DIGITS):
        start -= 1
    if start == dot:  # no number before it
        start += 1
    runs, at = [], start
    while at < n and text[at] in _DIGITS:
        end = at
        while end < n and text[end] in _DIGITS:
            end += 1
        runs.append((at, end))
        if not (end + 1 < n and text[end] == "." and text[end + 1] in _DIGITS):
            break
        at = end + 1
    spans = []
    for k in range(0, len(runs) - 3, 4):
        four = runs[k : k + 4]
        if all(len(x := text[a:b].lstrip("0")) <= 3 and int(x or "0") <= 255 for a, b in four):
            spans.append(("ip", four[0][0], four[3][1]))
    return spans, runs[-1][1] if runs else free


def _card(text: str, at: int, free: int) -> tuple[Span | None, int]:
    """The run of digits with single separators that starts at ``at``."""
    n, end = len(text), at + 1
    while end < n:
        if text[end] in _DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in _DIGITS:
            end += 2
        else:
            break
    digits = text[at:end].replace(" ", "").replace("-", "") if end - at <= 37 else ""
    return (("card", at, end) if 16 <= len(digits) <= 19 and luhn(digits) else None), end


def _phone(text: str, at: int) -> tuple[Span | None, int]:
    """The number that the plus at ``at`` begins."""
    n, end = len(text), at + 2
    while end < n and text[end] in _PHONE:
        end += 1
    while end > at + 2 and text[end - 1] not in _DIGITS:
        end -= 1
    if end < at + 4:
        return None, at
    digits = sum(c in _DIGITS for c in text[at:end])
    return (("phone", at, end) if 8 <= digits <= 15 else None), end


def _login(text: str, after: int, begin: int) -> Span | None:
    """``user:password@host`` of an address whose scheme ends at ``after``."""
    end, n, at = after, len(text), -1
    while end < n and text[end] not in _URL_END and text[end] not in "/?#":
        if text[end] == "@":
            at = end
        end += 1
    return ("login", begin, end) if at > 0 and ":" in text[after:at] and end > at + 1 else None


def _iban(text: str, at: int) -> Span | None:
    """An account number with two letters, two check digits and groups, tested modulo 97."""
    if not (text[at : at + 2].isascii() and text[at : at + 2].isalpha() and text[at + 2 : at + 4].isascii() and text[at + 2 : at + 4].isdigit()):
        return None
    chars, end = [], at
    while end < len(text) and len(chars) < 34:
        if text[end] in _ALNUM:
            chars.append(text[end])
        elif not (text[end] == " " and end + 1 < len(text) and text[end + 1] in _ALNUM):
            break
        end += 1
    while len(chars) >= 15:
        code = "".join(chars[4:] + chars[:4]).upper()
        if int("".join(str(int(c, 36)) for c in code)) % 97 == 1:
            return ("iban", at, end)
        end -= 1
        while text[end - 1] == " ":
            end -= 1
        chars.pop()
    return None


def _groups(text: str, at: int, end: int) -> int:
    """Where the number whose first group is ``at`` to ``end`` ends, with the groups of digits that follow a single space, dot or slash.

    Two digits or fewer after a number's only dot are an amount's cents and no
    group; of a number over ``_ACCOUNT_MOST`` the first groups that fit count.
    """
    ends, seps = [end], ""
    while text[end : end + 1] in (" ", ".", "/") and end + 1 < len(text) and text[end + 1] in _DIGITS:
        seps += text[end]
        end += 1
        while end < len(text) and text[end] in _LABEL and end - at <= _ACCOUNT_MOST:
            end += 1
        last = end
        while text[last - 1] == "-":
            last -= 1
        if last - at > _ACCOUNT_MOST or not all(c in _DIGITS or c == "-" for c in text[ends[-1] + 1 : last]):
            seps = seps[:-1]
            break
        ends.append(last)
        if last < end:
            break
    if seps == "." and ends[1] - ends[0] <= 3:
        return ends[0]
    return ends[-1]


def _account(text: str, cue_at: int, cue_end: int) -> Span | None:
    """The number that follows a cue: at least four digits among letters, digits, hyphens and separated groups of digits.

    Words without digits between the cue and it, such as "Number" or "No.", are
    passed over; the number is the first word that holds a digit. It lies within
    ``CUE_GAP`` characters of the cue, or ``LABEL_GAP`` if only ``LABEL_WORDS``
    come between. A date and a pair of years are no numbers.
    """
    if cue_at and text[cue_at - 1].isalnum() or cue_end < len(text) and text[cue_end].isalnum():
        return None
    end, gap = cue_end, LABEL_GAP
    while True:
        at = end
        while at < len(text) and at - cue_end <= gap and text[at] not in _ALNUM:
            at += 1
        if at >= len(text) or at - cue_end > gap:
            return None
        if span := _iban(text, at):
            return span
        end = at
        while end < len(text) and text[end] in _LABEL and end - at <= _ACCOUNT_MOST + CUE_GAP:
            end += 1
        if any(c in _DIGITS for c in text[at:end]):
            break
        if text[at:end].lower() not in LABEL_WORDS:
            gap = CUE_GAP
    last = end
    while text[last - 1] == "-":
        last -= 1
    if last == end:
        last = _groups(text, at, end)
    digits = sum(c in _DIGITS for c in text[at:last])
    if _DATE.fullmatch(text, at, last):
        return None
    return ("account", at, last) if _ACCOUNT_LEAST <= last - at <= _ACCOUNT_MOST and digits >= 4 else None


def find(text: str, automaton) -> list[Span]:
    """All spans (kind, start, end) in code points, by kind as in ``KINDS``, then start."""
    lower = text.lower()
    if len(lower) != len(text):  # a letter that grows in lower case would move the spans
        lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    spans: list[Span] = []
    free = dict.fromkeys(KINDS, 0)
    for last, (kind, length) in automaton.iter(lower):
        at, end = last - length + 1, last + 1
        span = None
        if kind == "email":
            span, free[kind] = _email(text, at, free[kind])
        elif kind == "ip" and at >= free[kind]:
            found, free[kind] = _ips(text, at, free[kind])
            spans += found
        elif kind == "card" and at >= free[kind]:
            span, free[kind] = _card(text, at, free[kind])
        elif kind == "phone" and at >= free[kind]:
            span, free[kind] = _phone(text, at)
        elif kind == "login" and at >= free[kind]:
            if span := _login(text, end, at):
                free[kind] = span[2]
        elif kind == "cue":
            span = _account(text, at, end)
            if span and span[1] < free[span[0]]:
                span = None
            elif span:
                free[span[0]] = span[2]
        if span:
            spans.append(span)
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(spans), key=lambda s: (order[s[0]], s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; where spans overlap, by that of the first, longest one."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPAN_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_pii(docs: DataFrame) -> DataFrame:
    """One row for each document: counts of the base kinds, their digest and all spans.

    Null texts count as empty: no spans, and the digest of the empty string.
    A null ``doc_id`` stays null; repeated rows give repeated rows; extra
    columns are ignored. Whole texts are read, in one pass and no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for value in batch.column(1):
                spans = find(value.as_py() or "", automaton)
                base = [s for s in spans if s[0] in BASE_KINDS]
                for c, k in zip(cols, BASE_KINDS, strict=False):
                    c.append(sum(s[0] == k for s in base))
                cols[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols[5].append(joined(spans))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in SPAN_SCHEMA.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SPAN_SCHEMA)


def redact_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind and ``n_chars`` counted anew.

    All documents and columns stay, whatever their names and whatever is null
    in them; null texts stay null, empty ones empty; repeated rows are changed
    alike; an empty table stays empty; texts of any length are read whole.
    """
    at, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for batch in batches:
            texts = []
            for value in batch.column(at):
                text = value.as_py()
                spans = find(text, automaton) if text else []
                texts.append(redact(text, spans) if spans else text)
            cols = list(batch.columns)
            cols[at] = pa.array(texts, pa.string())
            if chars >= 0:
                cols[chars] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    plain = numbered(docs)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
