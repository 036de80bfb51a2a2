"""Chat formatting by event-sourced reconstruction, in DataFrame functions alone.

A log of events is partitioned by conversation and, within it, by the turn that
an event addresses; sorted by sequence it folds into the turn's final messages.
What reaches across turns is the sequence: a regeneration voids all that later
turns had said before it. Messages are rendered one by one, joined in bounded
chunks and the chunks joined to a conversation, so no task but the one that
holds the finished row meets a whole conversation.

Rendered, a message is ``<|turn|>role\\ntext<|end|>\\n``. Control strings inside
roles and texts get a backslash after their first character and backslashes are
doubled, so ``<|end|>`` can only be the template's own and dropping each
escaping backslash restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let

TURN, END = "<|turn|>", "<|end|>\n"
#: Turns joined at once before the conversation is, and turns that one window of sequence numbers spans.
CHUNK_TURNS, CUT_TURNS = 64, 4096

# What an event does to its turn.
MESSAGE, DELTA, EDIT, REGENERATE = "message", "delta", "edit", "regenerate"

#: Where an escaping backslash goes: in "<|", in "<s>", "</s>", "[INST]", "[/INST]".
_CONTROL = r"(<)(?=\||/?s>)|(\[)(?=/?INST\])"


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, _CONTROL, r"$1$2\\")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), "\n", "\\\\\n")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def streamed(rows: DataFrame) -> DataFrame:
    """The log by which ``rows`` (``conv_id``, ``turn``, ``role``, ``text``) could have come about.

    Turns take three forms, by number: a text streamed in thirds; a draft that
    is edited to the text's first half, the rest streamed; a false start that
    is answered in the next turn, then regenerated and streamed in halves.
    Each row is a message of its own; ``seq`` is its turn and the event's
    number. Null turns take the first form.
    """
    n, form = F.length(F.coalesce("text", F.lit(""))), F.coalesce(F.pmod("turn", F.lit(3)), F.lit(0))
    after = F.try_add("turn", F.lit(1).cast("long"))

    def event(k: int, kind: str, start: Column, length: Column, *, ahead: bool = False) -> Column:
        return F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), start.cast("int").alias("start"), length.cast("int").alias("length"), F.lit(ahead).alias("ahead"))

    one, third, half = F.lit(1), F.floor(n / 3), F.floor(n / 2)
    thirds = F.array(event(0, MESSAGE, one, third), event(1, DELTA, third + 1, third), event(2, DELTA, 2 * third + 1, n))
    edited = F.array(event(0, MESSAGE, half + 1, n), event(1, EDIT, one, half), event(2, DELTA, half + 1, n))
    again = F.array(event(0, MESSAGE, half + 1, n), event(1, MESSAGE, one, half, ahead=True), event(2, REGENERATE, one, F.lit(0)), event(3, DELTA, one, half), event(4, DELTA, half + 1, n))
    known = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.monotonically_increasing_id().alias("row"))
    log = known.withColumn("e", F.explode(F.when(form == 0, thirds).when(form == 1, edited).otherwise(again)))
    ahead = F.col("e.ahead")
    return log.where(~ahead | after.isNotNull()).select(
        "conv_id",
        F.when(ahead, after).otherwise(F.col("turn")).alias("turn"),
        F.when(ahead, -1 - F.col("row")).otherwise(F.col("row")).alias("message"),
        F.struct("turn", "e.k").alias("seq"),
        F.col("e.kind").alias("kind"),
        "role",
        F.substring("text", F.col("e.start"), F.col("e.length")).alias("text"),
    )


def _voids(log: DataFrame) -> DataFrame:
    """For each ``at`` (conversation and turn) the last sequence number at which an earlier turn was regenerated, or null.

    A running maximum over turns, in two steps: within ``CUT_TURNS`` turns, and
    over the maxima of those.
    """
    turns = log.groupBy("at").agg(F.max(F.when(F.col("kind") == REGENERATE, F.col("seq"))).alias("own"))
    turns = turns.select("at", "own", F.struct(F.col("at.conv_id").alias("conv_id"), F.floor(F.col("at.turn") / CUT_TURNS).alias("chunk")).alias("part"))
    parts = turns.groupBy("part").agg(F.max("own").alias("most"))
    over = W.partitionBy("part.conv_id").orderBy(F.col("part.chunk").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.max("most").over(over).alias("before"))
    inside = W.partitionBy("part").orderBy(F.col("at.turn").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    turns = turns.withColumn("inner", F.max("own").over(inside))
    return turns.join(parts, "part").select("at", F.greatest("inner", "before").alias("void"))


def fold(events: DataFrame) -> DataFrame:
    """The final messages, a row each: ``conv_id``, ``turn``, ``seq`` (of its first event), ``role``, ``text``.

    Events have ``conv_id``, ``turn``, ``seq`` (a number, or a struct of
    them), ``kind``, ``role``, ``text`` and, where a turn holds several, may
    name their ``message``. A message's events are folded in the order of seq,
    role, kind, text (nulls first): ``message`` starts a message; ``delta``
    appends to it, or starts one where there is none or the role is not that
    of the event before; ``edit`` replaces the text; ``regenerate`` empties it,
    for the deltas that follow, and voids all events of later turns with a
    smaller seq. An edit of nothing is a message, a regenerate of nothing
    does nothing. Other and null kinds count as messages, null roles and texts
    as empty; a null seq comes first and is never void.
    """
    empty = F.lit("")
    log = events.select(
        F.struct(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")).alias("at"),
        (events["message"] if "message" in events.columns else F.lit(None).cast("long")).alias("message"),
        "seq", F.coalesce("role", empty).alias("role"), F.coalesce("kind", F.lit(MESSAGE)).alias("kind"), F.coalesce("text", empty).alias("text"),
    )
    live = log.join(_voids(log), "at").where(~F.coalesce(F.col("seq") < F.col("void"), F.lit(False)))
    grouped = live.groupBy("at", "message").agg(F.sort_array(F.collect_list(F.struct("seq", "role", "kind", "text"))).alias("log"))

    def starts(e: Column, i: Column, log: Column) -> Column:
        follows = e["kind"].isin(EDIT, REGENERATE) | ((e["kind"] == DELTA) & (e["role"] == F.get(log, i - 1)["role"]))
        return (i == 0) | ~F.coalesce(follows, F.lit(False))

    def cut(log: Column) -> Column:
        """Where messages start: positions from 1, and the end."""
        at = F.filter(F.transform(log, lambda e, i: F.when(starts(e, i, log), i + 1)), lambda i: i.isNotNull())
        return F.concat(at, F.array(F.size(log) + 1))

    def message(part: Column) -> Column:
        base = F.array_max(F.transform(part, lambda e, i: F.when(e["kind"] != DELTA, i)))
        tail = F.filter(part, lambda e, i: (i >= F.coalesce(base, F.lit(0))) & (e["kind"] != REGENERATE))
        text = F.array_join(F.transform(tail, lambda e: e["text"]), "")
        return F.when(F.exists(part, lambda e: e["kind"] != REGENERATE), F.struct(part[0]["seq"].alias("seq"), part[0]["role"].alias("role"), text.alias("text")))

    def messages(log: Column) -> Column:
        return let(cut(log), lambda at: F.transform(F.sequence(F.lit(0), F.size(at) - 2), lambda k: let(F.slice(log, at[k], at[k + 1] - at[k]), message)))

    folded = grouped.select("at.conv_id", "at.turn", F.explode(F.array_compact(let(F.col("log"), messages))).alias("m"))
    return folded.select("conv_id", "turn", "m.seq", "m.role", "m.text")


def render(messages: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """One row for each conversation: ``conv_id``, ``formatted``.

    ``messages`` is what ``fold`` returns. They are joined by turn, seq, role
    and text, nulls first, in chunks of ``chunk_turns`` turns and then whole.
    """
    own = messages.select("conv_id", F.floor(F.col("turn") / chunk_turns).alias("chunk"), F.struct("turn", "seq", "role", "text").alias("m"))
    parts = own.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    written = F.transform("ms", lambda m: F.concat(F.lit(TURN), escape_role(m["role"]), F.lit("\n"), escape(m["text"]), F.lit(END)))
    parts = parts.select("conv_id", F.struct("chunk", F.array_join(written, "").alias("part")).alias("p"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    return whole.select("conv_id", F.array_join(F.transform("ps", lambda p: p["part"]), "").alias("formatted"))


def parse(formatted: Column) -> Column:
    """The messages that a rendered conversation holds, as ``array<struct<role, text>>``."""
    body = F.split(formatted, r"<\|end\|>\n", -1)
    header = r"^<\|turn\|>([^\\\n]*+(?:\\[\s\S][^\\\n]*+)*+)\n"

    def message(part: Column) -> Column:
        role = F.regexp_extract(part, header, 1)
        at = F.length(role) + len(TURN) + 2
        return F.struct(unescape(role).alias("role"), unescape(F.substring(part, at, F.length(part))).alias("text"))

    return let(body, lambda parts: F.transform(F.slice(parts, 1, F.size(parts) - 1), message))


def format_conversations(events: DataFrame, **options) -> DataFrame:
    """``conv_id``, ``formatted`` and ``messages`` as read back from the output.

    Training loss is on assistant texts: in the output, what stands between the
    newline after ``<|turn|>assistant`` and ``<|end|>``.

    A null conv_id is a conversation of its own and null turns come first;
    messages of one turn follow one another in the order of ``render``.
    Repeated message events are repeated messages. Extra columns are ignored
    (``message`` is one of the log's own); an empty table, and a conversation
    of which nothing is left, give no rows. A text of any length is one text.
    """
    rendered = render(fold(events), **options)
    return rendered.withColumn("messages", parse(F.col("formatted")))


def digests(formatted: DataFrame) -> DataFrame:
    """Figures of formatted conversations, all from what was read back."""
    turns = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: m["text"]), "")
    return formatted.select(
        "conv_id",
        F.size("messages").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
