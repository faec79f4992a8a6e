"""Chat formatting by event-sourced reconstruction, in DataFrame functions alone.

A log holds events of messages: ``message`` opens one with a text, ``delta`` appends, ``edit``
replaces the text, ``regenerate`` begins it anew. The log is partitioned by conversation, once; within a
partition each message's events are sorted by sequence and folded to the final text, and a
conversation's messages are ordered and rendered.

Template: ``### role: text </turn>`` and a line feed for each turn. The role is URL-encoded. In
texts a backslash goes before each backslash, ``#`` and ``<``, so no text can hold
a turn's marks, and dropping it gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut, running

OPEN, COLON, CLOSE = "### ", ": ", " </turn>\n"
RESETS = ("message", "edit", "regenerate")


def escaped(text: Column) -> Column:
    for c in ("\\", "#", "<"):
        text = F.replace(text, F.lit(c), F.lit("\\" + c))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message_id, place, role, text) of events (conv_id, message_id, seq, op, role, text).

    Events of one message are taken by seq, null first, then op, role and text. The text is that of
    the last message, edit or regenerate event and of all deltas after it; null counts as
    empty. The role is the first that is not null; place is the smallest seq. The result lies partitioned by
    conv_id: what groups it by that needs no further shuffle.
    """
    log = events.select("conv_id", "message_id", "seq", "op", "role", "text").repartition("conv_id")
    grouped = log.groupBy("conv_id", "message_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "op", "role", "text"))).alias("log"), F.min("seq").alias("place")
    )
    n = F.size("log")
    last = n - F.array_position(F.transform(F.reverse("log"), lambda e: F.coalesce(e["op"].isin(*RESETS), F.lit(False))), True).cast("int") + 1
    kept = F.slice("log", F.when(last > n, F.lit(1)).otherwise(last), n)
    return grouped.select(
        "conv_id",
        "message_id",
        "place",
        F.get(F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull()), F.lit(0)).alias("role"),
        F.array_join(F.transform(kept, lambda e: F.coalesce(e["text"], F.lit(""))), "").alias("text"),
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) of messages (conv_id, place, role, text).

    Turns stand by place, null first, then role and text. loss_spans are the ranges [start, end) of
    code points in formatted that hold the (escaped) texts of ``loss_role``. A null role is empty.
    """
    turns = messages.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("place", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns")
    )
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(OPEN), F.url_encode(t["role"]), F.lit(COLON)).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == loss_role).alias("loss")
        ),
    )
    turns = turns.select("conv_id", parts.alias("parts"))
    long = F.transform("parts", lambda p: F.char_length(p["head"]) + F.char_length(p["body"]) + len(CLOSE))

    def span(p, after):
        end = after - len(CLOSE)
        return F.when(p["loss"], F.struct((end - F.char_length(p["body"])).alias("start"), end.alias("end")))

    spans = F.filter(F.zip_with("parts", running(long, lambda a, x: a + x), span), lambda x: x.isNotNull())
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    return turns.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation."""
    turns = F.split(formatted, CLOSE)
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)  # after the last mark nothing is left
    return F.transform(
        turns,
        lambda t: F.struct(
            F.url_decode(F.substring(F.substring_index(t, COLON, 1), F.lit(len(OPEN) + 1), F.char_length(t))).alias("role"),
            unescaped(F.substring(t, F.char_length(F.substring_index(t, COLON, 1)) + len(COLON) + 1, F.char_length(t))).alias("text"),
        ),
    )


def masked_text(formatted: Column, loss_spans: Column) -> Column:
    """The texts under the loss mask of a rendered conversation, as they were before rendering, one after another."""
    return F.array_join(F.transform(cut(formatted, loss_spans), unescaped), "")


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Rendered conversations (conv_id, formatted, loss_spans) of an event log.

    The log has conv_id, message_id, seq, op, role and text; other columns are not looked at. Events
    with a null conv_id make up one conversation. An empty log gives an empty result.
    """
    return render(fold_events(events), loss_role)


def events_of_turns(turns: DataFrame) -> DataFrame:
    """Whole messages (conv_id, turn, role, text) as a log; each row is a message, repeated ones too."""
    return turns.select(
        "conv_id",
        F.monotonically_increasing_id().alias("message_id"),  # names the row alone; no result has it or is ordered by it
        F.col("turn").cast("long").alias("seq"),
        F.lit("message").alias("op"),
        "role",
        "text",
    )
