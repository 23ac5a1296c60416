"""Chat formatting from event logs: fold streamed events into messages, then render, in DataFrame code.

A log has one row an event: conv_id, turn, message (groups a message's events), seq (order in
the message), kind, role, text. ``start``, ``edit`` and ``regenerate`` set a message's text anew,
``delta`` adds to it; so a message is what follows its last setting event, in order.

Template: each turn is ``<turn ROLE>TEXT</turn>`` and a newline. Inside roles and texts a backslash
becomes ``\\b``, ``<`` becomes ``\\l`` and ``>`` becomes ``\\g``; no control string can then occur in
them, and undoing the three (backslash last) gives back the exact text. The loss mask lists the
code-point spans of the assistants' texts in the formatted string.

Plan: events are grouped by message (small groups, however long a conversation is), then messages
by conversation; offsets and the final fold share that second shuffle. A conversation is one
string of the result, so its messages have to meet in one task at the end.

Defined results: null texts and null roles read as empty; rows of one turn are ordered by role, then
text, and repeated rows stay repeated; a null turn comes first; null conv_ids form one conversation;
an empty table gives no rows; other columns are not looked at.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSISTANT = "assistant"
DELTA_CHARS = 200
OPEN, MIDDLE, CLOSE = "<turn ", ">", "</turn>\n"
TURN = r"<turn ([^<>]*)>([^<>]*)</turn>\n"


def escape(text: Column) -> Column:
    for plain, coded in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in (("<", "\\l"), (">", "\\g"), ("\\", "\\b")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def as_events(conversations: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """The event log of finished conversations (conv_id, turn, role, text), as a chat service would
    have written it: assistants stream their texts in deltas, and about a third of their messages
    were begun once before and regenerated; about a third of the others were edited."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")) \
        .withColumn("message", F.monotonically_increasing_id())
    def said(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    whole, nothing = F.col("text"), F.lit("")
    again = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)) == 0
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(delta_chars))
    deltas = F.transform(starts, lambda i: said("delta", F.substring("text", i, F.lit(delta_chars))))
    stream = F.concat(F.array(said("start", nothing)), deltas)
    refused = F.array(said("start", nothing), said("delta", F.substring("text", F.lit(3), F.lit(40))), said("regenerate", nothing))
    typed = F.array(said("start", whole))
    edited = F.array(said("start", F.substring("text", F.lit(2), F.lit(60))), said("delta", F.lit(" draft")), said("edit", whole))
    events = F.when(F.col("role") == ASSISTANT, F.when(again, F.concat(refused, deltas)).otherwise(stream)) \
        .otherwise(F.when(again, edited).otherwise(typed))
    return rows.select("conv_id", "turn", "message", "role", F.posexplode(events).alias("seq", "event")) \
        .select("conv_id", "turn", "message", "seq", "event.kind", "role", "event.text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, role, text."""
    log = F.sort_array(F.collect_list(F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"))))
    last = F.coalesce(F.array_max(F.transform(F.filter("log", lambda e: e["kind"] != "delta"), lambda e: e["seq"])), F.lit(-1))
    text = F.array_join(F.transform(F.filter("log", lambda e: e["seq"] >= F.col("last")), lambda e: e["text"]), "")
    return events.groupBy("conv_id", "turn", "message").agg(log.alias("log"), F.max("role").alias("role")) \
        .withColumn("last", last).select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask (array of start, length in code points from 0)."""
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    pieces = messages.withColumns({"head": head, "body": escape(F.col("text"))}) \
        .withColumn("piece", F.concat("head", "body", F.lit(CLOSE))) \
        .withColumn("at", F.coalesce(F.sum(F.length("piece")).over(order), F.lit(0)))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == ASSISTANT), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "at", (F.col("at") + F.length("head")).alias("start"), F.length("body").alias("length"), "role", "piece"))).alias("turns")) \
        .select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_mask"))


def read_back(rendered: DataFrame) -> DataFrame:
    """What the formatted strings and masks say: conv_id, turns (role, text), loss_text, formatted."""
    roles, texts = (F.regexp_extract_all("formatted", F.lit(TURN), F.lit(k)) for k in (1, 2))
    turns = F.zip_with(roles, texts, lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text")))
    loss = F.transform("loss_mask", lambda m: unescape(F.substring("formatted", (m["start"] + 1).cast("int"), m["length"])))
    return rendered.select("conv_id", "formatted", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"))


def digest(read: DataFrame) -> DataFrame:
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
