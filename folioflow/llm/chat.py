"""Chat formatting from event logs, in DataFrame functions alone.

A log is a table of events: conv_id, seq, kind, turn, role, text.  Kinds:

* message     starts a turn's text (again, if the turn had one);
* delta       appends a streamed piece to the turn's text;
* edit        replaces the turn's text in place;
* regenerate  drops what the turn had and every later turn begun before, then starts it anew.

Events of other kinds say nothing about a text and are left out.

Events are partitioned by conversation and ordered by seq.  One pass of windows finds, for every
event, whether a later one undoes it; what remains of a turn is joined in order, and turns are
rendered with a template.

The template marks turns as <|im_start|>role NEWLINE text <|im_end|> NEWLINE.  Inside roles and texts
`\\` is doubled and every `<` or `[` gets a `\\` behind it, so no control string (</s>, [INST],
<|im_end|>, ...) can occur there; reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("message", "delta", "edit", "regenerate")
START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\|\\(\\)", "$1$2")


def _role(role: Column) -> Column:
    """In an escaped role a line feed is `<n`; elsewhere `<` always has a backslash behind it."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<n"))


def _read_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<n"), F.lit("\n")))


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, role, text, from an event log.

    Ties in seq are ordered by kind, role and text.  Nulls: a null text is empty, a null role is the
    empty role, a null kind counts as message, a null conv_id is a conversation of its own, null seq
    and turn come first.  A turn whose every event was undone disappears.  A turn's role is that of
    its last event with a role.  Events of unknown kinds are ignored, repeated events all count.  No
    events: no rows.
    """
    e = events.select(
        "conv_id", "seq", "turn", F.coalesce("kind", F.lit("message")).alias("kind"), F.col("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    e = e.where(F.col("kind").isin(*KINDS))
    order = [F.col("seq").asc_nulls_first(), F.col("turn").asc_nulls_first(), "kind", "role", "text"]
    e = e.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    later = Window.partitionBy("conv_id").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63)))
    e = e.withColumn("redone", F.min(F.when(F.col("kind") == "regenerate", turn)).over(later))
    e = e.where(F.col("redone").isNull() | (F.col("redone") > turn))
    per_turn = Window.partitionBy("conv_id", "turn")
    e = e.withColumn("begun", F.max(F.when(F.col("kind") != "delta", F.col("at"))).over(per_turn))
    piece = F.when(F.col("begun").isNull() | (F.col("at") >= F.col("begun")), F.struct("at", "text"))
    return e.groupBy("conv_id", "turn").agg(
        F.coalesce(F.max_by("role", F.when(F.col("role").isNotNull(), F.col("at"))), F.lit("")).alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss: one row per conversation, turns in order.

    loss is the mask of the assistant's texts: (turn index in the output, first, last + 1), code points
    within that rendered turn, so a long conversation is read turn by turn.  A null role or text is
    empty, a null turn comes first, ties are ordered by role and text; no messages: no rows.
    """
    messages = messages.withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"), "role", "text")))
    conv = messages.groupBy("conv_id").agg(ordered.alias("m"))
    parts = conv.select(
        "conv_id",
        F.transform("m", lambda x: F.struct((x["role"] == "assistant").alias("learn"), F.concat(F.lit(START), _role(x["role"]), F.lit("\n")).alias("head"), escape(x["text"]).alias("body"))).alias("p"),
    )
    spans = F.transform("p", lambda x, i: F.when(x["learn"], F.struct(i.alias("turn"), F.length(x["head"]).alias("first"), (F.length(x["head"]) + F.length(x["body"])).alias("last"))))
    return parts.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        F.filter(spans, lambda x: x.isNotNull()).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text) and learnt (texts under the loss mask), from render()'s output.

    An empty conversation has no turns; a null formatted or loss gives nulls.
    """
    pieces = F.split("formatted", r"(?<=<\|im_end\|>\n)")
    pieces = F.filter(pieces, lambda x: x != "")
    cut = formatted.select("conv_id", "formatted", "loss", pieces.alias("pieces"))

    def turn(x: Column) -> Column:
        inner = F.substring(x, len(START) + 1, F.length(x) - len(START) - len(END))
        at = F.instr(inner, F.lit("\n"))
        return F.struct(_read_role(F.substring(inner, F.lit(1), at - 1)).alias("role"), unescape(F.substring(inner, at + 1, F.length(inner))).alias("text"))

    learnt = F.transform("loss", lambda s: unescape(F.substring(F.col("pieces")[s["turn"]], s["first"] + 1, s["last"] - s["first"])))
    return cut.select("conv_id", "formatted", F.transform("pieces", turn).alias("turns"), learnt.alias("learnt"))


def format_chats(events: DataFrame) -> DataFrame:
    """Event log to one rendered string and loss mask per conversation.

    A conversation is one string and so one row; its events are folded to messages before they meet.
    """
    return render(fold(events))
