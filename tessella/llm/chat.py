"""Operator 8: chat formatting by event-sourced reconstruction (DataFrame functions only).

Input is an event log: conv_id, seq, turn, kind, role, text. Sorted by seq
within a conversation the events fold into final messages:

- `message` starts the turn anew with its role and text;
- `delta` adds its text to the turn;
- `edit` replaces the turn's text;
- `regenerate` starts the turn anew (text, then deltas) and discards what was
  logged before it for later turns.

Template: `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. Inside roles and
texts `\\` becomes `\\\\` and `<|` becomes `<\\|`, so that no control string can
occur there; in roles a line feed becomes `\\n`. Both are undone exactly by
`unescape`. The loss mask is the list of code-point spans of assistant texts.

Cases: null text or role counts as empty; a null seq sorts first, a null kind
counts as `message`. Events of equal seq fold in the order of turn, kind,
text. A turn has the role of its
last message that names one, else its first non-null role. Conversations hold
no rows in an empty table. Extra columns are not looked at. A conversation is
one output text, so its turns meet in one row; turns of a long log are folded
before that, and the log itself is never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import struct

START, END = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def fold_events(events: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: the final messages."""
    e = events.select(
        "conv_id",
        F.coalesce("seq", F.lit(-(2**63))).cast("long").alias("seq"),
        "turn",
        F.coalesce("kind", F.lit("message")).alias("kind"),
        "role",
        F.coalesce("text", F.lit("")).alias("text"),
    )
    later = Window.partitionBy("conv_id").orderBy(F.desc("seq"), F.desc("turn"), F.desc("kind"), F.desc("text")).rowsBetween(Window.unboundedPreceding, -1)
    kept = e.withColumn("cut", F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(later)).filter("cut is null or turn is null or turn <= cut")
    folded = kept.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "text"))).alias("log"), F.max_by("role", F.when((F.col("kind") == "message") & F.col("role").isNotNull(), F.col("seq"))).alias("said"), F.min_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("first"))
    started = F.aggregate("log", F.lit(""), lambda acc, x: F.when(x["kind"] == "delta", F.concat(acc, x["text"])).otherwise(x["text"]))
    return folded.select("conv_id", "turn", F.coalesce("said", "first", F.lit("")).alias("role"), started.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans array<struct<start, length>> (code points, from 1)."""
    piece = messages.select("conv_id", "turn", "role", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    convs = piece.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "head", "body"))).alias("turns"))
    spans = F.aggregate(
        "turns",
        struct(at=F.lit(1).cast("long"), spans=F.array().cast("array<struct<start:bigint,length:bigint>>")),
        lambda acc, t: struct(
            at=acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END),
            spans=F.when(t["role"] == ASSISTANT, F.array_append(acc["spans"], struct(start=acc["at"] + F.length(t["head"]), length=F.length(t["body"]).cast("long")))).otherwise(acc["spans"]),
        ),
        lambda acc: acc["spans"],
    )
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return convs.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def format_events(events: DataFrame) -> DataFrame:
    return render(fold_events(events))


def parse(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans and turns array<struct<role, text>>, read back from the text alone."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda p: p != "")
    body = lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p))
    turn = lambda b: struct(role=unescape_role(F.substring_index(b, "\n", 1)), text=unescape(F.substring(b, F.instr(b, "\n") + 1, F.length(b))))
    return formatted.select("conv_id", "formatted", "loss_spans", F.transform(F.transform(pieces, body), turn).alias("turns"))


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Plain rows (conv_id, turn, role, text) as an event log of messages, numbered within their conversation: each row is its own turn."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), "role", "text")
    numbered = conversations.select("conv_id", F.row_number().over(order).cast("long").alias("turn"), "role", "text")
    return numbered.select("conv_id", F.col("turn").alias("seq"), "turn", F.lit("message").alias("kind"), "role", "text")


def digests(formatted: DataFrame) -> DataFrame:
    """The contract of the query: counts and digests read back from the formatted texts."""
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int"), s["length"].cast("int")))), "")
    read = parse(formatted).withColumn("loss", loss)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(turns, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
