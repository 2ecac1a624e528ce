"""Chat formatting (operator 9): native expressions only.

The template of a turn, or of adjacent turns of one role, is ``<turn:ROLE>`` TEXT ``<and>`` TEXT ``</turn>`` and a line
end.  In roles and texts a backslash becomes ``\\b``, ``<`` becomes ``\\l`` and ``>`` becomes ``\\g``, so that no control
string can stand inside a text and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, AFTER_ROLE, AND, CLOSE = "<turn:", ">", "<and>", "</turn>\n"
#: In the order in which they are escaped; undone in the opposite one.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
LEARNT = "assistant"


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, spans) from rows (conv_id, turn, role, text).

    Turns are sorted by turn (null first), ties by role and text; null roles and texts count as empty; repeated rows are
    turns of their own.  Adjacent turns of one role become one block.  spans: the (start, length) of each assistant text
    inside ``formatted``, in code points: the loss mask.  Rows of a null conv_id form one conversation.  Other columns
    are not read.  No rows give no conversations.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    row = F.struct("turn", blank(F.col("role")).alias("role"), blank(F.col("text")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t"))
    # where a run of one role begins
    starts = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == 1) | (F.element_at("t", i).role != F.element_at("t", F.greatest(i - 1, F.lit(1))).role))
    chats = chats.withColumn("s", starts)
    end = lambda k: F.coalesce(F.get("s", k + 1), F.size("t") + 1)
    run = F.transform("s", lambda s, k: F.struct(F.element_at("t", s).role.alias("role"), F.transform(F.slice("t", s, end(k) - s), lambda x: escape(x.text)).alias("texts")))
    chats = chats.select("conv_id", run.alias("runs"))
    block = F.transform("runs", lambda r: F.concat(F.lit(OPEN), escape(r.role), F.lit(AFTER_ROLE), F.array_join(r.texts, AND), F.lit(CLOSE)))
    chats = chats.select("conv_id", "runs", block.alias("blocks"))
    # parts before, between and after the texts, so that offsets are running sums of lengths
    part = lambda n, own: F.struct(n.cast("long").alias("n"), own.alias("own"))
    inner = lambda r: F.flatten(F.transform(r.texts, lambda x, i: F.array(part(F.when(i == 0, F.lit(0)).otherwise(F.lit(len(AND))), F.lit(False)), part(F.char_length(x), r.role == LEARNT))))
    parts = F.flatten(F.transform("runs", lambda r: F.concat(F.array(part(F.char_length(escape(r.role)) + len(OPEN) + len(AFTER_ROLE), F.lit(False))), inner(r), F.array(part(F.lit(len(CLOSE)), F.lit(False))))))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    add = lambda a, p: F.struct((a.at + p.n).alias("at"), F.when(p.own, F.concat(a.spans, F.array(F.struct(a.at.alias("start"), p.n.alias("length"))))).otherwise(a.spans).alias("spans"))
    return chats.select("conv_id", F.array_join("blocks", "").alias("formatted"), F.aggregate(parts, zero, add, lambda a: a.spans).alias("spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss array<string>, formatted): what the output holds, unescaped.

    loss: the texts under the mask ``spans``."""
    blocks = F.filter(F.split("formatted", CLOSE, -1), lambda b: b != "")
    each = F.flatten(F.transform(blocks, lambda b: F.transform(F.split(F.regexp_replace(b, f"^{OPEN}[^>]*{AFTER_ROLE}", ""), AND, -1), lambda x: F.struct(unescape(F.regexp_extract(b, f"^{OPEN}([^>]*){AFTER_ROLE}", 1)).alias("role"), unescape(x).alias("text")))))
    loss = F.transform("spans", lambda s: unescape(F.substr(F.col("formatted"), (s.start + 1).cast("int"), s.length.cast("int"))))
    return formatted.select("conv_id", each.alias("turns"), loss.alias("loss"), "formatted")


def digests(turns: DataFrame) -> DataFrame:
    """Counts and digests of what ``read_chats`` reads back from ``format_chats``."""
    got = read_chats(format_chats(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return got.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
