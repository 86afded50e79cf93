"""Chat formatting with Spark expressions only: a conversation becomes one string, and the string can be read back.

The turns of a conversation are collected as structs and sorted by turn; neighbours of one role become one block by array
aggregation, which keeps a mark between their texts; blocks are concatenated::

    <|role|>user<|text|>text<|turn|>next text of the same role<|end|>

All marks begin with ``<|``. In roles and texts ``<`` is written ``<0`` where a ``|`` or a ``0`` follows it: so no text can hold a mark, and
putting ``<`` for ``<0`` gives every text back. The loss mask is the list of spans (start, length) of the escaped assistant
texts in the string, in code points.

A conversation is one value in the result, so its rows do meet in one task; a conversation is bounded by what one string can hold. Many rows with one
conv_id cost what that string costs, and equal texts under many ids spread over the ids.

Defined cases. A null text is empty, a null role is the role ``""``. Rows are ordered by turn, null turns first, then by role and text, so ties and repeated rows
have one order, and each row stays a turn. Rows with a null conv_id are one conversation. An empty table gives an empty table. Only
``conv_id``, ``turn``, ``role`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSISTANT = "assistant"
HEAD, HEAD_END, NEXT, END = "<|role|>", "<|text|>", "<|turn|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, "<(?=[|0])", "<0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "<0", "<")


def _blocks(turns: Column) -> Column:
    """Merge neighbours of one role: struct(role, texts) for each run."""
    place = F.sequence(F.lit(0), F.size(turns) - 1)
    starts = F.filter(place, lambda i: (i == 0) | (F.get(turns, i).role != F.get(turns, i - 1).role))

    def block(start: Column, j: Column) -> Column:
        end = F.coalesce(F.get(starts, j + 1), F.size(turns))
        return F.struct(F.get(turns, start).role.alias("role"), F.transform(F.slice(turns, start + 1, end - start), lambda t: t.text).alias("texts"))

    return F.transform(starts, block)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (spans of assistant texts in it) of every conversation."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    escaped = rows.select("conv_id", F.transform("turns", lambda t: F.struct(escape(t.role).alias("role"), escape(t.text).alias("text"))).alias("turns"))
    blocks = escaped.select("conv_id", _blocks(F.col("turns")).alias("blocks"))
    # Each piece of the string, and whether it is under the loss mask.
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    mark = lambda text: piece(text, F.lit(False))
    inner = lambda b: F.flatten(F.transform(b.texts, lambda t, i: F.array(mark(F.when(i > 0, F.lit(NEXT)).otherwise(F.lit(""))), piece(t, b.role == ASSISTANT))))
    whole = lambda b: F.concat(F.array(mark(F.concat(F.lit(HEAD), b.role, F.lit(HEAD_END)))), inner(b), F.array(mark(F.lit(END))))
    pieces = blocks.select("conv_id", F.flatten(F.transform("blocks", whole)).alias("pieces"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def place(state: Column, p: Column) -> Column:
        size = F.length(p.text).cast("long")
        span = F.array(F.struct(state.at.alias("start"), size.alias("length")))
        return F.struct((state.at + size).alias("at"), F.when(p.loss, F.concat(state.spans, span)).otherwise(state.spans).alias("spans"))

    return pieces.select("conv_id", F.array_join(F.transform("pieces", lambda p: p.text), "").alias("formatted"), F.aggregate("pieces", start, place, lambda s: s.spans).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss_text, from the string and its loss spans alone."""
    # Blocks end with a mark, so what follows the last one is empty.
    blocks = F.split(F.col("formatted"), r"<\|end\|>", -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        role = F.substring_index(F.substring(block, len(HEAD) + 1, 1 << 30), HEAD_END, 1)
        body = F.substring(block, F.length(role) + len(HEAD) + len(HEAD_END) + 1, F.length(block))
        return F.transform(F.split(body, r"<\|turn\|>", -1), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    masked = F.array_join(F.transform("loss", lambda s: unescape(F.substring("formatted", (s.start + 1).cast("int"), s.length.cast("int")))), "")
    return formatted.select("conv_id", F.flatten(F.transform(blocks, turns)).alias("turns"), masked.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what is read back."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_control_conversation(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Adds conversation -7, whose texts look like another template's control strings."""
    said = "</s>[INST] ok [/INST]"
    rows = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit(ASSISTANT))).alias("turn", "role"), F.lit(said).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(rows)
