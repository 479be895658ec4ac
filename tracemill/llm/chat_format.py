"""Chat formatting with Spark expressions only.

Turns are collected per conversation and sorted as structs, adjacent turns of
one role are merged by an array aggregation, and the blocks are concatenated:

    ### assistant:
    first text<next/>second text</turn>

Control strings inside texts and roles are written with a backslash code, so the
output can be parsed back exactly. Defined results: a null text or role is
empty, null turns sort first, ties on the turn are ordered by role and text, a
null conversation id is a conversation of its own, an empty table gives no rows.
Input columns other than the four named ones are ignored. One conversation is
one output row, so a conversation must fit in a task; its turns are collected
once, after a single shuffle on the conversation id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
HEAD, CLOSE, NEXT = "### ", "</turn>", "<next/>"
#: What is escaped, and the code that stands for it. The backslash comes first.
CODES = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\t"), ("<next/>", "\\x"))
ROLE_CODES = (*CODES, ("\n", "\\n"))


def escape(text: Column, codes=CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes=CODES) -> Column:
    """Undo ``escape``: doubled backslashes are cut out first, so no code can start inside one."""

    def piece(part: Column) -> Column:
        for plain, code in codes[1:]:
            part = F.replace(part, F.lit(code), F.lit(plain))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), piece), "\\")


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``loss``.

    ``loss`` lists the parts of ``formatted`` that a model learns, as
    ``struct<start, length>`` in code points from 0, one for each text of the
    role ``learn``.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # A turn begins a block where the turn before it has another role.
    cut = sorted_turns.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t, i: F.struct(
                t["role"].alias("role"),
                escape(t["text"]).alias("body"),
                ((i == 0) | (F.get(F.col("turns"), i - 1)["role"] != t["role"])).alias("opens"),
                ((i == F.size("turns") - 1) | (F.get(F.col("turns"), i + 1)["role"] != t["role"])).alias("closes"),
            ),
        ).alias("turns"),
    )
    parts = cut.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                F.when(t["opens"], F.concat(F.lit(HEAD), escape(t["role"], ROLE_CODES), F.lit(":\n"))).otherwise(F.lit("")).alias("before"),
                t["body"].alias("body"),
                F.when(t["closes"], F.lit(CLOSE + "\n")).otherwise(F.lit(NEXT)).alias("after"),
                (t["role"] == learn).alias("learn"),
            ),
        ).alias("parts"),
    )
    # The start of each text is the length of all that stands before it.
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["before"])
        size = F.length(p["body"]).cast("long")
        return F.struct(
            (start + size + F.length(p["after"])).alias("at"),
            F.when(p["learn"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), size.alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        )

    return parts.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["before"], p["body"], p["after"])), "").alias("formatted"),
        F.aggregate("parts", zero, step)["spans"].alias("loss"),
    )


def parse_chats(formatted: DataFrame) -> DataFrame:
    """Read ``formatted`` back: ``turns`` as ``array<struct<role, text>>``, one for each original turn."""
    blocks = formatted.withColumn("_blocks", F.filter(F.split("formatted", CLOSE + "\n"), lambda b: b != ""))

    def turns(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        role = unescape(F.substring(head, F.lit(len(HEAD) + 1), F.length(head) - len(HEAD) - 1), ROLE_CODES)
        body = F.substring(block, F.length(head) + 2, F.length(block))
        return F.transform(F.split(body, NEXT), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return blocks.withColumn("turns", F.flatten(F.transform("_blocks", turns))).drop("_blocks")


def learned_text(formatted: DataFrame) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int")))), "")
