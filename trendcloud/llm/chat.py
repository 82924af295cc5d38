"""Conversations as training text: turns between control strings, with a loss mask.

All of it is Spark expressions. Turns are collected as structs, sorted, merged
where neighbours have the same role, and concatenated. Every array step is linear
in the turns: a merge slices the sorted turns at the places where the role
changes, instead of growing an array turn by turn.

    <|turn|>role<|text|>text<|end|>            one turn
    <|turn|>role<|text|>a<|next|>b<|end|>      neighbours of one role, merged

Control strings inside texts and roles are escaped: a backslash goes behind the
opening sign, and one more where there are backslashes already, so that taking
one away restores the text exactly. That covers the strings above and those of
other common templates (`FOREIGN`).

A formatted conversation is one value, so it is put together in one task; its
rows are escaped before they meet there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
#: Control strings of other templates that texts may not carry either, behind their opening sign.
FOREIGN = (r"/?s>", r"/?INST\]", r"/?SYS>>")
_TAIL = "|".join((r"\|", *FOREIGN))
ESCAPABLE = rf"([<\[])(\\*)({_TAIL})"
ESCAPED = rf"([<\[])\\(\\*)({_TAIL})"
_MARK = r"<\|(?:turn|text|next|end)\|>"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPABLE), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPED), F.lit("$1$2$3"))


def _literal(mark: str) -> Column:
    return F.lit(mark.replace("|", r"\|"))


def _run(text: Column, loss: Column | bool = False) -> Column:
    return F.struct(F.char_length(text).alias("n_chars"), F.lit(loss).alias("loss") if isinstance(loss, bool) else loss.alias("loss"))


def _merged(turns: Column) -> Column:
    """Sorted turns as (role, texts), neighbours of one role together."""
    places = F.sequence(F.lit(0), F.size(turns) - 1)
    starts = F.filter(places, lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    return F.transform(
        F.arrays_zip(starts.alias("a"), F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(turns))).alias("b")),
        lambda x: F.struct(
            F.get(turns, x["a"])["role"].alias("role"),
            F.transform(F.slice(turns, x["a"] + 1, x["b"] - x["a"]), lambda t: t["text"]).alias("texts"),
        ),
    )


def format_conversations(
    rows: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(id_col, formatted, mask) of every conversation, from one row per turn.

    `mask` lists the lengths of the formatted text's parts in order, contents and
    control strings by turns beginning with an empty content, and which of them
    are under the loss: texts of the role `assistant`.

    Turns are ordered by `turn_col`, null first, then by role and text; repeated
    rows are turns of their own. Null roles and texts read as empty. Rows without
    a conversation id are one conversation. An empty table gives an empty one.
    Other columns are left out.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        escape(F.coalesce(F.col(role_col), F.lit(""))).alias("role"),
        escape(F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
    )
    whole = rows.groupBy(F.col(id_col)).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    merged = whole.select(id_col, _merged(F.col("turns")).alias("blocks"))
    formatted = F.array_join(
        F.transform("blocks", lambda b: F.concat(F.lit(TURN), b["role"], F.lit(TEXT), F.array_join(b["texts"], NEXT), F.lit(END))), ""
    )

    def runs(block: Column) -> Column:
        loss = block["role"] == LEARNED
        head = F.array(_run(F.lit("")), _run(F.lit(TURN)), _run(block["role"]))
        marks = lambda i: F.when(i == 0, F.lit(TEXT)).otherwise(F.lit(NEXT))
        texts = F.flatten(F.transform(block["texts"], lambda t, i: F.array(_run(marks(i)), _run(t, loss))))
        return F.concat(head, texts, F.array(_run(F.lit(END))))

    mask = F.concat(F.flatten(F.transform("blocks", runs)), F.array(_run(F.lit(""))))
    return merged.select(id_col, formatted.alias("formatted"), mask.alias("mask"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, as they were."""
    blocks = F.split(formatted, _literal(END), -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        parts = F.split(F.substring(block, F.lit(len(TURN) + 1), F.char_length(block)), _literal(TEXT), -1)
        role = unescape(F.get(parts, F.lit(0)))
        texts = F.split(F.get(parts, F.lit(1)), _literal(NEXT), -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, mask: Column) -> Column:
    """The contents under the loss mask, each as it was before escaping."""
    contents = F.split(formatted, F.lit(_MARK), -1)
    under = F.filter(contents, lambda _, k: F.get(mask, 2 * k)["loss"])
    return F.transform(under, unescape)


def chat_report(rows: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives."""
    done = format_conversations(rows)
    read = done.select(
        "conv_id",
        read_turns(F.col("formatted")).alias("turns"),
        F.array_join(read_loss(F.col("formatted"), F.col("mask")), "").alias("loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
