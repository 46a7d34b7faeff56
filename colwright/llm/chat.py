"""Chat formatting: a finite-state machine over roles and a declarative template.

The template gives each role an opening and a closing mark and says whether its text carries loss.
Control strings inside texts are escaped: every backslash is doubled, then a backslash is put after
the first character of each control string. No control string holds a backslash, so none is left in
an escaped text, and the way back (remove the inserted backslashes, then halve the rest) is exact.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F


class Turn(NamedTuple):
    opening: str
    closing: str
    loss: bool


class Template(NamedTuple):
    turns: dict[str, Turn]  # per role
    other: Turn  # for all other roles; {} in the opening takes the role, as hexadecimal UTF-8
    moves: dict[str, tuple[str, ...]]  # the roles that may follow a role; "" stands for the start
    ends: tuple[str, ...]  # roles that may come last
    controls: tuple[str, ...]  # strings that must not be read inside a text


TEMPLATE = Template(
    turns={
        "system": Turn("<<SYS>>", "<</SYS>>", False),
        "user": Turn("[INST] ", " [/INST]", False),
        "assistant": Turn("<s>", "</s>", True),
    },
    other=Turn("[ROLE {}] ", " [/ROLE]", False),
    moves={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("assistant",),
    controls=("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE", "[/ROLE]"),
)


def escaped(text: Column, template: Template = TEMPLATE) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in template.controls:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescaped(text: Column, template: Template = TEMPLATE) -> Column:
    for c in template.controls:
        text = F.replace(text, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def _mark(role: Column, part: str, template: Template) -> Column:
    out = None
    for name, turn in template.turns.items():
        value = F.lit(getattr(turn, part))
        out = F.when(role == name, value) if out is None else out.when(role == name, value)
    before, slot, after = getattr(template.other, part).partition("{}")
    other = F.concat(F.lit(before), F.lower(F.hex(F.encode(role, "UTF-8"))), F.lit(after)) if slot else F.lit(before)
    return out.otherwise(other)


def segments(turns: Column, template: Template = TEMPLATE) -> Column:
    """array<struct<text, loss>> of an array<struct<role, text>>: marks and escaped texts in order;
    the concatenated texts are the formatted conversation."""
    losses = [name for name, turn in template.turns.items() if turn.loss]
    return F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(_mark(t.role, "opening", template).alias("text"), F.lit(False).alias("loss")),
        F.struct(escaped(t.text, template).alias("text"), t.role.isin(losses).alias("loss")),
        F.struct(_mark(t.role, "closing", template).alias("text"), F.lit(False).alias("loss")))))


def turn_order(turns: Column, template: Template = TEMPLATE) -> Column:
    """The machine's last state: the last role, "" without turns, or "error" once a role came that
    may not follow its predecessor."""
    moves = [f"{a}\n{b}" for a, after in template.moves.items() for b in after]
    return F.aggregate(turns, F.lit(""), lambda state, t: F.when(
        F.concat(state, F.lit("\n"), t.role).isin(moves), t.role).otherwise(F.lit("error")))


def format_chats(rows: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """(conv_id, turns, segments, formatted, valid), a row per conversation.

    rows: conv_id, turn, role, text; other columns are ignored. Null roles and texts count as empty.
    Turns are put in order of (turn, role, text), null turns first, repeated rows stay. Rows with a
    null conv_id form one conversation. valid tells whether the machine accepts the order of roles;
    invalid conversations are formatted all the same, roles unknown to the template with its mark for
    others. The unit of work is one conversation, as its formatted text is one value; an empty table
    gives an empty result.
    """
    one = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"),
                   F.coalesce("text", F.lit("")).alias("text"))
    return (rows.select("conv_id", one.alias("one")).groupBy("conv_id")
            .agg(F.sort_array(F.collect_list("one")).alias("turns"))
            .withColumn("segments", segments(F.col("turns"), template))
            .withColumn("state", turn_order(F.col("turns"), template))
            .select("conv_id", "turns", "segments",
                    F.array_join(F.col("segments.text"), "").alias("formatted"),
                    F.col("state").isin(*template.ends).alias("valid")))


def read_chats(formatted: Column, template: Template = TEMPLATE) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    opening, closing, role = [], [], []
    for turn in (*template.turns.values(), template.other):
        opening.append(re.escape(turn.opening).replace(r"\{\}", "[0-9a-f]*"))
        closing.append(re.escape(turn.closing))
    pattern = F.lit(f"(?s)({'|'.join(opening)})(.*?)({'|'.join(closing)})")
    marks = F.regexp_extract_all(formatted, pattern, F.lit(1))
    texts = F.regexp_extract_all(formatted, pattern, F.lit(2))

    def named(mark):
        out = None
        for name, turn in template.turns.items():
            hit = mark == turn.opening
            out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
        before, _, after = template.other.opening.partition("{}")
        inner = F.substring(mark, F.lit(len(before) + 1), F.length(mark) - len(before) - len(after))
        return out.otherwise(F.decode(F.unhex(inner), "UTF-8"))

    return F.zip_with(marks, texts, lambda m, t: F.struct(
        named(m).alias("role"), unescaped(t, template).alias("text")))
