"""Chat formatting in Spark's own expressions: no Python runs on the executors.

A declarative template gives each role its opening and closing mark, and the turns that may
follow a state.  A finite-state machine runs over a conversation's roles: a turn moves it to the state
of its role, by a transition the template allows or by one it does not.  Every turn
becomes three text segments (opening mark, escaped text, closing mark); the text carries the loss flag
if the transition led to a ``trained`` state and, unless ``train_out_of_order``, was allowed.

Escaping is reversible: wherever a text holds a mark, or a mark with backslashes after its
first character, one more backslash is put there.  Other text stays as it is.  A formatted
text can be read back: no escaped text holds a mark, so marks alone cut it into turns.

Defined cases: null roles and texts count as empty; an unknown role is written out between
the marks for other roles; turns are ordered by number, then role, then text, null numbers
first, so repeated rows stay and have a fixed order; all rows without a conversation id are one
conversation, which must fit a row too; an invalid order is formatted all the same and flagged; an empty
table gives an empty result; other columns are not read.  One conversation is one output
row, so its turns must fit a row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    marks: dict[str, tuple[str, str]]
    other: tuple[str, str, str]  # opening, end of the role's name, closing
    follows: dict[str, tuple[str, ...]]  # state -> roles that may come next; a role is the next state
    final: tuple[str, ...]
    trained: tuple[str, ...]
    start: str = field(default="")
    train_out_of_order: bool = True

    def __post_init__(self) -> None:
        every = self.all_marks()
        if len(set(every)) < len(every) or any(len(m) < 2 or "\\" in m for m in every):
            raise ValueError("marks must differ, be two characters or longer and hold no backslash")
        if any(m[0] in other[1:] for m in every for other in every):
            raise ValueError("no mark may hold another mark's first character inside")

    def all_marks(self) -> list[str]:
        return [m for pair in self.marks.values() for m in pair] + list(self.other)


# The marks of a common instruction format.
INSTRUCT = Template(
    marks={"system": ("<SYS>", "</SYS>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")},
    other=("[ROLE]", "[TEXT]", "[/ROLE]"),
    follows={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    final=("assistant",),
    trained=("assistant",),
)


def first_characters(template: Template) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for mark in template.all_marks():
        found.setdefault(mark[0], []).append(mark[1:])
    return found


def escape(text: Column, template: Template) -> Column:
    for first, rests in first_characters(template).items():
        pattern = f"({re.escape(first)})(\\\\*)({'|'.join(map(re.escape, rests))})"
        text = F.regexp_replace(text, pattern, r"$1\\$2$3")
    return text


def unescape(text: Column, template: Template) -> Column:
    for first, rests in first_characters(template).items():
        pattern = f"({re.escape(first)})\\\\(\\\\*)({'|'.join(map(re.escape, rests))})"
        text = F.regexp_replace(text, pattern, "$1$2$3")
    return text


def _case(value: Column, choices: dict[str, Column], otherwise: Column) -> Column:
    out = None
    for key, result in choices.items():
        out = F.when(value == key, result) if out is None else out.when(value == key, result)
    return otherwise if out is None else out.otherwise(otherwise)


def transitions(roles: Column, template: Template) -> Column:
    """(state, allowed) after each turn: the role becomes the state, and whether the state before lets it follow."""
    def step(role: Column, k: Column) -> Column:
        before = F.when(k == 0, F.lit(template.start)).otherwise(F.get(roles, k - 1))
        allowed = _case(before, {s: role.isin(*rs) for s, rs in template.follows.items()}, F.lit(False))
        return F.struct(role.alias("state"), allowed.alias("allowed"))

    return F.transform(roles, step)


def end_state(moves: Column, template: Template) -> Column:
    """The machine's last state; null if a transition was not allowed."""
    last = F.when(F.size(moves) > 0, F.element_at(moves, -1)["state"]).otherwise(F.lit(template.start))
    return F.when(F.forall(moves, lambda m: m["allowed"]), last)


def segments(turns: Column, moves: Column, template: Template) -> Column:
    """(text, loss) segments of an array of (role, text) turns and the transitions they made."""
    def of_turn(t: Column, k: Column) -> Column:
        role, text, move = t["role"], escape(t["text"], template), F.get(moves, k)
        name = F.concat(F.lit(template.other[0]), escape(role, template), F.lit(template.other[1]))
        opening = _case(role, {r: F.lit(m[0]) for r, m in template.marks.items()}, name)
        closing = _case(role, {r: F.lit(m[1]) for r, m in template.marks.items()}, F.lit(template.other[2]))
        loss = move["state"].isin(*template.trained)
        loss = loss if template.train_out_of_order else loss & move["allowed"]
        part = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
        return F.array(part(opening, F.lit(False)), part(text, loss), part(closing, F.lit(False)))

    return F.flatten(F.transform(turns, of_turn))


def format_chats(
    rows: DataFrame, template: Template = INSTRUCT, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: id, ``formatted``, ``segments``, ``valid``, ``end_state``."""
    known = rows.select(
        F.col(conversation).alias("id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    turns = known.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    made = turns.withColumn("moves", transitions(F.col("turns.role"), template))
    made = made.withColumn("segments", segments(F.col("turns"), F.col("moves"), template)).withColumn("end_state", end_state(F.col("moves"), template))
    return made.select(
        F.col("id").alias(conversation), F.array_join("segments.text", "").alias("formatted"), "segments",
        F.coalesce(F.col("end_state").isin(*template.final), F.lit(False)).alias("valid"), "end_state",
    )


def read_back(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The (role, text) turns of a formatted text."""
    closings = [m[1] for m in template.marks.values()] + [template.other[2]]
    pieces = F.filter(F.split(formatted, "|".join(f"(?<={re.escape(c)})" for c in closings), -1), lambda p: p != "")

    def inner(piece: Column, opening: str, closing: str) -> Column:
        return piece.substr(F.lit(len(opening) + 1), F.length(piece) - len(opening) - len(closing))

    def turn(role: Column, text: Column) -> Column:
        return F.struct(role.alias("role"), unescape(text, template).alias("text"))

    def parsed(p: Column) -> Column:
        name_end = F.instr(p, template.other[1])
        rest = p.substr(name_end + len(template.other[1]), F.length(p) - name_end - len(template.other[1]) + 1 - len(template.other[2]))
        name = p.substr(F.lit(len(template.other[0]) + 1), name_end - len(template.other[0]) - 1)
        out = None
        for role, (opening, closing) in template.marks.items():
            value = turn(F.lit(role), inner(p, opening, closing))
            out = F.when(p.startswith(opening), value) if out is None else out.when(p.startswith(opening), value)
        other = turn(unescape(name, template), rest)
        return other if out is None else out.otherwise(other)

    return F.transform(pieces, parsed)
