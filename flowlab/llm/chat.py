"""Chat formatting: conversations to training text with a loss mask.

A template is declared as data: for each role its header and whether its text is
learned, one footer, and the allowed moves between roles. The moves make a
finite-state machine, run over the roles of a conversation in turn order; it
accepts or names the first turn that breaks the order. Each turn gives three
segments, (text, loss): header, escaped text, footer. The segments joined are the
training text, and ``loss`` is true for the texts of learned roles alone.

Escaping is reversible and leaves no control string in a text: a backslash is
doubled, and wherever the footer or the mark of a header begins a backslash follows
its first character. So the footer ends a turn wherever it stands, and ``read_back`` finds the turns by the footer and the roles by the header. A role
that the template does not name is written in hexadecimal, which keeps it too.

Only Spark's own expressions are used. Turns are grouped by conversation once;
a conversation's training text is one row, as a trainer takes it.

Defined results: turns are ordered by turn (null first), then role and text; a
null text or role is empty; an empty text gives an empty segment; repeated rows
are repeated turns; rows without a conversation id make up one conversation
without id; conversations that break the order are formatted all the same, with
``valid`` false; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENTS = "array<struct<text:string,loss:boolean>>"


@dataclass(frozen=True)
class Role:
    label: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """``moves``: for each state, the roles that may speak next; a state is the
    role that spoke last, or ``start``. ``final``: states a conversation may end in."""
    roles: dict[str, Role]
    moves: dict[str, tuple[str, ...]]
    final: tuple[str, ...]
    mark: str = "### "
    colon: str = ": "
    footer: str = "</turn>"
    gap: str = "\n"
    #: roles that the template does not name
    other: Role = field(default_factory=lambda: Role("="))


DEFAULT = Template(
    roles={"system": Role("System"), "user": Role("User"), "assistant": Role("Assistant", loss=True)},
    moves={"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    final=("assistant",),
)


def _pick(key: Column, values: dict[str, object], default: Column) -> Column:
    out = default
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def escape(text: Column, t: Template = DEFAULT) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in (t.footer, t.mark.strip()):  # each of two characters or more, without backslashes
        text = F.regexp_replace(text, rf"{re.escape(control[0])}(?={re.escape(control[1:])})", re.escape(control[0]) + r"\\")
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def header(role: Column, t: Template = DEFAULT) -> Column:
    unnamed = F.concat(F.lit(t.other.label), F.hex(F.encode(role, "UTF-8")))
    return F.concat(F.lit(t.mark), _pick(role, {k: r.label for k, r in t.roles.items()}, unnamed), F.lit(t.colon))


def run_machine(roles: Column, t: Template = DEFAULT) -> Column:
    """(state, bad): the last state, ``error`` from the first turn on that the moves
    do not allow, and the place of that turn, from 0 (null if there is none)."""
    allowed = F.array(*[F.lit(f"{a} {b}") for a, to in t.moves.items() for b in to])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(s: Column, role: Column) -> Column:
        good = F.array_contains(allowed, F.concat_ws(" ", s["state"], role))
        return F.struct(F.when(good, role).otherwise(F.lit("error")).alias("state"), (s["at"] + 1).alias("at"),
                        F.coalesce(s["bad"], F.when(~good, s["at"])).alias("bad"))

    return F.aggregate(roles, start, step)


def format_chats(conversations: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """(conv_id, n_turns, valid, bad_turn, segments, formatted) of every conversation;
    ``bad_turn`` is the place (from 0) of the first turn out of order, or null."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    def of_turn(x: Column) -> Column:
        loss = _pick(x["role"], {k: r.loss for k, r in t.roles.items()}, F.lit(t.other.loss))
        return F.array(F.struct(header(x["role"], t).alias("text"), F.lit(False).alias("loss")),
                       F.struct(escape(x["text"], t).alias("text"), loss.alias("loss")),
                       F.struct(F.lit(t.footer + t.gap).alias("text"), F.lit(False).alias("loss")))

    checked = grouped.select("conv_id", "turns", run_machine(F.col("turns.role"), t).alias("end"),
                             F.flatten(F.transform("turns", of_turn)).cast(SEGMENTS).alias("segments"))
    return checked.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.col("end.state").isin(*t.final).alias("valid"),
        F.col("end.bad").alias("bad_turn"), "segments", F.array_join("segments.text", "").alias("formatted"))


def read_back(formatted: Column, t: Template = DEFAULT) -> Column:
    """The (role, text) turns of a training text."""
    names = {r.label: k for k, r in t.roles.items()}

    def turn(piece: Column, i: Column) -> Column:
        begin = F.when(i == 0, 0).otherwise(len(t.gap)) + len(t.mark) + 1
        colon = F.locate(t.colon, piece)
        label = F.substring(piece, begin, colon - begin)
        unnamed = F.decode(F.unhex(F.substring(label, F.lit(len(t.other.label) + 1), F.length(label))), "UTF-8")
        return F.struct(_pick(label, names, unnamed).alias("role"),
                        unescape(F.substring(piece, colon + len(t.colon), F.length(piece))).alias("text"))

    # the last piece is the gap after the last footer
    pieces = F.split(formatted, re.escape(t.footer), -1)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
