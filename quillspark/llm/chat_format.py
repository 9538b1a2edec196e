"""Chat formatting: a finite-state machine over roles, and a declarative template.

A conversation's turns, in order, run through a transition table; the state
reached tells whether the order is legal and, if not, at which turn it broke.
Whatever the verdict, every turn is formatted: the template lists the parts
of a turn and says which of them count for the training loss. Parts come out
as segments, ``(text, loss)``, and joined as ``formatted``.

Control strings inside a text are escaped, so that a text can never close or
open a turn: backslashes are doubled and ``<|`` becomes ``<\\|``. ``parse``
undoes this and gives the turns back exactly.

Only column expressions and one aggregate on the conversation are used. A
conversation becomes one string, so its turns meet in one row; rows are
aggregated before the exchange and nothing wider than a conversation is
ever gathered.

Defined results: a null text is empty; a null role is the empty role, which
the machine does not know; unknown roles are formatted without loss and make
the conversation illegal; a null turn sorts first; rows that tie on the turn
number go by role, then text; repeated rows are repeated turns; a null
conversation id is a conversation of its own; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_or_empty

START = "start"
BROKEN = "broken"


@dataclass(frozen=True)
class Template:
    """Parts of a turn in order: a literal, ``{role}`` or ``{text}``. The text
    counts for the loss if its role is in ``loss_roles``; ``loss_literals``
    lists the indices of literal parts that do too."""

    opening: str = "<|im_start|>"
    closing: str = "<|im_end|>"
    parts: tuple[str, ...] = ("<|im_start|>", "{role}", "\n", "{text}", "<|im_end|>", "\n")
    loss_roles: tuple[str, ...] = ("assistant",)
    transitions: dict[tuple[str, str], str] = field(default_factory=lambda: {
        (START, "system"): "system", (START, "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user",
    })
    accepting: tuple[str, ...] = ("user", "assistant")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


#: A line break inside a role; no escaped text can hold this string.
ROLE_BREAK = "<|nl|>"


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(ROLE_BREAK))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(ROLE_BREAK), F.lit("\n")))


def run_machine(roles: Column, template: Template) -> Column:
    """Struct: the state after the last turn and the index of the first illegal turn (null if none)."""
    table = F.create_map(*[F.lit(x) for (state, role), to in template.transitions.items()
                           for x in (f"{state}\x00{role}", to)])
    start = F.struct(F.lit(START).alias("state"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("broke_at"))

    def step(a: Column, role: Column) -> Column:
        to = F.coalesce(F.try_element_at(table, F.concat(a["state"], F.lit("\x00"), role)), F.lit(BROKEN))
        broke = F.when(a["broke_at"].isNull() & (to == BROKEN), a["i"]).otherwise(a["broke_at"])
        return F.struct(to.alias("state"), (a["i"] + 1).alias("i"), broke.alias("broke_at"))

    return F.aggregate(roles, start, step)


def turn_segments(turn: Column, template: Template) -> Column:
    """Segments of one turn: array of (text, loss)."""
    fill = {"{role}": escape_role(turn["role"]), "{text}": escape(turn["text"])}
    return F.array(*[
        F.struct(fill.get(p, F.lit(p)).alias("text"),
                 (turn["role"].isin(*template.loss_roles) if p == "{text}" else F.lit(False)).alias("loss"))
        for p in template.parts])


def format_conversations(df: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its id, ``segments`` (text, loss), ``formatted``,
    ``legal`` and ``broke_at`` (index of the first illegal turn)."""
    item = F.struct(F.col(turn).alias("turn"), text_or_empty(F.col(role)).alias("role"),
                    text_or_empty(F.col(text)).alias("text"))
    grouped = df.groupBy(F.col(conv).alias(conv)).agg(F.sort_array(F.collect_list(item)).alias("__turns"))
    machine = run_machine(F.transform("__turns", lambda t: t["role"]), template)
    segments = F.flatten(F.transform("__turns", lambda t: turn_segments(t, template)))
    return (grouped.select(conv, machine.alias("__fsm"), segments.alias("segments"))
            .select(conv, "segments", F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"),
                    F.col("__fsm.state").isin(*template.accepting).alias("legal"),
                    F.col("__fsm.broke_at").alias("broke_at")))


def parse(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) that a formatted string holds."""
    tail = len(template.closing) + 1

    def turn(body: Column) -> Column:
        at = F.instr(body, "\n")
        role = F.substring(body, F.lit(1), at - 1)
        text = F.substring(body, at + 1, F.length(body) - at - tail)
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    opening = "".join("\\" + c if not c.isalnum() and c != "_" else c for c in template.opening)
    pieces = F.split(formatted, opening, -1)
    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)


def digests(formatted_df: DataFrame, conv: str = "conv_id", template: Template = Template()) -> DataFrame:
    """Counts and digests of what the formatted output itself holds."""
    loss = F.concat_ws("", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])))
    read = formatted_df.select(conv, "formatted", "legal", loss.alias("__loss"),
                               parse(F.col("formatted"), template).alias("__back"))
    whole = F.concat_ws("", F.transform("__back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        conv, F.size("__back").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"), F.sha2("__loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "legal")
