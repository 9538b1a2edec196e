"""Source descriptors: what a prompt source looks like, compiled to one scan per source.

A descriptor names the field that holds the prompt, whether it is a list of
messages, the role whose rows count, and the configuration (sub-table) to
read. ``compiled`` turns it into (source, source_ord, seq, text, language);
role and shortest length filter the source's own scan, before the union.

Message lists may be arrays of structs, arrays of strings or JSON text; the
first message's content, value or text counts (the first that isn't empty). A
record without the named list is looked for under the usual other names.
Direct records are an instruction, to which a long enough context or else an
input is appended; a context that is there keeps the input out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip_ws

# FIXED VALUES: other names of message lists, fields of a message, lengths of context that count
ALTERNATIVES = ("conversation", "conversations", "messages", "dialogue")
MESSAGE_FIELDS = ("content", "value", "text")
CONTEXT_OVER = {"full": 5, "lite": 10}


@dataclass(frozen=True)
class Source:
    name: str
    order: int
    prompt_field: str
    key: str = "seq"
    is_conversation: bool = False
    filter_role: str | None = None
    config: str | None = None
    language_field: str | None = None


def _said(*options: Column) -> Column:
    return F.coalesce(*[F.nullif(o.cast("string"), F.lit("")) for o in options])


def first_message(messages: Column, kind: T.DataType) -> tuple[Column, Column]:
    """(the list has a message, the text of its first one)."""
    if isinstance(kind, T.ArrayType):
        first = F.get(messages, F.lit(0))
        if isinstance(kind.elementType, T.StructType):
            held = [f for f in MESSAGE_FIELDS if f in kind.elementType.names]
            return F.size(messages) > 0, _said(*[first[f] for f in held]) if held else F.lit(None).cast("string")
        return F.size(messages) > 0, first.cast("string")
    listed = F.from_json(messages, "array<string>")
    of_object = _said(*[F.get_json_object(messages, f"$[0].{f}") for f in MESSAGE_FIELDS])
    return F.coalesce(F.size(listed) > 0, F.lit(False)), F.when(F.get(listed, F.lit(0)).startswith("{"), of_object).otherwise(F.get(listed, F.lit(0)))


def conversation_text(df: DataFrame, field: str) -> Column:
    """First message of the first list of a record that has any."""
    out = None
    for name in dict.fromkeys((field, *ALTERNATIVES)):
        if name in df.columns:
            there, text = first_message(F.col(name), df.schema[name].dataType)
            out = F.when(there, text) if out is None else out.when(there, text)
    return F.lit(None).cast("string") if out is None else out


def assembled_text(df: DataFrame, field: str, mode: str = "full") -> Column:
    """Instruction with its context or input. full: stripped and longer than 5; lite: as it
    is and longer than 10."""
    text, over = F.col(field), CONTEXT_OVER[mode]
    out = text
    for name, label in (("input", "Input"), ("context", "Context")):  # the last one decides
        if name in df.columns:
            more = strip_ws(F.col(name)) if mode == "full" else F.col(name)
            long = F.when(F.length(more) > over, F.concat(text, F.lit(f"\n\n{label}: "), more)).otherwise(text)
            chosen = F.coalesce(F.col(name) != "", F.lit(False)) if mode == "full" else F.coalesce(F.length(name) > over, F.lit(False))
            out = F.when(chosen, long).otherwise(out)
    return out


def compiled(source: Source, read: Callable[[str | None], DataFrame], *, mode: str = "full", min_len: int = 15) -> DataFrame:
    """One source's prompts. ``read`` gives its table, by configuration."""
    df = read(source.config)
    if source.filter_role is not None:
        df = df.where(F.col("role") == source.filter_role)
    text = conversation_text(df, source.prompt_field) if source.is_conversation else assembled_text(df, source.prompt_field, mode)
    language = F.col(source.language_field) if source.language_field else F.lit(None).cast("string")
    return (df.select(F.lit(source.name).alias("source"), F.lit(source.order).alias("source_ord"), F.col(source.key).cast("long").alias("seq"),
                      text.alias("text"), language.alias("language")).where(F.length("text") >= min_len))


def union_of(sources: list[tuple[Source, Callable[[str | None], DataFrame]]], **options) -> DataFrame:
    """All sources' prompts, each from its own scan."""
    parts = [compiled(s, read, **options) for s, read in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
