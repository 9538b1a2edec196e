"""Harvest over described sources: filtered dialogue rows, instructions with context
or input, and conversations in several forms, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import descriptors as D
from ..operators import harvest as HV
from ..session import table
from . import harvest_plans as HP
from . import sqlgen as S

DIALOGUE = D.Source("dialogue", 1, "text", filter_role="user")
NOTES = D.Source("notes", 2, "instruction", language_field="lang", config="notes")
CHATS = D.Source("chats", 3, "thread", is_conversation=True)


def dialogue(spark, sf):
    c = table(spark, sf, "conversations")
    return lambda config: c.select((F.col("conv_id") * (1 << 20) + F.col("turn")).alias("seq"), "text", "role")


def notes(spark, sf):
    d, k = table(spark, sf, "documents"), F.col("doc_id") % 4
    context = (F.when(k == 1, F.lit(" ab ")).when(k == 2, F.lit(""))
                .when(k == 3, F.concat(F.lit(" about "), "lang", F.lit(" and "), "source", F.lit(" "))))
    given = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("input "), "lang", F.lit(" text"))).otherwise("")
    tables = {"notes": d.select(F.col("doc_id").alias("seq"), F.col("text").alias("instruction"), context.alias("context"), given.alias("input"), "lang")}
    return tables.get


def chats(spark, sf):
    """A conversation per row, its messages as JSON text in one of five forms, under the
    named field or another one."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    each = lambda f: F.to_json(F.transform("m", f))
    forms = [each(lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))),
             each(lambda x: F.struct(x["role"].alias("from"), x["text"].alias("value"))),
             each(lambda x: F.struct(x["text"].alias("text"))), each(lambda x: x["text"]),
             each(lambda x: F.struct(F.lit("").alias("content"), x["text"].alias("value")))]
    k = F.col("conv_id") % len(forms)
    text = F.when(k == 0, forms[0])
    for i, form in enumerate(forms[1:], 1):
        text = text.when(k == i, form)
    rows = turns.select(F.col("conv_id").alias("seq"), F.when(F.col("conv_id") % 2 == 0, text).alias("thread"),
                        F.when(F.col("conv_id") % 2 == 1, text).alias("messages"))
    return lambda config: rows


def sources(spark, sf):
    return [(DIALOGUE, dialogue(spark, sf)), (NOTES, notes(spark, sf)), (CHATS, chats(spark, sf))]


def q_harvest_sources(spark, sf):
    return HV.harvest_prompts(D.union_of(sources(spark, sf))).select("prompt_id", "source", "prompt_length")


def q_conversation_forms(spark, sf):
    rows = D.compiled(CHATS, chats(spark, sf), min_len=0)
    return rows.select("seq", F.col("text").alias("prompt"))


def q_prompt_assembly(spark, sf):
    rows = notes(spark, sf)("notes")
    return rows.select("seq", D.assembled_text(rows, "instruction").alias("full_prompt"), D.assembled_text(rows, "instruction", "lite").alias("lite_prompt"))


QUERIES = {"harvest_sources": q_harvest_sources, "conversation_forms": q_conversation_forms, "prompt_assembly": q_prompt_assembly}

NOTES_SQL = """SELECT doc_id AS seq, text AS instruction, lang,
  CASE doc_id % 4 WHEN 1 THEN ' ab ' WHEN 2 THEN '' WHEN 3 THEN ' about ' || lang || ' and ' || source || ' ' END AS context,
  CASE WHEN doc_id % 2 = 0 THEN 'input ' || lang || ' text' ELSE '' END AS input FROM documents"""


def assembly_sql(mode: str) -> str:
    over = D.CONTEXT_OVER[mode]
    add = lambda c, label: f"instruction || chr(10) || chr(10) || '{label}: ' || {c}"
    if mode == "lite":
        return (f"CASE WHEN length(context) > {over} THEN {add('context', 'Context')} WHEN length(input) > {over} THEN {add('input', 'Input')} "
                "ELSE instruction END")
    c, i = S.strip("context"), S.strip("input")
    return (f"CASE WHEN coalesce(context, '') <> '' THEN (CASE WHEN length({c}) > {over} THEN {add(c, 'Context')} ELSE instruction END) "
            f"WHEN coalesce(input, '') <> '' AND length({i}) > {over} THEN {add(i, 'Input')} ELSE instruction END")


FIRST_SQL = "SELECT conv_id AS seq, nullif(arg_min(text, turn), '') AS prompt FROM conversations GROUP BY conv_id"

SOURCES_SQL = f"""SELECT 'dialogue' AS source, 1 AS source_ord, conv_id * 1048576 + turn AS seq, text, NULL::VARCHAR AS language FROM conversations WHERE role = 'user'
UNION ALL SELECT 'notes', 2, seq, {assembly_sql('full')}, lang FROM ({NOTES_SQL})
UNION ALL SELECT 'chats', 3, seq, prompt, NULL FROM ({FIRST_SQL})"""

ORACLE = {
    "harvest_sources": HP._harvest_sql(None).replace(S.RAW_PROMPTS, SOURCES_SQL) + " SELECT prompt_id, source, prompt_length FROM s4",
    "conversation_forms": f"SELECT * FROM ({FIRST_SQL}) WHERE prompt IS NOT NULL",
    "prompt_assembly": f"SELECT seq, {assembly_sql('full')} AS full_prompt, {assembly_sql('lite')} AS lite_prompt FROM ({NOTES_SQL})",
}
