"""The whole intent table: every typed column in three modes, and generated rows that carry them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import generate as G
from ..operators import intent_schema as I
from ..session import balanced, table
from ..sources import io as IO
from ..streaming.jobs import run_dir
from . import generate_plans as GP
from . import sqlgen as S

TEXTS = {
    "Action": "CASE WHEN p_partkey % 13 = 0 THEN ' ' WHEN p_partkey % 3 = 0 THEN 'SUMMARIZE' WHEN p_partkey % 3 = 1 THEN ' CREATE ' ELSE 'FIND' END",
    "Object": "CASE WHEN p_size % 6 = 0 THEN 'EMAIL' WHEN p_size % 6 = 3 THEN '?' WHEN p_size % 6 = 4 THEN '' ELSE upper(p_type) END",
    "Subject": "p_name",
}


def column_sql(j: int, f: I.Field) -> str:
    """Text of a column, by a rule that both engines read."""
    if f.header in TEXTS:
        return TEXTS[f.header]
    if f.kind == "text":
        return f"CASE WHEN (p_partkey + {j}) % 4 = 0 THEN '' ELSE ' ' || CAST(p_partkey % 100 AS STRING) || '.{j}% ' END"
    if f.kind == "flag":
        return f"CASE (p_partkey + {j}) % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'true' WHEN 2 THEN 'FALSE' ELSE '' END"
    if f.kind == "count":
        return f"CASE WHEN p_partkey % 97 = {j} THEN '3.0' WHEN (p_partkey + {j}) % 7 = 0 AND {str(not f.needed)} THEN '' ELSE ' ' || CAST((p_partkey * {j + 1}) % 1000 AS STRING) END"
    return f"CASE WHEN p_partkey % 89 = {j} THEN '1,5' WHEN (p_partkey + {j}) % 5 = 0 THEN '' ELSE CAST(p_partkey % 10 AS STRING) || '.5' END"


RAW = "SELECT p_partkey AS intent_id, " + ", ".join(f'{column_sql(j, f)} AS c{j}' for j, f in enumerate(I.FIELDS)) + " FROM part"


def raw_table(spark, sf):
    p = balanced(table(spark, sf, "part"))
    return p.select(F.col("p_partkey").cast("string").alias("intent_id"), *[F.expr(column_sql(j, f)).alias(f.header) for j, f in enumerate(I.FIELDS)])


def scanned(spark, sf, mode):
    path = f"{run_dir(spark, 'intents')}/csv"
    IO.write_csv(raw_table(spark, sf), path)
    rows = I.scan(I.read_table(spark, path), mode, keep=("intent_id",))
    return rows.withColumn("intent_id", F.col("intent_id").cast("bigint"))


def q_intents_modes(spark, sf):
    out = None
    for mode in I.MODES:
        rows = scanned(spark, sf, mode).withColumn("mode", F.lit(mode))
        out = rows if out is None else out.unionByName(rows)
    return out


def q_generated_records(spark, sf):
    intents = scanned(spark, sf, "known")
    made = G.gen_v2(GP.clean(spark, sf))
    return I.records(made.select("intent_id", "slot", "synthetic_prompt"), intents)


def q_gen_offline_named(spark, sf):
    """Offline templates over named intents, whose object may be unknown (a question mark)."""
    return G.gen_offline(scanned(spark, sf, "named").where("reject is null"))


QUERIES = {"gen_offline_named": q_gen_offline_named, "intents_modes": q_intents_modes, "generated_records": q_generated_records}


def typed_sql(mode: str) -> str:
    cols, wrong = [], []
    for j, f in enumerate(I.FIELDS):
        s = f"coalesce({S.strip(f'c{j}')}, '')"
        if f.kind == "text":
            cols.append(f"{s} AS {f.column}")
        elif f.kind == "flag":
            cols.append(f"upper(coalesce(c{j}, 'FALSE')) = 'TRUE' AS {f.column}")
        else:
            kind = "BIGINT" if f.kind == "count" else "DOUBLE"
            bad = f"NOT regexp_full_match({s}, '[+-]?[0-9]+')" if f.kind == "count" else f"TRY_CAST({s} AS DOUBLE) IS NULL"
            cols.append(f"(CASE WHEN {s} = '' THEN {f.default} WHEN NOT ({bad}) THEN TRY_CAST({s} AS {kind}) END)::{kind} AS {f.column}")
            wrong.append(f"CASE WHEN ({s} = '' AND {f.needed}) OR ({s} <> '' AND {bad}) THEN 'bad {f.column}' END")
    names = {f.column: f"coalesce({S.strip(f'c{j}')}, '')" for j, f in enumerate(I.FIELDS)}
    bad = {"any": [], "named": ["''"], "known": ["''", "'?'"]}[mode]
    unfit = f"{names['action']} IN ({', '.join(bad)}) OR {names['object']} IN ({', '.join(bad)})" if bad else "FALSE"
    return f"""SELECT intent_id::BIGINT AS intent_id, {', '.join(cols)},
  CASE WHEN {unfit} THEN 'missing action or object' ELSE coalesce({', '.join(wrong)}) END AS reject, '{mode}' AS mode FROM ({RAW})"""


ORACLE = {
    "gen_offline_named": GP.ORACLE["gen_offline"].replace(GP.typed_sql(), f"clean AS (SELECT * FROM ({typed_sql('named')}) WHERE reject IS NULL)"),
    "intents_modes": " UNION ALL ".join(typed_sql(m) for m in I.MODES),
    "generated_records": f"""SELECT g.intent_id, g.slot, g.synthetic_prompt, {', '.join('t.' + f.column for f in I.FIELDS)}
FROM ({GP.ORACLE['gen_v2']}) g JOIN ({typed_sql('known')}) t ON g.intent_id = t.intent_id WHERE t.reject IS NULL""",
}
