"""Scalar helpers on documents, capability rubric lines, generation manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import templates as TP
from .. import vocab as V
from ..functions.text import char_count
from ..operators import collect as CO
from ..operators import generate as G
from ..operators import label as L
from ..sources import fixtures as FX
from . import generate_plans as GP
from . import sqlgen as S
from .sqlgen import q

RUN_TS = "2026-01-06 10:20:30"


def q_scalar_misc(spark, sf):
    d = FX.documents(spark, sf)
    ts = F.lit(RUN_TS).cast("timestamp")
    return d.select(
        "doc_id",
        CO.in_progress(F.col("text")).alias("in_progress"),
        F.date_format(ts, "yyyy-MM-dd").alias("run_date"),
        F.date_format(ts, "yyyyMMdd_HHmmss").alias("run_stamp"),
        F.greatest(F.lit(1), F.least(F.lit(5), (F.col("n_chars") / 1000).cast("bigint"))).cast("bigint").alias("size_score"),
        F.round(F.least(F.lit(1.0), char_count(F.col("text"), ".") / 5.0), 2).alias("period_ratio"),
        F.to_json(F.struct("doc_id", "lang", "source")).alias("record_json"),
        F.to_json(F.create_map(F.lit("long"), F.col("n_chars") > 5000, F.lit("has_text"), F.col("n_chars") > 0)).alias("flags_json"),
    )


def capability_rubric(labelled):
    """Extra criteria per capability a prompt needs (long form, expanded
    in-row from the label flags; no join)."""
    items = F.array(*[F.struct(F.lit(cap).alias("capability"), F.col(flag).alias("on"),
                               F.to_json(F.array(*[F.lit(c) for c in crit])).alias("criteria"))
                      for cap, flag, crit in TP.CAPABILITY_CRITERIA])
    on = F.filter(items, lambda x: x["on"])
    return labelled.select("doc_id", F.explode(on).alias("c")).select("doc_id", "c.capability", "c.criteria")


def q_rubric_capabilities(spark, sf):
    d = L.with_lower(FX.documents(spark, sf).select("doc_id", F.col("text").alias("prompt_text")), "prompt_text")
    d = L.label_capabilities(d, V.CORPUS_FLAGS)
    return capability_rubric(d)


def q_gen_manifest(spark, sf):
    v3 = G.gen_v3(GP.clean(spark, sf))
    return v3.agg(F.count_distinct("intent_id").cast("bigint").alias("intents"),
                  F.count(F.lit(1)).cast("bigint").alias("prompts"),
                  F.count_if(F.col("has_context_text")).cast("bigint").alias("prompts_with_context")) \
             .withColumn("estimated_prompts", F.col("intents") * len(TP.SLOT_LAYOUT))


QUERIES = {
    "scalar_misc": q_scalar_misc,
    "rubric_capabilities": q_rubric_capabilities,
    "gen_manifest": q_gen_manifest,
}


def _scalar_sql():
    prog = " OR ".join(f"contains(right(text, 100), {q(m)})" for m in CO.LOADING_MARKERS)
    return f"""SELECT doc_id, ({prog}) AS in_progress,
  strftime(TIMESTAMP '{RUN_TS}', '%Y-%m-%d') AS run_date, strftime(TIMESTAMP '{RUN_TS}', '%Y%m%d_%H%M%S') AS run_stamp,
  greatest(1, least(5, CAST(trunc(n_chars / 1000) AS BIGINT)))::BIGINT AS size_score,
  round(least(1.0, {S.char_count('text', '.')} / 5.0), 2) AS period_ratio,
  to_json({{'doc_id': doc_id, 'lang': lang, 'source': source}})::VARCHAR AS record_json,
  to_json(MAP {{'long': n_chars > 5000, 'has_text': n_chars > 0}})::VARCHAR AS flags_json
FROM documents"""


def _caprubric_sql():
    flags = {name: S.any_("lower(text)", kws) for name, kws in V.CORPUS_FLAGS}
    items = ", ".join("{" + f"'capability': {q(cap)}, 'on': {flags[flag]}, 'criteria': {q(__import__('json').dumps(crit, separators=(',', ':')))}" + "}"
                      for cap, flag, crit in TP.CAPABILITY_CRITERIA)
    return f"""WITH l AS (SELECT doc_id, list_filter([{items}], lambda x: x.on) AS l FROM documents),
u AS (SELECT doc_id, unnest(l) AS c FROM l)
SELECT doc_id, c.capability AS capability, c.criteria AS criteria FROM u"""


ORACLE = {
    "scalar_misc": _scalar_sql(),
    "rubric_capabilities": _caprubric_sql(),
    "gen_manifest": GP.gen_v3_sql().replace("\nSELECT intent_id, slot, ", ",\nv3 AS (SELECT intent_id, slot, ", 1) + """)
SELECT count(DISTINCT intent_id)::BIGINT AS intents, count(*)::BIGINT AS prompts,
  count(*) FILTER (WHERE has_context_text)::BIGINT AS prompts_with_context, (count(DISTINCT intent_id) * 10)::BIGINT AS estimated_prompts FROM v3""",
}
