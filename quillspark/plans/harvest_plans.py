"""Named harvest and labelling queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab as V
from ..operators import harvest as HV
from ..operators import label as L
from ..functions import text as T
from ..sources import fixtures as FX
from . import sqlgen as S

PER_SOURCE = 250  # reference per-source cap (the first-N feature itself)
RUN_DATE = "2026-01-06"

LABEL_COLS = (["prompt_id", "date_harvested", "source", "prompt_text", "prompt_length", "language",
               "primary_intent", "subcategory", "intent_confidence",
               "difficulty_level", "difficulty_score", "difficulty_reasons",
               "is_microsoft_related", "microsoft_products", "microsoft_product_codes"]
              + [c for c, _ in V.CAPABILITIES_FULL]
              + ["expected_response_length"] + [c for c, _ in V.EXPECTED_RESPONSE_FLAGS]
              + HV.EVAL_COLUMNS)


def q_harvest_prompts(spark, sf):
    h = HV.harvest_prompts(FX.raw_prompts(spark, sf), per_source_limit=PER_SOURCE)
    return h.select("prompt_id", "source", "seq", "prompt_text", "prompt_length")


def harvest_labelled_df(spark, sf):
    h = HV.harvest_prompts(FX.raw_prompts(spark, sf))
    lab = HV.add_eval_columns(HV.label_prompts(h, mode="full", run_date=RUN_DATE))
    return lab.withColumn("date_harvested", F.date_format("date_harvested", "yyyy-MM-dd")).select(*LABEL_COLS)


def q_harvest_labelled(spark, sf):
    return harvest_labelled_df(spark, sf)


PER_SOURCE_LITE = 300  # lite per-source cap (the first-N feature itself)
LITE_COLS = (["prompt_id", "date_harvested", "source", "prompt_text", "prompt_length", "language",
              "primary_intent", "intent_confidence", "difficulty_level", "difficulty_score", "difficulty_reasons",
              "is_microsoft_related", "microsoft_products"] + [c for c, _ in V.CAPABILITIES_LITE] + HV.EVAL_COLUMNS)


def q_harvest_lite(spark, sf):
    h = HV.harvest_prompts(FX.raw_prompts(spark, sf), per_source_limit=PER_SOURCE_LITE, mode="lite")
    lab = HV.add_eval_columns(HV.label_prompts(h, mode="lite", run_date=RUN_DATE))
    return lab.withColumn("date_harvested", F.date_format("date_harvested", "yyyy-MM-dd")).select(*LITE_COLS)


def q_harvest_lite_summary(spark, sf):
    return HV.harvest_summary(q_harvest_lite(spark, sf), mode="lite")


def q_harvest_summary(spark, sf):
    return HV.harvest_summary(harvest_labelled_df(spark, sf))


def _docs_lower(spark, sf):
    d = FX.documents(spark, sf).select("doc_id", "text")
    return L.with_lower(d, "text")


def q_intent_full(spark, sf):
    d = L.label_intent(_docs_lower(spark, sf), V.CORPUS_INTENTS)
    return d.select("doc_id", "primary_intent", "subcategory", "intent_confidence")


def q_intent_lite(spark, sf):
    d = L.label_intent(_docs_lower(spark, sf), V.INTENT_LITE, subcategory=False)
    return d.select("doc_id", "primary_intent", "intent_confidence")


def q_intent_rules(spark, sf):
    return L.label_intent_rules(_docs_lower(spark, sf)).select("doc_id", "intent")


def q_difficulty_full(spark, sf):
    d = L.label_difficulty(_docs_lower(spark, sf), V.DIFFICULTY_FULL, text="text")
    return d.select("doc_id", "difficulty_score", "difficulty_level", "difficulty_reasons")


def q_difficulty_lite(spark, sf):
    d = L.label_difficulty(_docs_lower(spark, sf), V.DIFFICULTY_LITE, text="text")
    return d.select("doc_id", "difficulty_score", "difficulty_level", "difficulty_reasons")


def q_products(spark, sf):
    d = L.label_products(_docs_lower(spark, sf))
    return d.select("doc_id", "is_microsoft_related", "microsoft_products", "microsoft_product_codes")


def q_capabilities(spark, sf):
    d = L.label_capabilities(_docs_lower(spark, sf))
    return d.select("doc_id", *[c for c, _ in V.CAPABILITIES_FULL])


def q_expected_response(spark, sf):
    d = L.label_difficulty(_docs_lower(spark, sf), V.DIFFICULTY_FULL, text="text")
    d = L.label_expected_response(d)
    return d.select("doc_id", "expected_response_length", *[c for c, _ in V.EXPECTED_RESPONSE_FLAGS])


def q_language_cascade(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", "lang", L.language_expr("text", "cascade").alias("language"))


def q_language_lite(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", L.language_expr("text", "lite").alias("language"))


def q_prompt_key(spark, sf):
    d = FX.documents(spark, sf)
    return d.select("doc_id", T.norm_key("text").alias("prompt_key"), F.md5(F.lower("text")).alias("text_md5"))


def q_dedup_report(spark, sf):
    return HV.dedup_report(FX.raw_prompts(spark, sf))


def q_first_turn_prompts(spark, sf):
    return HV.first_turn_prompts(spark.read.parquet(f"{sf}/conversations.parquet"))


def q_incremental_append(spark, sf):
    d = FX.documents(spark, sf).select(F.col("doc_id").alias("seq"), "text", F.col("lang").alias("language"))
    return HV.incremental_append(d.filter(F.col("seq") % 2 == 1), d.filter(F.col("seq") % 2 == 0))


QUERIES = {
    "harvest_lite": q_harvest_lite,
    "prompt_key": q_prompt_key,
    "dedup_report": q_dedup_report,
    "first_turn_prompts": q_first_turn_prompts,
    "incremental_append": q_incremental_append,
    "harvest_prompts": q_harvest_prompts,
    "harvest_labelled": q_harvest_labelled,
    "harvest_summary": q_harvest_summary,
    "harvest_lite_summary": q_harvest_lite_summary,
    "intent_full": q_intent_full,
    "intent_lite": q_intent_lite,
    "intent_rules": q_intent_rules,
    "difficulty_full": q_difficulty_full,
    "difficulty_lite": q_difficulty_lite,
    "products": q_products,
    "capabilities": q_capabilities,
    "expected_response": q_expected_response,
    "language_cascade": q_language_cascade,
    "language_lite": q_language_lite,
}

# ---------------------------------------------------------------------------
# Oracle SQL (DuckDB)
# ---------------------------------------------------------------------------


def _harvest_sql(limit: int | None) -> str:
    lim = (f", s3 AS (SELECT * FROM s2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq) <= {limit})"
           if limit else ", s3 AS (SELECT * FROM s2)")
    return f"""WITH raw AS ({S.RAW_PROMPTS}),
b1 AS (SELECT source, source_ord, seq, language, {S.strip('text')} AS prompt_text FROM raw),
b2 AS (SELECT *, length(prompt_text)::BIGINT AS prompt_length, {S.norm_key('prompt_text', 32)} AS k, substr(k, 1, 12) AS prompt_id FROM b1),
s1 AS (SELECT * FROM b2 WHERE prompt_length >= 15
       QUALIFY row_number() OVER (PARTITION BY source, k ORDER BY seq) = 1),
s2 AS (SELECT * FROM s1 WHERE prompt_length <= 5000){lim},
s4 AS (SELECT * FROM s3 QUALIFY row_number() OVER (PARTITION BY k ORDER BY source_ord, seq) = 1)"""


def _labelled_sql() -> str:
    lt = "lt"
    cols = ["prompt_id", f"'{RUN_DATE}' AS date_harvested", "source", "prompt_text", "prompt_length",
            f"coalesce(nullif(language, ''), {S.language('prompt_text')}) AS language"]
    cols += S.intent_cols("_intent")
    cols += ["difficulty_level", "difficulty_score", "difficulty_reasons"]
    cols += S.products_cols(lt)
    cols += S.flag_cols(lt, V.CAPABILITIES_FULL)
    cols += S.expected_cols(lt)
    cols += [f"NULL::VARCHAR AS {c}" for c in HV.EVAL_COLUMNS]
    return (_harvest_sql(None) + f""",
l1 AS (SELECT *, lower(prompt_text) AS lt FROM s4),
l2 AS (SELECT *, {S.intent_struct(lt, V.INTENT_FULL)} AS _intent, {', '.join(S.difficulty_cols('prompt_text', lt))} FROM l1)
SELECT {', '.join(cols)} FROM l2""")


def _summary_sql(body: str, mean_length: str = "round(avg(prompt_length), 0)") -> str:
    caps = [c for c, _ in V.CAPABILITIES_FULL]
    return f"""WITH lab AS ({body}),
by_src AS (SELECT 'by_source' AS metric, source AS key, count(*)::DOUBLE AS value FROM lab GROUP BY source),
by_int AS (SELECT 'by_intent' AS metric, primary_intent AS key, count(*)::DOUBLE AS value FROM lab GROUP BY primary_intent),
by_lvl AS (SELECT 'by_difficulty' AS metric, difficulty_level AS key, count(*)::DOUBLE AS value FROM lab GROUP BY difficulty_level),
by_lang AS (SELECT 'by_language' AS metric, language AS key, count(*)::DOUBLE AS value FROM lab GROUP BY language
            ORDER BY value DESC, key ASC LIMIT 10),
tot AS (SELECT count(*)::DOUBLE AS total_prompts, sum(is_microsoft_related::INT)::DOUBLE AS microsoft_related_count,
  round(avg(is_microsoft_related::INT) * 100, 2)::DOUBLE AS microsoft_related_percentage,
  {', '.join(f"sum({c}::INT)::DOUBLE AS {c.replace('requires_', 'cap_')}" for c in caps)},
  {mean_length}::DOUBLE AS avg_prompt_length, round(avg(difficulty_score), 2)::DOUBLE AS avg_difficulty_score
  FROM lab),
scal AS (UNPIVOT tot ON COLUMNS(*) INTO NAME metric VALUE value)
SELECT * FROM by_src UNION ALL SELECT * FROM by_int UNION ALL SELECT * FROM by_lvl UNION ALL SELECT * FROM by_lang
UNION ALL SELECT metric, NULL::VARCHAR AS key, value::DOUBLE AS value FROM scal"""


def _docs(extra_cols: list[str], spec_cols: str = "") -> str:
    return f"SELECT doc_id, {', '.join(extra_cols)} FROM (SELECT doc_id, text, lower(text) AS lt{spec_cols} FROM documents)"


DEDUP_REPORT_SQL = f"""WITH raw AS ({S.RAW_PROMPTS}),
n AS (SELECT source, source_ord, seq, length(p)::BIGINT AS len, {S.norm_key('p', 32)} AS k
      FROM (SELECT *, {S.strip('text')} AS p FROM raw)),
rd AS (SELECT source, count(*) AS n_read, count(*) FILTER (WHERE coalesce(len, 0) < 15) AS n_short FROM n GROUP BY source),
w1 AS (SELECT * FROM n WHERE len >= 15 QUALIFY row_number() OVER (PARTITION BY source, k ORDER BY seq) = 1),
fs AS (SELECT source, count(*) AS n_first, count(*) FILTER (WHERE len > 5000) AS n_long FROM w1 GROUP BY source),
w2 AS (SELECT * FROM w1 WHERE len <= 5000 QUALIFY row_number() OVER (PARTITION BY k ORDER BY source_ord, seq) = 1),
kp AS (SELECT source, count(*) AS n_kept FROM w2 GROUP BY source)
SELECT rd.source, n_read::BIGINT AS n_read, n_short::BIGINT AS n_short,
  (n_read - n_short - coalesce(n_first, 0))::BIGINT AS n_copy_in_source, coalesce(n_long, 0)::BIGINT AS n_long,
  (coalesce(n_first, 0) - coalesce(n_long, 0) - coalesce(n_kept, 0))::BIGINT AS n_copy_across, coalesce(n_kept, 0)::BIGINT AS n_kept
FROM rd LEFT JOIN fs USING (source) LEFT JOIN kp USING (source)"""

FIRST_TURN_SQL = f"""WITH f AS (
  SELECT conv_id, arg_min({{'role': role, 'text': text}}, turn) AS first,
         arg_min(text, turn) FILTER (WHERE role = 'user') AS user_text
  FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, first.role AS first_role,
  {S.strip("CASE WHEN first.role = 'system' AND length(" + S.strip('first.text') + ") > 5 THEN user_text || chr(10) || chr(10) || 'Context: ' || " + S.strip('first.text') + " ELSE user_text END")} AS prompt_text FROM f)
SELECT conv_id, first_role, prompt_text, length(prompt_text)::BIGINT AS prompt_length FROM p WHERE length(prompt_text) > 10"""

INCREMENTAL_SQL = f"""WITH d AS (SELECT doc_id AS seq, {S.strip('text')} AS Prompt, lang AS Language FROM documents),
inc AS (SELECT * FROM d WHERE seq % 2 = 1 AND length(Prompt) > 10),
have AS (SELECT DISTINCT Prompt FROM d WHERE seq % 2 = 0),
firsts AS (SELECT * FROM inc QUALIFY row_number() OVER (PARTITION BY Prompt ORDER BY seq) = 1),
new AS (SELECT * FROM firsts WHERE Prompt NOT IN (SELECT Prompt FROM have WHERE Prompt IS NOT NULL))
SELECT '{RUN_DATE}' AS "Date Added", 'LMSYS_Arena' AS "Source", {S.intent_rules('lower(Prompt)')} AS "Intent", Prompt,
  coalesce(Language, 'unknown') AS Language, seq FROM new"""

def _lite_sql() -> str:
    lt = "lt"
    cols = ["prompt_id", f"'{RUN_DATE}' AS date_harvested", "source", "prompt_text", "prompt_length",
            f"{S.language('prompt_text', 'lite')} AS language"]
    cols += S.intent_cols("_intent", subcategory=False)
    cols += ["difficulty_level", "difficulty_score", "difficulty_reasons"]
    cols += S.products_cols(lt, V.PRODUCTS_LITE, codes=False)
    cols += S.flag_cols(lt, V.CAPABILITIES_LITE)
    cols += [f"NULL::VARCHAR AS {c}" for c in HV.EVAL_COLUMNS]
    return f"""WITH raw AS ({S.RAW_PROMPTS}),
b1 AS (SELECT source, source_ord, seq, {S.strip('text')} AS prompt_text, {S.norm_key('text', 32)} AS k, substr(k, 1, 12) AS prompt_id FROM raw),
b2 AS (SELECT *, length(prompt_text)::BIGINT AS prompt_length FROM b1),
s1 AS (SELECT * FROM b2 WHERE prompt_length >= 1
       QUALIFY row_number() OVER (PARTITION BY source, k ORDER BY seq) = 1),
s2 AS (SELECT * FROM s1 WHERE prompt_length BETWEEN 15 AND 5000),
s3 AS (SELECT * FROM s2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq) <= {PER_SOURCE_LITE}),
s4 AS (SELECT * FROM s3 QUALIFY row_number() OVER (PARTITION BY k ORDER BY source_ord, seq) = 1),
l1 AS (SELECT *, lower(prompt_text) AS lt FROM s4),
l2 AS (SELECT *, {S.intent_struct(lt, V.INTENT_LITE)} AS _intent, {', '.join(S.difficulty_cols('prompt_text', lt, V.DIFFICULTY_LITE))} FROM l1)
SELECT {', '.join(cols)} FROM l2"""


ORACLE = {
    "harvest_lite": _lite_sql(),
    "prompt_key": f"SELECT doc_id, {S.norm_key('text')} AS prompt_key, md5(lower(text)) AS text_md5 FROM documents",
    "dedup_report": DEDUP_REPORT_SQL,
    "first_turn_prompts": FIRST_TURN_SQL,
    "incremental_append": INCREMENTAL_SQL,
    "harvest_prompts": _harvest_sql(PER_SOURCE) + " SELECT prompt_id, source, seq, prompt_text, prompt_length FROM s4",
    "harvest_labelled": _labelled_sql(),
    "harvest_summary": _summary_sql(_labelled_sql()),
    "harvest_lite_summary": _summary_sql(_lite_sql(), "floor(avg(prompt_length))"),
    "intent_full": f"SELECT doc_id, {', '.join(S.intent_cols('_i'))} FROM (SELECT doc_id, {S.intent_struct('lower(text)', V.CORPUS_INTENTS)} AS _i FROM documents)",
    "intent_lite": f"SELECT doc_id, {', '.join(S.intent_cols('_i', subcategory=False))} FROM (SELECT doc_id, {S.intent_struct('lower(text)', V.INTENT_LITE)} AS _i FROM documents)",
    "intent_rules": f"SELECT doc_id, {S.intent_rules('lower(text)')} AS intent FROM documents",
    "difficulty_full": f"SELECT doc_id, {', '.join(S.difficulty_cols('text', 'lower(text)', V.DIFFICULTY_FULL))} FROM documents",
    "difficulty_lite": f"SELECT doc_id, {', '.join(S.difficulty_cols('text', 'lower(text)', V.DIFFICULTY_LITE))} FROM documents",
    "products": f"SELECT doc_id, {', '.join(S.products_cols('lower(text)'))} FROM documents",
    "capabilities": f"SELECT doc_id, {', '.join(S.flag_cols('lower(text)', V.CAPABILITIES_FULL))} FROM documents",
    "expected_response": f"SELECT doc_id, {', '.join(S.expected_cols('lower(text)'))} FROM (SELECT doc_id, text, {S.difficulty_cols('text', 'lower(text)', V.DIFFICULTY_FULL)[0]} FROM documents)",
    "language_cascade": f"SELECT doc_id, lang, {S.language('text', 'cascade')} AS language FROM documents",
    "language_lite": f"SELECT doc_id, {S.language('text', 'lite')} AS language FROM documents",
}
