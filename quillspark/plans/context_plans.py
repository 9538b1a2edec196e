"""Context matching, enrichment, outcome counts and prompt assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import WS
from ..operators import context as C
from ..operators import generate as G
from . import generate_plans as GP
from .generate_plans import case_map, fill, lst, q


def v3_rows(spark, sf):
    v3 = G.gen_v3(GP.clean(spark, sf))
    return v3.select(F.concat_ws("_", F.col("intent_id").cast("string"), F.col("slot").cast("string")).alias("synthetic_prompt_id"),
                     "intent_id", "slot", "action", "object", "scenario", "synthetic_prompt", "context_text",
                     F.when(F.col("has_context_text"), F.lit("Yes")).otherwise(F.lit("")).alias("has_context_text"))


def docs(spark):
    return C.load_catalog(C.merge_catalogs(C.catalog_frame(spark)))


def q_context_match(spark, sf):
    m = C.match_documents(v3_rows(spark, sf), docs(spark))
    return m.select("intent_id", "slot", "doc_id", "doc_url", "doc_score")


def enriched(spark, sf):
    return C.enrich(v3_rows(spark, sf), docs(spark))


def q_context_enrich(spark, sf):
    return enriched(spark, sf).select("intent_id", "slot", "context_source_type", "context_url", "context_text",
                                      "has_context_text")


def q_context_stats(spark, sf):
    return C.context_stats(enriched(spark, sf))


def q_build_prompt(spark, sf):
    b = C.build_prompt(enriched(spark, sf))
    return b.select("intent_id", "slot", "prompt_agent", "prompt_typed", "prompt_api", "prompt_sent", "prompt_copy",
                    "prompt_length")


QUERIES = {
    "context_match": q_context_match,
    "context_enrich": q_context_enrich,
    "context_stats": q_context_stats,
    "build_prompt": q_build_prompt,
}


# ---------------------------------------------------------------------------
# Oracle SQL
# ---------------------------------------------------------------------------

def merged_catalog_py():
    """Dict-update semantics written out for the oracle side."""
    out = {}
    first = {}
    for pos, (g, k, u, d, t, dt, ind) in enumerate(C.CATALOG):
        first.setdefault(k, pos)
        out[k] = dict(doc_id=k, url=u, description=d, topics=t, document_type=dt, industry=ind)
    return [out[k] for k, _ in sorted(first.items(), key=lambda x: x[1])]


def v3_sql():
    body = GP.gen_v3_sql()
    body = body.replace("\nSELECT intent_id, slot, ", ",\nv3 AS (SELECT intent_id, slot, a AS action, o AS object, ", 1)
    return body + """),
rows AS (SELECT CAST(intent_id AS VARCHAR) || '_' || CAST(slot AS VARCHAR) AS synthetic_prompt_id, intent_id, slot, action, object,
  scenario, synthetic_prompt, context_text, CASE WHEN has_context_text THEN 'Yes' ELSE '' END AS has_context_text FROM v3)"""


def score_sql(d: dict) -> str:
    parts = ["0"]
    for t in d["topics"]:
        tl = t.lower().replace("_", " ")
        parts.append(f"(CASE WHEN contains(_h, {q(tl)}) THEN {C.TOPIC_HIT} ELSE 0 END)")
        for w in tl.split():
            if len(w) > 3:
                parts.append(f"(CASE WHEN contains(_h, {q(w)}) THEN {C.TOPIC_WORD} ELSE 0 END)")
    ind = d["industry"].lower()
    if ind:
        parts.append(f"(CASE WHEN contains(_h, {q(ind)}) THEN {C.INDUSTRY_HIT} ELSE 0 END)")
    parts.append(f"len(list_filter(_w, lambda w: length(w) > 4 AND contains({q(d['description'].lower())}, w))) * {C.DESC_WORD}")
    for acts, types, pts in C.ACTION_BOOSTS:
        if d["document_type"] in types:
            parts.append(f"(CASE WHEN upper(action) IN ({', '.join(q(a) for a in acts)}) THEN {pts} ELSE 0 END)")
    for kws, types, pts in C.SCENARIO_BOOSTS:
        if d["document_type"] in types:
            cond = " OR ".join(f"contains(lower(coalesce(scenario, '')), {q(k)})" for k in kws)
            parts.append(f"(CASE WHEN {cond} THEN {pts} ELSE 0 END)")
    return " + ".join(parts)


def match_sql() -> str:
    ds = merged_catalog_py()
    items = ", ".join("{" + f"'score': {score_sql(d)}, 'neg_ord': {-i}, 'doc_id': {q(d['doc_id'])}, 'url': {q(d['url'])}, "
                      f"'description': {q(d['description'])}, 'document_type': {q(d['document_type'])}, 'industry': {q(d['industry'])}" + "}"
                      for i, d in enumerate(ds))
    return v3_sql() + f""",
h AS (SELECT *, lower(concat_ws(' ', action, object, scenario, synthetic_prompt)) AS _h FROM rows),
hw AS (SELECT *, list_filter(regexp_split_to_array(_h, '{WS}'), lambda w: w <> '') AS _w FROM h),
b AS (SELECT *, list_max([{items}]) AS _best FROM hw),
m AS (SELECT *, CASE WHEN _best.score >= {C.MIN_SCORE} THEN _best END AS _doc FROM b)"""


def title_sql(x):
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


def enrich_sql() -> str:
    ua = "upper(action)"
    wants = f"({ua} IN ({', '.join(q(a) for a in C.CONTEXT_REQUIRED)}) OR {ua} IN ({', '.join(q(a) for a in C.CONTEXT_HELPFUL)}))"
    existing = f"length(coalesce(context_text, '')) > {C.EXISTING_MIN}"
    ref = fill(q(C.REFERENCE_TEMPLATE), {"description": "_doc.description",
                                         "doc_type": title_sql("replace(_doc.document_type, '_', ' ')"),
                                         "industry": title_sql("_doc.industry"), "url": "_doc.url"})
    kind = "CASE " + " ".join(f"WHEN {ua} IN ({', '.join(q(a) for a in acts)}) THEN {q(k)}" for acts, k in C.GENERATED_KINDS) + \
        f" ELSE {q(C.GENERATED_DEFAULT)} END"
    seed = "('0x' || substr(md5(concat_ws('|', synthetic_prompt_id, left(synthetic_prompt, 50))), 1, 8))::BIGINT"
    company = f"{lst(C.COMPANIES)}[({seed} % {len(C.COMPANIES)}) + 1]"
    gen = fill(case_map(kind, {k: q(v) for k, v in C.GENERATED_BODIES.items()}, "NULL"),
               {"obj": "lower(object)", "scenario": "replace(scenario, '_', ' ')", "company": company})
    return match_sql() + f""",
s AS (SELECT *, CASE WHEN {existing} THEN 'existing_synthetic' WHEN {wants} AND _doc IS NOT NULL THEN 'public_document'
  WHEN {wants} THEN 'generated_synthetic' ELSE 'none_required' END AS context_source_type FROM m),
e AS (SELECT intent_id, slot, synthetic_prompt, context_source_type,
  CASE WHEN context_source_type = 'public_document' THEN _doc.url ELSE '' END AS context_url,
  CASE WHEN context_source_type = 'public_document' THEN {ref} WHEN context_source_type = 'generated_synthetic' THEN {gen}
       ELSE context_text END AS context_text,
  CASE WHEN context_source_type IN ('public_document', 'generated_synthetic') THEN 'Yes'
       WHEN context_source_type = 'none_required' THEN CASE WHEN coalesce(has_context_text, '') = '' THEN 'No' ELSE has_context_text END
       ELSE has_context_text END AS has_context_text FROM s)"""


def build_sql() -> str:
    nl = "chr(10)"
    u, t, p = "coalesce(context_url, '')", "coalesce(context_text, '')", "synthetic_prompt"
    actx = f"(CASE WHEN {u} <> '' THEN 'Reference document: ' || {u} ELSE {t} END)"
    agent = (f"CASE WHEN length({actx}) > 100 THEN 'Context/Reference Document:' || {nl} || left({actx}, 4000) || {nl} || {nl} || '---' || {nl} || {nl} || 'User Request:' || {nl} || {p} "
             f"WHEN {actx} <> '' THEN {p} || {nl} || {nl} || 'Reference: ' || {actx} ELSE {p} END")
    api_ctx = f"(CASE WHEN {u} <> '' THEN 'Reference document: ' || {u} ELSE left({t}, 2000) END)"
    api = f"CASE WHEN {api_ctx} <> '' THEN {api_ctx} || {nl} || {nl} || {p} ELSE {p} END"
    audit_ctx = f"(CASE WHEN {u} <> '' THEN 'Reference: ' || {u} WHEN length({t}) > 50 THEN left({t}, 1500) ELSE '' END)"
    audit = f"left(CASE WHEN {audit_ctx} <> '' THEN 'Context: ' || {audit_ctx} || {nl} || {nl} || '---' || {nl} || {nl} || {p} ELSE {p} END, 2000)"
    copy_ = (f"CASE WHEN {u} <> '' THEN 'Reference Document: ' || {u} || {nl} || {nl} || {p} "
             f"WHEN {t} <> '' THEN 'Context:' || {nl} || left({t}, 2000) || {nl} || {nl} || '---' || {nl} || {nl} || 'User Request:' || {nl} || {p} ELSE {p} END")
    return enrich_sql() + f"""
SELECT intent_id, slot, {agent} AS prompt_agent, left({agent}, 2000) AS prompt_typed, {api} AS prompt_api,
  {audit} AS prompt_sent, {copy_} AS prompt_copy, length({audit})::BIGINT AS prompt_length FROM e"""


ORACLE = {
    "context_match": match_sql() + """
SELECT intent_id, slot, _doc.doc_id AS doc_id, _doc.url AS doc_url, _doc.score::BIGINT AS doc_score FROM m""",
    "context_enrich": enrich_sql() + """
SELECT intent_id, slot, context_source_type, context_url, context_text, has_context_text FROM e""",
    "context_stats": enrich_sql() + """
SELECT context_source_type AS metric, count(*)::BIGINT AS value FROM e GROUP BY 1
UNION ALL SELECT 'total_processed', count(*)::BIGINT FROM e""",
    "build_prompt": build_sql(),
}
