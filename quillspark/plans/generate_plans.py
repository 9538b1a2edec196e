"""Named intent / generation queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import templates as TP
from ..functions.text import WS
from ..operators import generate as G
from ..sources import fixtures as FX
from . import sqlgen as S
from .sqlgen import q

TYPED_COLS = (["intent_id"] + G.TEXT_COLS + G.INT_COLS + G.FLOAT_COLS + G.BOOL_COLS
              + ["sat_rate_value", "pct_users_value", "user_count_value"])


def typed(spark, sf):
    return G.typed_intents(FX.intents_text(spark, sf))


def clean(spark, sf):
    return typed(spark, sf).filter(F.col("_reject").isNull()).drop("_reject")


def q_intents_clean(spark, sf):
    return clean(spark, sf).select(*TYPED_COLS)


def q_intents_rejects(spark, sf):
    return typed(spark, sf).filter(F.col("_reject").isNotNull()).select("intent_id", F.col("_reject").alias("reason"))


def q_intent_analysis(spark, sf):
    return G.analyze_intents(clean(spark, sf))


def q_action_distribution(spark, sf):
    return G.action_distribution(G.analyze_intents(clean(spark, sf)))


def q_request_text(spark, sf):
    return G.request_text(clean(spark, sf))


FIRST_INTENTS = 200


def q_request_first(spark, sf):
    """Requests of the first intents only (the cap is the feature)."""
    return G.request_text(clean(spark, sf), max_intents=FIRST_INTENTS)


def q_gen_v1(spark, sf):
    return G.gen_v1(clean(spark, sf))


def q_gen_v2(spark, sf):
    return G.gen_v2(clean(spark, sf))


def q_gen_v2_dedup(spark, sf):
    return G.gen_v2_dedup(clean(spark, sf))


def q_gen_v3(spark, sf):
    return G.gen_v3(clean(spark, sf)).drop("action", "object")


def q_gen_offline(spark, sf):
    return G.gen_offline(clean(spark, sf))


def q_rubric(spark, sf):
    base = G.generation_base(clean(spark, sf))
    df = base.withColumn("_s", F.explode(G._slots())).select("*", "_s.*").drop("_s") \
             .withColumnRenamed("variant", "prompt_variant_type")
    return G.rubric(df).select("intent_id", "slot", "prompt_variant_type", "expected_response_criteria",
                               "evaluation_dimensions", "criteria_count", "action_type_criterion", "action_type_criteria")


def q_scenario_rubric(spark, sf):
    return G.scenario_rubric(G.gen_v3(clean(spark, sf))).select("intent_id", "slot", "scenario", "has_context_text",
                                                                "expected_response_criteria", "evaluation_dimensions")


def q_gen_conformance(spark, sf):
    return G.conformance(G.gen_v2(clean(spark, sf), ids=False))


SAMPLE_POSITIONS = (1, 5, 10, 100, 500)


def q_gen_summary(spark, sf):
    g = G.gen_v2(clean(spark, sf)).withColumn("_pos", F.expr("substring(synthetic_prompt_id, 4)").cast("bigint"))
    return G.gen_summary(g, sample_positions=SAMPLE_POSITIONS)


def q_variety_pick(spark, sf):
    return G.variety_pick(clean(spark, sf), TP.V3_VALUES["project"], "project")


QUERIES = {
    "intents_clean": q_intents_clean,
    "intents_rejects": q_intents_rejects,
    "intent_analysis": q_intent_analysis,
    "action_distribution": q_action_distribution,
    "request_text": q_request_text,
    "request_first": q_request_first,
    "gen_v1": q_gen_v1,
    "gen_v2": q_gen_v2,
    "gen_v2_dedup": q_gen_v2_dedup,
    "gen_v3": q_gen_v3,
    "gen_offline": q_gen_offline,
    "rubric": q_rubric,
    "scenario_rubric": q_scenario_rubric,
    "gen_conformance": q_gen_conformance,
    "gen_summary": q_gen_summary,
    "variety_pick": q_variety_pick,
}

# ---------------------------------------------------------------------------
# Oracle SQL
# ---------------------------------------------------------------------------


def strip(x):
    return S.strip(x)


def lst(xs):
    return "[" + ", ".join(q(x) for x in xs) + "]"


def pick(arr: str, idx: str) -> str:
    return f"({arr})[(({idx}) % len({arr})) + 1]"


def fill(t: str, values: dict) -> str:
    for k, v in values.items():
        t = f"replace({t}, {q('{' + k + '}')}, {v})"
    return t


def case_map(key: str, mapping: dict, default: str) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in mapping.items()) + f" ELSE {default} END"


def typed_sql() -> str:
    cols = []
    checks = []
    for c in G.INT_COLS:
        s = f"coalesce({strip(c)}, '')"
        cols.append(f"CASE WHEN {s} = '' THEN 0 ELSE TRY_CAST({s} AS BIGINT) END::BIGINT AS {c}")
        checks.append(f"CASE WHEN NOT ({s} = '' OR regexp_full_match({s}, '[+-]?[0-9]+')) THEN 'bad {c}' END")
    for c in G.FLOAT_COLS:
        s = f"coalesce({strip(c)}, '')"
        cols.append(f"CASE WHEN {s} = '' THEN 1.0 ELSE TRY_CAST({s} AS DOUBLE) END::DOUBLE AS {c}")
        checks.append(f"CASE WHEN {s} <> '' AND TRY_CAST({s} AS DOUBLE) IS NULL THEN 'bad {c}' END")
    for c in G.BOOL_COLS:
        cols.append(f"upper(coalesce({c}, 'FALSE')) = 'TRUE' AS {c}")
    for c in G.TEXT_COLS:
        cols.append(f"coalesce({strip(c)}, '') AS {c}")
    a, o = f"coalesce({strip('action')}, '')", f"coalesce({strip('object')}, '')"
    valid = f"({a} <> '' AND {o} <> '' AND {a} <> '?' AND {o} <> '?')"
    rej = f"CASE WHEN NOT {valid} THEN 'missing action or object' ELSE coalesce({', '.join(checks)}) END AS _reject"

    def pct(x):
        num = f"TRY_CAST(regexp_replace({x}, '[%,\\s]', '', 'g') AS DOUBLE)"
        return f"CASE WHEN contains({x}, '%') THEN {num} / 100 ELSE {num} END"
    return f"""typed0 AS (SELECT intent_id, {', '.join(cols)}, {rej} FROM ({FX.INTENTS_TEXT_SQL})),
typed AS (SELECT *, {pct('sat_rate')} AS sat_rate_value, {pct('pct_users')} AS pct_users_value,
  TRY_CAST(regexp_replace(user_count, '[,\\s]', '', 'g') AS BIGINT) AS user_count_value FROM typed0),
clean AS (SELECT * EXCLUDE (_reject) FROM typed WHERE _reject IS NULL)"""


def cv(x):
    s = f"coalesce({strip(x)}, '')"
    return f"CASE WHEN {s} IN ({', '.join(q(v) for v in TP.PLACEHOLDER_VALUES)}) THEN '' ELSE {s} END"


def base_sql(containment: bool = True) -> str:
    inside = " OR contains(lower(s), lower(o)) OR contains(lower(o), lower(s))" if containment else ""
    return f"""{typed_sql()},
gb0 AS (SELECT intent_id, action AS input_action, object AS input_object, subject AS input_subject, output AS input_output,
  upper({cv('action')}) AS a, {cv('object')} AS o, {cv('subject')} AS s, {cv('output')} AS out FROM clean),
gb AS (SELECT *, (s <> '' AND NOT (s = '' OR lower(o) = lower(s){inside})) AS has_s,
  (out <> '' AND upper(out) <> upper(o)) AS has_o FROM gb0 WHERE a <> '' AND o <> ''),
gbl AS (SELECT *, a || ' + ' || o || CASE WHEN has_s THEN ' (Subject: ' || s || ')' ELSE '' END
  || CASE WHEN has_o THEN ' → ' || out ELSE '' END AS source_intent FROM gb),
slots AS (SELECT * FROM (VALUES {', '.join(f"({k}, {q(v)}, {q(c)})" for k, (v, c) in enumerate(TP.SLOT_LAYOUT))}) AS t(slot, variant, complexity)),
gs AS (SELECT * FROM gbl CROSS JOIN slots)"""


def sentence(x):
    return f"(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"


def verb(a):
    return case_map(f"upper({a})", {k: q(b) for k, (b, _) in TP.VERBS.items()}, f"lower({a})")


def noun(a):
    return case_map(f"upper({a})", {k: q(n) for k, (_, n) in TP.VERBS.items()}, f"lower({a}) || ' of'")


def obj_phrase(o, idx):
    return case_map(f"upper({o})", {k: pick(lst(v), idx) for k, v in TP.OBJECT_PHRASES.items()}, f"lower({o})")


def strip_end(x):
    return f"regexp_replace({x}, '[.?]+$', '')"


def v2_text_sql(slot: str, var: str) -> str:
    templ = "[" + ", ".join(lst(t) for t, *_ in TP.V2_SLOTS) + "]"
    shifts = "[" + ", ".join(str(sh) for _, sh, *_ in TP.V2_SLOTS) + "]"
    ctxs = "[" + ", ".join(lst(G._CTX_LISTS[c] if c else [""]) for _, _, c, *_ in TP.V2_SLOTS) + "]"
    subj = lst([x[3] for x in TP.V2_SLOTS])
    outc = lst([x[4] for x in TP.V2_SLOTS])
    i = f"({slot} + 1)"
    t = pick(f"{templ}[{i}]", var)
    t = fill(t, {"verb": verb("a"), "obj": obj_phrase("o", f"{var} + {shifts}[{i}]"),
                 "ctx": pick(f"{ctxs}[{i}]", var), "Action": sentence("a")})
    t = f"CASE WHEN has_s THEN {strip_end(t)} || {fill(f'{subj}[{i}]', {'subject': 'lower(s)'})} ELSE {t} END"
    t = f"CASE WHEN has_o THEN {strip_end(t)} || {fill(f'{outc}[{i}]', {'output': 'lower(out)'})} ELSE {t} END"
    return t


def gen_v2_sql(ids=True) -> str:
    idcol = ("printf('SP_%06d', (dense_rank() OVER (ORDER BY intent_id) - 1) * 10 + slot + 1) AS synthetic_prompt_id, "
             if ids else "")
    return f"""WITH {base_sql()},
v2 AS (SELECT {idcol}intent_id, slot, source_intent, {v2_text_sql('slot', 'slot')} AS synthetic_prompt,
  variant AS prompt_variant_type, complexity AS complexity_level, input_action, input_object, input_subject, input_output FROM gs)"""


def H(x):
    return S.H(x)


def gen_v1_sql() -> str:
    key = "(CAST(intent_id AS VARCHAR) || '|' || CAST(slot AS VARCHAR))"
    plain = case_map("variant", {k: lst(v) for k, v in TP.V1_TEMPLATES.items()}, "NULL")
    subj = case_map("variant", {k: lst(v) for k, v in TP.V1_SUBJECT_TEMPLATES.items()}, "NULL")
    arr = f"CASE WHEN has_s AND ({subj}) IS NOT NULL THEN {subj} ELSE {plain} END"
    t = pick(arr, H(f"{key} || '|t'"))
    t = fill(t, {"verb": verb("a"), "noun": noun("a"), "obj": "lower(o)",
                 "ctx": pick(lst(TP.WORK_CONTEXTS), H(f"{key} || '|c'")), "Action": sentence("a"),
                 "subject": "lower(s)"})
    suffix = fill(pick(lst(TP.V1_OUTPUT_SUFFIXES), H(f"{key} || '|s'")), {"output": "lower(out)"})
    return f"""WITH {base_sql()},
t1 AS (SELECT *, {t} AS t0, {suffix} AS suffix, (has_o AND {H(f"{key} || '|o'")} % 2 = 0) AS add0 FROM gs),
t2 AS (SELECT *, CASE WHEN add0 AND NOT contains(lower(t0), lower(out)) THEN t0 || suffix ELSE t0 END AS t FROM t1)
SELECT intent_id, slot, variant AS prompt_variant_type, complexity AS complexity_level, source_intent,
  trim(regexp_replace(t, '{WS}', ' ', 'g')) AS synthetic_prompt FROM t2"""


def context_kind_sql(o, slot):
    parts = []
    for kind, words, below in TP.V3_CONTEXT_RULES:
        cond = " OR ".join([f"contains(upper({o}), {q(w)})" for w in words] + ([f"{slot} < {below}"] if below is not None else []))
        parts.append(f"WHEN {cond} THEN {q(kind)}")
    return "CASE " + " ".join(parts) + f" ELSE {q(TP.V3_CONTEXT_DEFAULT)} END"


def gen_v3_sql() -> str:
    needs = f"upper(a) IN ({', '.join(q(x) for x in TP.ACTIONS_NEEDING_CONTEXT)})"
    vals = {k: pick(lst(v), H(f"concat_ws('|', CAST(intent_id AS VARCHAR), CAST(slot AS VARCHAR), {q(k)})"))
            for k, v in TP.V3_VALUES.items()}
    vals.update({"verb": verb("a"), "obj": "lower(o)", "Action": sentence("a")})
    i = "(slot + 1)"
    with_ctx = lst([w for _, w, _ in TP.V3_SCENARIOS])
    no_ctx = lst([n for _, _, n in TP.V3_SCENARIOS])
    body = fill(case_map("kind", {k: q(v) for k, v in TP.CONTEXT_BODIES.items()}, "NULL"), {**vals, "obj": "o"})
    text = f"CASE WHEN {needs} THEN {fill(f'{with_ctx}[{i}]', vals)} ELSE {fill(f'{no_ctx}[{i}]', vals)} END"
    return f"""WITH {base_sql(containment=False)},
k AS (SELECT *, {context_kind_sql('o', 'slot')} AS kind, {needs} AS needs FROM gs),
t AS (SELECT *, {text} AS t0 FROM k),
t2 AS (SELECT *, CASE WHEN has_s THEN {strip_end('t0')} || ' Focus on ' || lower(s) || '.' ELSE t0 END AS t1 FROM t),
t3 AS (SELECT *, CASE WHEN has_o THEN {strip_end('t1')} || ' Deliver it as ' || lower(out) || '.' ELSE t1 END AS t2 FROM t2)
SELECT intent_id, slot, {lst([n for n, *_ in TP.V3_SCENARIOS])}[{i}] AS scenario, variant AS prompt_variant_type,
  complexity AS complexity_level, source_intent, t2 AS synthetic_prompt,
  CASE WHEN needs THEN kind ELSE '' END AS context_kind, CASE WHEN needs THEN {body} ELSE '' END AS context_text,
  needs AS has_context_text FROM t3"""


def gen_offline_sql() -> str:
    a = "lower(action)"
    o = "CASE WHEN object <> '' AND object <> '?' THEN lower(object) ELSE 'the item' END"
    s = "CASE WHEN subject <> '' AND subject <> '?' THEN lower(subject) END"
    out = "CASE WHEN output <> '' THEN lower(output) END"
    vals = {"verb": a, "obj": o, "Action": sentence("action"), "subject": s, "output": out}
    items = []
    for variant, t, need in TP.OFFLINE:
        cond = {None: "TRUE", "subject": f"({s}) IS NOT NULL", "nosubject": f"({s}) IS NULL", "output": f"({out}) IS NOT NULL"}[need]
        items.append(f"CASE WHEN {cond} THEN {{'variant': {q(variant)}, 'text': {fill(q(t), vals)}}} END")
    return f"""WITH {typed_sql()},
l AS (SELECT intent_id, list_filter([{', '.join(items)}], lambda x: x IS NOT NULL) AS l FROM clean),
u AS (SELECT intent_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS t FROM l)
SELECT intent_id, pos::BIGINT AS pos, t.variant AS variant_type, t.text AS prompt FROM u"""


def rubric_sql() -> str:
    vals = {"obj": "lower(o)", "action": "lower(a)"}
    parts = []
    for _, actions, lines in TP.RUBRIC_GROUPS:
        arr = "[" + ", ".join(fill(q(x), vals) for x in lines) + "]"
        parts.append(f"WHEN upper(a) IN ({', '.join(q(x) for x in actions)}) THEN {arr}")
    crit = "CASE " + " ".join(parts) + " ELSE [" + ", ".join(fill(q(x), vals) for x in TP.RUBRIC_DEFAULT) + "] END"
    out_line = f"CASE WHEN out <> '' THEN {fill(q(TP.RUBRIC_OUTPUT), {'output': 'lower(out)'})} END"
    vline = case_map("variant", {k: q(v) for k, v in TP.RUBRIC_VARIANT.items()}, "NULL")
    crit = f"list_filter(list_concat({crit}, [{out_line}, {vline}]), lambda x: x IS NOT NULL)"
    dims = (f"list_filter(list_concat({lst(TP.BASE_DIMENSIONS)}, [CASE WHEN upper(a) IN ({', '.join(q(x) for x in TP.CREATIVITY_ACTIONS)}) THEN 'creativity' END, "
            f"CASE WHEN upper(a) IN ({', '.join(q(x) for x in TP.ACTIONABILITY_ACTIONS)}) THEN 'actionability' END]), lambda x: x IS NOT NULL)")
    ctype = case_map("upper(a)", {k: q(v) for k, v in TP.ACTION_TYPE_CRITERIA.items()}, q(TP.ACTION_TYPE_DEFAULT))
    clist = case_map("upper(a)", {k: lst(v) for k, v in TP.ACTION_TYPE_LISTS.items()}, lst(TP.ACTION_TYPE_LIST_DEFAULT))
    return f"""WITH {base_sql()},
r AS (SELECT intent_id, slot, variant AS prompt_variant_type, {crit} AS crit, {dims} AS dims, {ctype} AS action_type_criterion, {clist} AS clist FROM gs)
SELECT intent_id, slot, prompt_variant_type, to_json(crit)::VARCHAR AS expected_response_criteria,
  to_json(dims)::VARCHAR AS evaluation_dimensions, len(crit)::BIGINT AS criteria_count, action_type_criterion,
  to_json(clist)::VARCHAR AS action_type_criteria FROM r"""


def scenario_rubric_sql() -> str:
    crit = case_map("scenario", {k: lst(v) for k, (v, _) in TP.V3_SCENARIO_RUBRIC.items()}, "NULL")
    extra = case_map("scenario", {k: q(d) for k, (_, d) in TP.V3_SCENARIO_RUBRIC.items()}, "NULL")
    form = f"CASE WHEN has_context_text THEN {q(TP.WITH_CONTEXT_LINE)} ELSE {q(TP.WITHOUT_CONTEXT_LINE)} END"
    dims = f"list_concat(list_concat({lst(TP.BASE_DIMENSIONS)}, [{extra}]), CASE WHEN has_context_text THEN ['grounding'] ELSE []::VARCHAR[] END)"
    return f"""SELECT intent_id, slot, scenario, has_context_text, to_json(list_concat({crit}, [{form}]))::VARCHAR AS expected_response_criteria,
  to_json({dims})::VARCHAR AS evaluation_dimensions FROM ({gen_v3_sql()})"""


def conformance_sql() -> str:
    lo = case_map("complexity_level", {k: str(a) for k, (a, _) in TP.COMPLEXITY_WORDS.items()}, "NULL")
    hi = case_map("complexity_level", {k: str(b) for k, (_, b) in TP.COMPLEXITY_WORDS.items()}, "NULL")
    grp = case_map("prompt_variant_type", {k: q(v) for k, v in TP.MIX_GROUPS.items()}, "'other'")
    aggs = ["count(*)::BIGINT AS n_prompts", "count(*) FILTER (WHERE in_range)::BIGINT AS n_in_range"]
    aggs += [f"count(*) FILTER (WHERE grp = {q(k)})::BIGINT AS n_{k}" for k in TP.MIX_QUOTA]
    aggs += [f"count(*) FILTER (WHERE complexity_level = {q(k)})::BIGINT AS n_{k}" for k in TP.LEVEL_QUOTA]
    ok = " AND ".join(["n_prompts = 10"] + [f"n_{k} = {v}" for k, v in {**TP.MIX_QUOTA, **TP.LEVEL_QUOTA}.items()])
    return gen_v2_sql(ids=False) + f""",
g AS (SELECT intent_id, prompt_variant_type, complexity_level,
  ({S.word_count('synthetic_prompt')} BETWEEN {lo} AND {hi}) AS in_range, {grp} AS grp FROM v2),
per AS (SELECT intent_id, {', '.join(aggs)} FROM g GROUP BY intent_id)
SELECT *, ({ok}) AS mix_ok FROM per"""


def gen_summary_sql() -> str:
    pos = ", ".join(str(p) for p in SAMPLE_POSITIONS)
    return gen_v2_sql() + f"""
SELECT 'variant' AS metric, prompt_variant_type AS key, count(*)::BIGINT AS value, NULL::VARCHAR AS text FROM v2 GROUP BY 1, 2
UNION ALL SELECT 'complexity', complexity_level, count(*)::BIGINT, NULL FROM v2 GROUP BY 1, 2
UNION ALL SELECT 'prompts', NULL, count(*)::BIGINT, NULL FROM v2
UNION ALL SELECT 'intents', NULL, count(DISTINCT intent_id)::BIGINT, NULL FROM v2
UNION ALL SELECT 'sample', synthetic_prompt_id, CAST(substr(synthetic_prompt_id, 4, 6) AS BIGINT), left(synthetic_prompt, 200)
  FROM v2 WHERE CAST(substr(synthetic_prompt_id, 4, 6) AS BIGINT) IN ({pos})"""


def variety_sql() -> str:
    vals = TP.V3_VALUES["project"]
    return f"""WITH {typed_sql()},
v AS (SELECT intent_id, value FROM clean CROSS JOIN (SELECT unnest({lst(vals)}) AS value)),
ranked AS (SELECT intent_id, value, (row_number() OVER (PARTITION BY intent_id ORDER BY md5(CAST(intent_id AS VARCHAR) || '|' || value)) - 1)::BIGINT AS r FROM v),
sl AS (SELECT intent_id, slot::BIGINT AS slot, (slot % {len(vals)})::BIGINT AS r FROM clean CROSS JOIN range(0, 10) AS t(slot))
SELECT intent_id, slot, 'project' AS field, value FROM sl JOIN ranked USING (intent_id, r)"""


def analysis_sql() -> str:
    def cat(groups, key):
        seen, m = set(), {}
        for c, vs in groups:
            for v in vs:
                if v not in seen:
                    seen.add(v)
                    m[v] = q(c)
        return case_map(key, m, "'other'")
    hs = "(subject <> '' AND subject <> '?')"
    ho = "(object <> '' AND object <> '?')"
    sig = (f"concat_ws(' ', action, CASE WHEN {hs} THEN 'from/about ' || subject END, CASE WHEN {ho} THEN 'the ' || object END, "
           "CASE WHEN output <> '' THEN 'as ' || output END)")
    return f"""WITH {typed_sql()}
SELECT intent_id, action, object, subject, output, {cat(TP.ACTION_CATEGORIES, 'upper(action)')} AS action_category,
  CASE WHEN NOT {ho} THEN 'unspecified' ELSE {cat(TP.OBJECT_CATEGORIES, 'upper(object)')} END AS object_category,
  {hs} AS has_subject, (output <> '') AS has_explicit_output, {sig} AS semantic_signature,
  (action <> '' AND {ho} AND {hs}) AS multi_component, upper(action) IN ({', '.join(q(x) for x in TP.TRANSFORM_ACTIONS)}) AS has_transformation,
  {hs} AS requires_context, (output <> '') AS has_specified_output FROM clean"""


def action_distribution_sql() -> str:
    return analysis_sql().replace("SELECT intent_id, action, object", "a AS (SELECT intent_id, action, object", 1).replace(
        "FROM clean", "FROM clean)", 1).replace(f"WITH {typed_sql()}\n", f"WITH {typed_sql()},\n", 1) + """
SELECT 'distinct_actions' AS metric, NULL::VARCHAR AS key, count(DISTINCT action)::BIGINT AS value FROM a
UNION ALL (SELECT 'top_action', action, count(*)::BIGINT AS n FROM a GROUP BY action ORDER BY n DESC, action LIMIT 15)
UNION ALL SELECT 'action_category', action_category, count(*)::BIGINT FROM a GROUP BY action_category"""


def request_sql() -> str:
    def part(c, before):
        return f"CASE WHEN coalesce({c}, '') NOT IN ('', '?') THEN '{before}' || {c} ELSE '' END"
    a = analysis_sql().replace(f"WITH {typed_sql()}\n", "")
    rates = ", ".join(f"CASE WHEN {c} NOT IN ('', '0%') THEN '{c}=' || {c} END" for c in ("apology_rate", "no_citation_rate"))
    qc = ("array_to_string(list_filter(['user_count=' || user_count, 'pct_users=' || pct_users, "
          "'tenant_count=' || CAST(tenant_count AS VARCHAR), CASE WHEN reliable THEN 'reliable=true' END, "
          f"CASE WHEN sat_rate <> '' THEN 'sat_rate=' || sat_rate END, {rates}], lambda x: x IS NOT NULL), '; ')")
    flags = q("\n".join(line for _, line in TP.GENERATION_FLAGS if line is not None))
    nl = "chr(10)"
    text = (f"'write_prompts count=10 keys={','.join(G.RESPONSE_KEYS)}' || {nl} || 'intent: ' || c.action || {part('c.object', ' / ')}"
            f" || {part('c.subject', ' / ')} || {part('c.output', ' -> ')} || {nl} || 'class: ' || an.action_category || ' on ' || an.object_category"
            f" || ', ' || an.semantic_signature || {nl} || 'seen: ' || {qc} || {nl} || 'obey:' || {nl} || {flags}")
    return f"""WITH {typed_sql()}, an AS ({a})
SELECT c.intent_id, {text} AS request, NULL::VARCHAR AS response, NULL::VARCHAR AS error
FROM clean c JOIN an USING (intent_id)"""


TYPED_SELECT = ", ".join(TYPED_COLS)

ORACLE = {
    "intents_clean": f"WITH {typed_sql()} SELECT {TYPED_SELECT} FROM clean",
    "intents_rejects": f"WITH {typed_sql()} SELECT intent_id, _reject AS reason FROM typed WHERE _reject IS NOT NULL",
    "intent_analysis": analysis_sql(),
    "action_distribution": action_distribution_sql(),
    "request_text": request_sql(),
    "request_first": f"SELECT * FROM ({request_sql()}) WHERE intent_id IN (SELECT intent_id FROM (WITH {typed_sql()} SELECT intent_id FROM clean ORDER BY intent_id LIMIT {FIRST_INTENTS}))",
    "gen_v1": gen_v1_sql(),
    "gen_v2": gen_v2_sql() + " SELECT * FROM v2",
    "gen_v3": gen_v3_sql(),
    "gen_offline": gen_offline_sql(),
    "rubric": rubric_sql(),
    "scenario_rubric": scenario_rubric_sql(),
    "gen_conformance": conformance_sql(),
    "gen_summary": gen_summary_sql(),
    "variety_pick": variety_sql(),
}
