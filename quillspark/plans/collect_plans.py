"""Response parsing / extraction, block pages, attempts and polls queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab as V
from ..operators import collect as CO
from ..operators import polls as PO
from ..operators.rounds import Rounds
from ..session import table
from ..sources import fixtures as FX
from ..streaming.jobs import run_dir
from . import generate_plans as GP
from . import sqlgen as S
from .sqlgen import q

GAP_S = 12 * 3600.0        # quiet gap scaled to the events table (polls hours apart)
TIMEOUT_S = 60 * 86400.0    # longer than the data span: every cell gets a verdict
SHORT_TIMEOUT_S = 3 * 86400.0


def q_response_parse(spark, sf):
    return CO.response_rows(FX.model_output(spark, sf), GP.clean(spark, sf))


def q_response_extract(spark, sf):
    return CO.response_extract(table(spark, sf, "conversations"))


def q_block_pages(spark, sf):
    return CO.block_pages(table(spark, sf, "pages"))


def q_latest_attempt(spark, sf):
    a = CO.with_status(FX.attempts(spark, sf)).select("prompt_id", "system", "attempt", "status", "latency_s")
    return CO.latest_status(a)


def q_retry_queue(spark, sf):
    return CO.retry_rounds(FX.attempts(spark, sf))


def q_collect_rounds(spark, sf):
    """Collection rounds over every prompt and system, each committed once; the
    consolidated latest answers read back."""
    answers = FX.attempts(spark, sf)
    cells = FX.documents(spark, sf).select(F.col("doc_id").alias("prompt_id"), F.explode(F.array(*[F.lit(s) for s in FX.SYSTEMS])).alias("system"))
    rounds = Rounds(spark, run_dir(spark, "rounds"))

    def send(queue):
        # a round asks for few attempts (one, as a rule): only their answers' texts are exchanged
        asked = [r["attempt"] for r in queue.select("attempt").distinct().collect()]
        return queue.join(answers.where(F.col("attempt").isin(asked)), ["prompt_id", "system", "attempt"])

    rounds.run(cells, send)
    return rounds.latest()


def q_system_success(spark, sf):
    return CO.system_success(FX.attempts(spark, sf))


def q_attempt_stats(spark, sf):
    return CO.attempt_stats(FX.attempts(spark, sf))


def q_completion_progress(spark, sf):
    return CO.completion_progress(FX.attempts(spark, sf))


def q_quiescence(spark, sf):
    return PO.quiescence(FX.polls(spark, sf), gap_s=GAP_S, timeout_s=TIMEOUT_S)


def q_timeouts(spark, sf):
    r = PO.quiescence(FX.polls(spark, sf), gap_s=GAP_S, timeout_s=SHORT_TIMEOUT_S)
    return r.filter(F.col("status") != "complete")


def q_growth(spark, sf):
    return PO.growth(FX.polls(spark, sf))


def q_stable_polls(spark, sf):
    return PO.stable_polls(FX.polls(spark, sf))


QUERIES = {
    "response_parse": q_response_parse,
    "response_extract": q_response_extract,
    "block_pages": q_block_pages,
    "latest_attempt": q_latest_attempt,
    "retry_queue": q_retry_queue,
    "collect_rounds": q_collect_rounds,
    "system_success": q_system_success,
    "attempt_stats": q_attempt_stats,
    "completion_progress": q_completion_progress,
    "quiescence": q_quiescence,
    "timeouts": q_timeouts,
    "growth": q_growth,
    "stable_polls": q_stable_polls,
}

# ---------------------------------------------------------------------------
# Oracle SQL
# ---------------------------------------------------------------------------

ITEM_JSON = ('[{"prompt": "VARCHAR", "variant_type": "VARCHAR", "complexity_level": "VARCHAR", '
             '"expected_response_criteria": ["VARCHAR"], "evaluation_dimensions": ["VARCHAR"]}]')


def parse_sql():
    g = "regexp_extract(content, '\\[[\\s\\S]*\\]', 0)"
    f = "regexp_extract(content, '```(?:json)?\\s*([\\s\\S]*?)\\s*```', 1)"
    return f"""WITH {GP.typed_sql()}, mo AS ({FX.MODEL_OUTPUT_SQL}),
j AS (SELECT intent_id, CASE WHEN json_valid(content) THEN content WHEN json_valid({g}) THEN {g}
  WHEN json_valid({f}) THEN {f} END AS j FROM mo),
it AS (SELECT intent_id, from_json(j, '{ITEM_JSON}') AS l FROM j WHERE j IS NOT NULL),
u AS (SELECT intent_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS it FROM it)
SELECT u.intent_id, pos::BIGINT AS pos, coalesce(it.prompt, '') AS synthetic_prompt,
  coalesce(it.variant_type, 'unknown') AS prompt_variant_type, coalesce(it.complexity_level, 'medium') AS complexity_level,
  to_json(coalesce(it.expected_response_criteria, []::VARCHAR[]))::VARCHAR AS expected_response_criteria,
  to_json(coalesce(it.evaluation_dimensions, []::VARCHAR[]))::VARCHAR AS evaluation_dimensions,
  c.action, c.object, c.subject, c.output
FROM u JOIN clean c USING (intent_id)"""


def extract_sql():
    r = S.strip("string_split(body, 'Copilot said')[-1]")
    for m in CO.END_MARKERS:
        r = f"(CASE WHEN contains({r}, {q(m)}) THEN {S.strip(f'split_part({r}, {q(m)}, 1)')} ELSE {r} END)"
    ans = f"CASE WHEN contains(body, 'Copilot said') THEN {r} ELSE '' END"
    return f"""WITH c AS (SELECT *, 'Copilot said ' || text || [' You said more', ' Message Copilot', ''][(turn % 3) + 1] AS body
  FROM conversations),
p AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS prompt FROM c GROUP BY conv_id),
a AS (SELECT c.*, p.prompt, (coalesce(p.prompt, '') <> '' AND contains(c.text, left(p.prompt, 30))) AS echo
  FROM c LEFT JOIN p USING (conv_id) WHERE role = 'assistant'),
per AS (SELECT conv_id, arg_max({ans}, turn) AS answer,
  arg_max(text, {{'l': length(text), 't': -turn}}) FILTER (WHERE NOT echo) AS best_candidate,
  count(*) FILTER (WHERE echo)::BIGINT AS echo_candidates FROM a GROUP BY conv_id),
lb AS (SELECT conv_id, coalesce(string_agg({S.strip('text')}, chr(10) ORDER BY turn) FILTER (WHERE length(text) > 5), '') AS last_blocks
  FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5) GROUP BY conv_id)
SELECT * FROM per LEFT JOIN lb USING (conv_id)"""


def block_sql():
    first = "CASE " + " ".join(f"WHEN contains(lower(html), {q(p)}) THEN {q(p)}" for p in V.BLOCK_PAGE_PHRASES) + " END"
    return f"SELECT page_id, url, ({first}) IS NOT NULL AS is_block_page, {first} AS matched_phrase FROM pages"


def status_sql(resp="response", blocked="blocked"):
    return (f"CASE WHEN {blocked} THEN 'blocked' WHEN starts_with({resp}, 'ERROR') THEN 'error' "
            f"WHEN {resp} IN ({', '.join(q(p) for p in CO.PLACEHOLDERS)}) THEN 'placeholder' ELSE 'ok' END")


ATT = f"att AS ({FX.ATTEMPTS_SQL})"
LATEST = f"""{ATT}, lat AS (SELECT *, {status_sql()} AS status FROM att
  QUALIFY row_number() OVER (PARTITION BY prompt_id, system ORDER BY attempt DESC) = 1)"""


def polls_runs_sql():
    return f"""pl AS ({FX.POLLS_SQL}),
st AS (SELECT cell, min(epoch(ts)) AS start FROM pl GROUP BY cell),
v0 AS (SELECT *, (contains(text, 'Thinking') OR contains(text, 'Generating')) AS is_marker FROM pl),
v1 AS (SELECT *, lag(CASE WHEN is_marker THEN '' ELSE text END) OVER (PARTITION BY cell ORDER BY ts, seq) AS _prev
  FROM v0 WHERE is_marker OR length(text) >= {PO.MIN_LEN}),
v2 AS (SELECT *, (NOT is_marker AND (_prev IS NULL OR text <> _prev)) AS change FROM v1),
v3 AS (SELECT *, sum(CASE WHEN is_marker OR change THEN 1 ELSE 0 END) OVER (PARTITION BY cell ORDER BY ts, seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, epoch(ts) AS t FROM v2),
v4 AS (SELECT *, first_value(t) OVER (PARTITION BY cell, run ORDER BY ts, seq) AS run_start,
  row_number() OVER (PARTITION BY cell, run ORDER BY ts, seq) AS run_rn, length(coalesce(_prev, '')) AS prev_len FROM v3),
r AS (SELECT v4.*, st.start FROM v4 JOIN st USING (cell))"""


def quiescence_sql(timeout, only_incomplete=False):
    where = "WHERE status <> 'complete'" if only_incomplete else ""
    return f"""WITH {polls_runs_sql()},
rr AS (SELECT * FROM r WHERE t - start < {timeout}),
d AS (SELECT * FROM rr WHERE NOT is_marker AND t - run_start >= {GAP_S} QUALIFY row_number() OVER (PARTITION BY cell ORDER BY t, seq) = 1),
l AS (SELECT * FROM rr QUALIFY row_number() OVER (PARTITION BY cell ORDER BY t DESC, seq DESC) = 1),
o AS (SELECT l.cell,
  CASE WHEN d.cell IS NOT NULL THEN 'complete' WHEN NOT l.is_marker THEN 'partial' ELSE 'error' END AS status,
  CASE WHEN d.cell IS NOT NULL THEN d.text WHEN NOT l.is_marker THEN l.text ELSE 'ERROR: Timeout waiting for response' END AS response,
  CASE WHEN d.cell IS NOT NULL THEN d.run_start - d.start WHEN NOT l.is_marker THEN
    CASE WHEN l.run_rn > 1 THEN l.run_start - l.start ELSE {timeout} END ELSE 0.0 END AS latency_s,
  CASE WHEN d.cell IS NOT NULL THEN d.t END AS done_at
  FROM l LEFT JOIN d USING (cell))
SELECT * FROM o {where}"""


def stable_sql():
    return f"""WITH pl AS ({FX.POLLS_SQL}),
p1 AS (SELECT *, (text = lag(text) OVER (PARTITION BY cell ORDER BY ts, seq) AND length(text) > {PO.STABLE_MIN_LEN}) AS same FROM pl),
p2 AS (SELECT *, sum(CASE WHEN coalesce(same, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY cell ORDER BY ts, seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM p1),
p3 AS (SELECT *, row_number() OVER (PARTITION BY cell, run ORDER BY ts, seq) AS rn FROM p2),
d AS (SELECT * FROM p3 WHERE rn > {PO.STABLE_POLLS} QUALIFY row_number() OVER (PARTITION BY cell ORDER BY ts, seq) = 1),
l AS (SELECT * FROM p3 QUALIFY row_number() OVER (PARTITION BY cell ORDER BY ts DESC, seq DESC) = 1)
SELECT l.cell, CASE WHEN d.cell IS NOT NULL THEN 'complete' ELSE 'timeout' END AS status,
  CASE WHEN d.cell IS NOT NULL THEN d.text ELSE l.text END AS response, d.seq AS done_seq
FROM l LEFT JOIN d USING (cell)"""


ORACLE = {
    "collect_rounds": f"WITH {LATEST} SELECT prompt_id, system, attempt, status, latency_s FROM lat",
    "response_parse": parse_sql(),
    "response_extract": extract_sql(),
    "block_pages": block_sql(),
    "latest_attempt": f"WITH {LATEST} SELECT prompt_id, system, attempt, status, latency_s FROM lat",
    "retry_queue": f"""WITH {ATT}, top AS (SELECT prompt_id, system, max(attempt) AS last FROM att GROUP BY prompt_id, system)
SELECT prompt_id, system, attempt + 1 AS next_attempt, attempt = last AS open
FROM att JOIN top USING (prompt_id, system) WHERE blocked AND attempt < 4""",
    "system_success": f"WITH {LATEST} SELECT system, count(*) FILTER (WHERE status = 'ok')::BIGINT AS ok, count(*)::BIGINT AS cells FROM lat GROUP BY system",
    "attempt_stats": f"""WITH {LATEST},
a AS (SELECT *, {status_sql()} AS status FROM att),
per AS (SELECT system, count(*)::BIGINT AS queries, count(*) FILTER (WHERE status = 'ok')::BIGINT AS ok,
  count(*) FILTER (WHERE status = 'blocked')::BIGINT AS blocked, count(*) FILTER (WHERE status = 'error')::BIGINT AS errors,
  round(avg(latency_s), 4) AS avg_latency_s FROM a GROUP BY system),
cell AS (SELECT system, round(avg((status = 'ok')::INT) * 100, 2) AS cell_success_rate FROM lat GROUP BY system)
SELECT per.*, round(ok / queries * 100, 2) AS success_rate, cell_success_rate FROM per JOIN cell USING (system)""",
    "completion_progress": f"""WITH {LATEST},
per AS (SELECT prompt_id, max((status = 'ok')::INT) AS done FROM lat GROUP BY prompt_id)
SELECT count(*)::BIGINT AS total, sum(done)::BIGINT AS completed,
  CASE WHEN count(*) > 0 THEN floor(sum(done) * 100 / count(*)) ELSE 0 END::BIGINT AS progress_pct FROM per""",
    "quiescence": quiescence_sql(TIMEOUT_S),
    "timeouts": quiescence_sql(SHORT_TIMEOUT_S, only_incomplete=True),
    "growth": f"WITH {polls_runs_sql()} SELECT cell, seq, t AS at, (length(text) - prev_len)::BIGINT AS growth FROM r WHERE change",
    "stable_polls": stable_sql(),
}
