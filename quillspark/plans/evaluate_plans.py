"""Evaluation analytics queries over the ratings fact, and the batch responder."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import templates as TP
from ..operators import collect as CO
from ..operators import evaluate as E
from ..operators import label as L
from ..operators import responder as R
from ..sources import fixtures as FX
from . import collect_plans as CP
from . import sqlgen as S
from .sqlgen import q


def prompt_attrs(spark, sf):
    """Each document plays slot (doc_id mod 10) of intent family (doc_id div 10)."""
    d = FX.table(spark, sf, "documents").select("doc_id")
    var = F.array(*[F.lit(v) for v, _ in TP.SLOT_LAYOUT])
    cx = F.array(*[F.lit(c) for _, c in TP.SLOT_LAYOUT])
    i = (F.col("doc_id") % 10 + 1).cast("int")
    return d.select(F.col("doc_id").alias("prompt_id"), F.element_at(var, i).alias("variant_type"),
                    F.element_at(cx, i).alias("complexity"), (F.col("doc_id") / 10).cast("bigint").alias("family"))


def slim_cells(spark, sf):
    """Latest attempt per cell carrying only status and latency: the response
    text is reduced to its status before the shuffle."""
    a = CO.with_status(FX.attempts(spark, sf)).select("prompt_id", "system", "attempt", "status", "latency_s")
    return CO.latest_status(a)


def usable(spark, sf):
    return slim_cells(spark, sf).filter(F.col("status") == "ok")


def q_scores(spark, sf):
    sc = E.scores(FX.ratings(spark, sf))
    avg = sc.groupBy("system").agg(F.round(F.avg("score"), 6).alias("system_avg_score"))
    return sc.join(avg, "system").select("prompt_id", "system", F.round("score", 6).alias("score"), "system_avg_score")


def q_dimension_breakdown(spark, sf):
    return E.dimension_breakdown(FX.ratings(spark, sf))


def q_by_complexity(spark, sf):
    return E.score_by(E.scores(FX.ratings(spark, sf)), prompt_attrs(spark, sf), "complexity")


def q_by_variant(spark, sf):
    return E.score_by(E.scores(FX.ratings(spark, sf)), prompt_attrs(spark, sf), "variant_type")


def q_leaderboard(spark, sf):
    # scores feed three aggregates (winners, averages, judged count): cut the
    # lineage once in the shared checkpoint folder instead of recomputing
    sc = E.scores(FX.ratings(spark, sf)).checkpoint()
    return E.leaderboard(sc, usable(spark, sf))


def q_kappa(spark, sf):
    return E.fleiss_kappa(FX.ratings(spark, sf))


def q_sufficiency(spark, sf):
    d = L.with_lower(FX.documents(spark, sf).select(F.col("doc_id").alias("prompt_id"), "text"), "text")
    cats = L.label_intent_rules(d, out="category").select("prompt_id", "category")
    return E.sufficiency(FX.ratings(spark, sf), cats)


def q_blind_labels(spark, sf):
    return E.blind_labels(FX.ratings(spark, sf))


def q_latency_profile(spark, sf):
    return E.latency_profile(slim_cells(spark, sf))


def q_robustness(spark, sf):
    return E.robustness(E.scores(FX.ratings(spark, sf)), prompt_attrs(spark, sf))


def q_rubric_check(spark, sf):
    return E.rubric_check(spark, FX.ratings(spark, sf))


def q_batch_responder(spark, sf):
    d = FX.documents(spark, sf).select(F.col("doc_id").alias("prompt_id"), F.col("text").alias("prompt"))
    return R.batch_responder(d, systems=R.DEFAULT_SYSTEMS, allowed=R.ALLOWED)


QUERIES = {
    "scores": q_scores,
    "dimension_breakdown": q_dimension_breakdown,
    "by_complexity": q_by_complexity,
    "by_variant": q_by_variant,
    "leaderboard": q_leaderboard,
    "kappa": q_kappa,
    "sufficiency": q_sufficiency,
    "blind_labels": q_blind_labels,
    "latency_profile": q_latency_profile,
    "robustness": q_robustness,
    "rubric_check": q_rubric_check,
    "batch_responder": q_batch_responder,
}

# ---------------------------------------------------------------------------
# Oracle SQL
# ---------------------------------------------------------------------------

RAT = f"rat AS ({FX.RATINGS_SQL})"
WMAP = "CASE criterion " + " ".join(f"WHEN {q(k)} THEN {w}" for k, w in E.WEIGHTS) + " END"
SC = f"""{RAT},
cm AS (SELECT prompt_id, system, criterion, avg(rating) AS r, {WMAP} AS w FROM rat GROUP BY ALL),
sc AS (SELECT prompt_id, system, sum(w * r) / sum(w) AS score FROM cm WHERE w IS NOT NULL GROUP BY ALL)"""
ATTRS = ("attrs AS (SELECT doc_id AS prompt_id, "
         f"[{', '.join(q(v) for v, _ in TP.SLOT_LAYOUT)}][(doc_id % 10) + 1] AS variant_type, "
         f"[{', '.join(q(c) for _, c in TP.SLOT_LAYOUT)}][(doc_id % 10) + 1] AS complexity, "
         "(doc_id // 10)::BIGINT AS family FROM documents)")
USABLE = f"""{CP.ATT}, lat AS (SELECT *, {CP.status_sql()} AS status FROM att
  QUALIFY row_number() OVER (PARTITION BY prompt_id, system ORDER BY attempt DESC) = 1)"""


def by_sql(key):
    return f"""WITH {SC}, {ATTRS}
SELECT system, {key}, round(avg(score), 6) AS avg_score, count(*)::BIGINT AS prompts FROM sc JOIN attrs USING (prompt_id) GROUP BY ALL"""


LEADER = f"""WITH {SC}, {USABLE},
s AS (SELECT sc.*, round(score, 6) AS rs FROM sc WHERE (prompt_id, system) IN (SELECT (prompt_id, system) FROM lat WHERE status = 'ok')),
per AS (SELECT prompt_id, count(*) AS n_sys, max(rs) AS best FROM s GROUP BY prompt_id),
top AS (SELECT s.prompt_id, count(*) AS n_top, min(system) AS cand FROM s JOIN per USING (prompt_id) WHERE rs = best GROUP BY s.prompt_id),
w AS (SELECT prompt_id, n_sys >= 2 AS judged, CASE WHEN n_sys >= 2 AND n_top = 1 THEN cand END AS winner FROM per JOIN top USING (prompt_id)),
wins AS (SELECT winner AS system, count(*) AS wins FROM w WHERE winner IS NOT NULL GROUP BY winner),
avgs AS (SELECT system, round(avg(score), 6) AS avg_score, count(*)::BIGINT AS prompts FROM sc GROUP BY system),
j AS (SELECT count(*) AS judged_prompts FROM w WHERE judged)
SELECT system, avg_score, prompts, coalesce(wins, 0)::BIGINT AS wins, judged_prompts::BIGINT AS judged_prompts,
  round(coalesce(wins, 0) / judged_prompts, 6) AS win_rate, dense_rank() OVER (ORDER BY avg_score DESC)::BIGINT AS rank
FROM avgs LEFT JOIN wins USING (system) CROSS JOIN j"""

KAPPA = f"""WITH {RAT},
cnt AS (SELECT prompt_id, system, criterion, rating, count(*) AS nij FROM rat GROUP BY ALL),
per AS (SELECT prompt_id, system, criterion, sum(nij) AS n, sum(nij * nij) AS sq FROM cnt GROUP BY ALL HAVING sum(nij) = 3),
pbar AS (SELECT criterion, avg((sq - 3) / 6.0) AS P, count(*) AS N FROM per GROUP BY criterion),
pj AS (SELECT c.criterion, c.rating, sum(nij) AS cj FROM cnt c SEMI JOIN per p USING (prompt_id, system, criterion) GROUP BY ALL),
pe AS (SELECT pj.criterion, sum(pow(cj / (N * 3.0), 2)) AS Pe FROM pj JOIN pbar USING (criterion) GROUP BY pj.criterion)
SELECT criterion, N::BIGINT AS subjects, round(P, 6) AS p_bar, round(Pe, 6) AS p_e,
  CASE WHEN Pe < 1 THEN round((P - Pe) / (1 - Pe), 6) END AS kappa FROM pbar JOIN pe USING (criterion)"""

SUFF = f"""WITH {RAT},
rated AS (SELECT prompt_id, count(DISTINCT rater) AS raters FROM rat GROUP BY prompt_id),
cats AS (SELECT doc_id AS prompt_id, {S.intent_rules('lower(text)')} AS category FROM documents)
SELECT 'category' AS metric, category AS key, count(*)::BIGINT AS n, count(*) >= {E.MIN_PER_CATEGORY} AS sufficient
  FROM cats JOIN rated USING (prompt_id) GROUP BY category
UNION ALL SELECT 'raters', NULL, count(*)::BIGINT, raters >= {E.MIN_RATERS} FROM rated GROUP BY raters >= {E.MIN_RATERS}"""

ORACLE = {
    "scores": f"""WITH {SC}, a AS (SELECT system, round(avg(score), 6) AS system_avg_score FROM sc GROUP BY system)
SELECT prompt_id, system, round(score, 6) AS score, system_avg_score FROM sc JOIN a USING (system)""",
    "dimension_breakdown": f"WITH {RAT} SELECT system, criterion, round(avg(rating), 6) AS avg_rating, count(*)::BIGINT AS n FROM rat GROUP BY ALL",
    "by_complexity": by_sql("complexity"),
    "by_variant": by_sql("variant_type"),
    "leaderboard": LEADER,
    "kappa": KAPPA,
    "sufficiency": SUFF,
    "blind_labels": f"""WITH {RAT}, p AS (SELECT DISTINCT prompt_id, system FROM rat)
SELECT prompt_id, system, chr((row_number() OVER (PARTITION BY prompt_id ORDER BY md5(concat_ws('|', 'blind', CAST(prompt_id AS VARCHAR), system))) + 64)::INT) AS label FROM p""",
    "latency_profile": f"""WITH {USABLE}
SELECT system, count(*)::BIGINT AS n, round(avg(latency_s), 4) AS avg_s, round(quantile_cont(latency_s, 0.5), 4) AS p50_s,
  round(quantile_cont(latency_s, 0.9), 4) AS p90_s, round(quantile_cont(latency_s, 0.95), 4) AS p95_s FROM lat WHERE status = 'ok' GROUP BY system""",
    "robustness": f"""WITH {SC}, {ATTRS},
per AS (SELECT system, family, stddev_pop(score) AS sd FROM sc JOIN attrs USING (prompt_id) GROUP BY ALL)
SELECT system, round(avg(sd), 6) AS robustness, count(*)::BIGINT AS families FROM per GROUP BY system""",
    "rubric_check": f"""WITH {RAT} SELECT {round(sum(w for _, w in E.WEIGHTS), 6)}::DOUBLE AS weight_sum, TRUE AS weights_ok,
  count(*)::BIGINT AS ratings, count(*) FILTER (WHERE rating NOT BETWEEN {E.SCALE[0]} AND {E.SCALE[1]})::BIGINT AS out_of_range FROM rat""",
    "batch_responder": f"""SELECT doc_id AS prompt_id, v.system,
  CASE WHEN length(text) < {R.MIN_PROMPT} THEN NULL ELSE v.system || ': ' || text END AS response,
  CASE WHEN length(text) < {R.MIN_PROMPT} THEN 'ERROR: prompt too short' END AS error
FROM documents CROSS JOIN (VALUES {', '.join(f"({q(s)})" for s in R.DEFAULT_SYSTEMS if s in R.ALLOWED)}) AS v(system)""",
}
