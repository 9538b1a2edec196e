"""Streaming queries (file source, availableNow) and their batch-twin oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import fixtures as FX
from ..streaming import jobs as J
from . import collect_plans as CP
from . import harvest_plans as HP
from . import sqlgen as S

GAP = "12 hours"
DELAY = "1 hour"


def q_stream_harvest(spark, sf):
    out = J.stream_harvest(spark, FX.documents(spark, sf))
    return out.select("prompt_id")


def q_stream_sessions(spark, sf):
    return J.stream_sessions(spark, FX.polls(spark, sf), gap=GAP, delay=DELAY)


def q_stream_append(spark, sf):
    d = FX.documents(spark, sf).select(F.col("doc_id").alias("seq"), "text", F.col("lang").alias("language"))
    return J.stream_append(spark, d.filter(F.col("seq") % 2 == 1), d.filter(F.col("seq") % 2 == 0))


def q_stream_stats(spark, sf):
    return J.stream_stats(spark, FX.attempts(spark, sf))


def q_stream_quiescence(spark, sf):
    return J.stream_quiescence(spark, FX.polls(spark, sf), gap_s=CP.GAP_S, timeout_s=CP.TIMEOUT_S)


def q_stream_stable_polls(spark, sf):
    return J.stream_stable_polls(spark, FX.polls(spark, sf))


def q_stream_timeouts(spark, sf):
    return J.stream_timeouts(spark, FX.polls(spark, sf), gap_s=CP.GAP_S, timeout_s=CP.SHORT_TIMEOUT_S, delay=DELAY)


QUERIES = {
    "stream_timeouts": q_stream_timeouts,
    "stream_stable_polls": q_stream_stable_polls,
    "stream_quiescence": q_stream_quiescence,
    "stream_harvest": q_stream_harvest,
    "stream_sessions": q_stream_sessions,
    "stream_append": q_stream_append,
    "stream_stats": q_stream_stats,
}

SESSIONS_SQL = f"""WITH pl AS ({FX.POLLS_SQL}),
g AS (SELECT cell, ts, CASE WHEN lag(ts) OVER (PARTITION BY cell ORDER BY ts, seq) IS NULL
  OR epoch(ts) - epoch(lag(ts) OVER (PARTITION BY cell ORDER BY ts, seq)) >= 43200 THEN 1 ELSE 0 END AS brk FROM pl),
s AS (SELECT cell, ts, sum(brk) OVER (PARTITION BY cell ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM g),
ss AS (SELECT cell, min(epoch(ts)) AS session_start, max(epoch(ts)) + 43200 AS session_end, count(*)::BIGINT AS polls FROM s GROUP BY cell, sid)
SELECT * FROM ss WHERE session_end <= (SELECT max(epoch(ts)) FROM pl) - 3600"""

ORACLE = {
    "stream_timeouts": "SELECT cell, status, response, latency_s FROM (" + CP.quiescence_sql(CP.SHORT_TIMEOUT_S, only_incomplete=True)
    + ") q WHERE cell IN (SELECT cell FROM (" + FX.POLLS_SQL + ") GROUP BY cell HAVING min(epoch(ts)) + "
    + str(CP.SHORT_TIMEOUT_S) + " < (SELECT max(epoch(ts)) - 3600 FROM events))",
    "stream_stable_polls": CP.stable_sql().replace("FROM l LEFT JOIN d USING (cell)", "FROM l JOIN d USING (cell)"),
    "stream_quiescence": CP.quiescence_sql(CP.TIMEOUT_S).replace("SELECT * FROM o ", "SELECT * FROM o WHERE status = 'complete'"),
    "stream_harvest": f"""SELECT substr(k, 1, 12) AS prompt_id FROM (SELECT DISTINCT {S.norm_key('p', 32)} AS k
  FROM (SELECT {S.strip('text')} AS p FROM documents) WHERE length(p) BETWEEN 15 AND 5000)""",
    "stream_sessions": SESSIONS_SQL,
    "stream_append": HP.INCREMENTAL_SQL,
    "stream_stats": f"""WITH {CP.ATT}, a AS (SELECT *, {CP.status_sql()} AS status FROM att)
SELECT system, count(*)::BIGINT AS queries, count(*) FILTER (WHERE status = 'ok')::BIGINT AS ok,
  count(*) FILTER (WHERE status = 'blocked')::BIGINT AS blocked, count(*) FILTER (WHERE status = 'error')::BIGINT AS errors
FROM a GROUP BY system""",
}
