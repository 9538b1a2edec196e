"""Input frames derived from the corpus tables. Each derivation has a SQL
twin in ``plans.oracle`` so both engines see the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import md5int
from ..session import balanced, table


def raw_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-source prompt records: (source, source_ord, seq, text, language).
    ``source_ord, seq`` carry the order that keep-first and first-N rely on;
    a third of the rows carry a source-provided language."""
    d = balanced(table(spark, sf_dir, "documents"))
    return d.select(
        "source",
        F.col("doc_id").alias("seq"),
        F.substring("source", 4, 1 << 20).cast("int").alias("source_ord"),
        "text",
        F.nullif(F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(F.lit("")), F.lit("")).alias("language"),
    )


def H(c) -> "F.Column":
    return md5int(c)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced(table(spark, sf_dir, "documents"))


def intents_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent rows as all-string columns (as read from a header CSV), derived
    from ``part``: placeholders, blanks, redundant outputs, an unknown action,
    and metric text that exercises every cast rule."""
    p = balanced(table(spark, sf_dir, "part"))
    k, sz = F.col("p_partkey"), F.col("p_size")
    def case(e, values, other=None):
        out = None
        for i, v in enumerate(values):
            out = F.when(e == i, v) if out is None else out.when(e == i, v)
        return out.otherwise(other) if other is not None else out
    L = F.lit
    return p.select(
        k.alias("intent_id"),
        case(k % 8, [L("SUMMARIZE"), L("CREATE"), L("FIND"), L("EXPLAIN"), L("COMPARE"), L("PLAN"), L("SCHEDULE")], L("ZIP")).alias("action"),
        case(sz % 6, [L("EMAIL"), L("MEETING"), L("DOCUMENT"), L("?"), L("DATA")], F.upper("p_type")).alias("object"),
        case(k % 5, [L("?"), L(""), L("N/A")], F.col("p_name")).alias("subject"),
        case(k % 4, [L("TABLE"), L("EMAIL")], L("")).alias("output"),
        F.when(k % 11 == 0, L("")).otherwise(sz.cast("string")).alias("action_rank"),
        (k % 10).cast("string").alias("rank_in_action"),
        case(k % 4, [L("TRUE"), L("true"), L("FALSE")], L("")).alias("reliable"),
        case(sz % 5, [L(""), L("12"), L(" 5 "), L("1,234")], L("3.0")).alias("feedback_count"),
        F.when(k % 2 == 0, F.concat(sz.cast("string"), L(".5%"))).otherwise(L("")).alias("sat_rate"),
        F.when(k % 3 == 0, L("0%")).otherwise(F.concat((sz % 7).cast("string"), L("%"))).alias("apology_rate"),
        F.when(k % 6 == 0, L("")).otherwise(L("12%")).alias("no_citation_rate"),
        F.concat((sz % 10).cast("string"), L(".25%")).alias("pct_users"),
        F.when(k % 2 == 0, L(" 1,234 ")).otherwise(F.concat(L(" "), (sz * 100).cast("string"), L(" "))).alias("user_count"),
        sz.cast("string").alias("tenant_count"),
        case(k % 3, [L(""), L("0")], L("2.5")).alias("active_weeks_p75"),
    )


INTENTS_TEXT_SQL = """SELECT p_partkey AS intent_id,
  CASE p_partkey % 8 WHEN 0 THEN 'SUMMARIZE' WHEN 1 THEN 'CREATE' WHEN 2 THEN 'FIND' WHEN 3 THEN 'EXPLAIN'
    WHEN 4 THEN 'COMPARE' WHEN 5 THEN 'PLAN' WHEN 6 THEN 'SCHEDULE' ELSE 'ZIP' END AS action,
  CASE p_size % 6 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'MEETING' WHEN 2 THEN 'DOCUMENT' WHEN 3 THEN '?'
    WHEN 4 THEN 'DATA' ELSE upper(p_type) END AS object,
  CASE p_partkey % 5 WHEN 0 THEN '?' WHEN 1 THEN '' WHEN 2 THEN 'N/A' ELSE p_name END AS subject,
  CASE p_partkey % 4 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'EMAIL' ELSE '' END AS output,
  CASE WHEN p_partkey % 11 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS action_rank,
  CAST(p_partkey % 10 AS VARCHAR) AS rank_in_action,
  CASE p_partkey % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'true' WHEN 2 THEN 'FALSE' ELSE '' END AS reliable,
  CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN '12' WHEN 2 THEN ' 5 ' WHEN 3 THEN '1,234' ELSE '3.0' END AS feedback_count,
  CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) || '.5%' ELSE '' END AS sat_rate,
  CASE WHEN p_partkey % 3 = 0 THEN '0%' ELSE CAST(p_size % 7 AS VARCHAR) || '%' END AS apology_rate,
  CASE WHEN p_partkey % 6 = 0 THEN '' ELSE '12%' END AS no_citation_rate,
  CAST(p_size % 10 AS VARCHAR) || '.25%' AS pct_users,
  CASE WHEN p_partkey % 2 = 0 THEN ' 1,234 ' ELSE ' ' || CAST(p_size * 100 AS VARCHAR) || ' ' END AS user_count,
  CAST(p_size AS VARCHAR) AS tenant_count,
  CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '0' ELSE '2.5' END AS active_weeks_p75
FROM part"""


SYSTEMS = ["sys_a", "sys_b", "sys_c"]


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long response fact (prompt_id, system, attempt, response, blocked,
    latency_s): attempt n exists only when every earlier attempt of the cell
    was blocked. Built in-row (explode of literal systems and attempts), no
    join and no window."""
    d = documents(spark, sf_dir).select("doc_id", "text")
    d = d.select("doc_id", "text", F.explode(F.array(*[F.lit(s) for s in SYSTEMS])).alias("system"))
    d = d.select("*", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("attempt"))

    def h(tag, att):
        return md5int(F.concat(F.lit(tag), F.col("doc_id").cast("string"), F.lit("|"), F.col("system"),
                               F.lit("|"), att.cast("string")))
    blocked_at = {i: (h("st|", F.lit(i)) % 20 == 1) for i in (1, 2, 3)}
    keep = ((F.col("attempt") == 1) | ((F.col("attempt") == 2) & blocked_at[1])
            | ((F.col("attempt") == 3) & blocked_at[1] & blocked_at[2])
            | ((F.col("attempt") == 4) & blocked_at[1] & blocked_at[2] & blocked_at[3]))
    k = h("st|", F.col("attempt")) % 20
    return d.filter(keep).select(
        F.col("doc_id").alias("prompt_id"), "system", F.col("attempt").cast("bigint").alias("attempt"),
        F.when(k == 0, F.lit("ERROR: Timeout waiting for response"))
         .when(k == 1, F.lit("ERROR: Bot detected - human verification required")).otherwise(F.col("text")).alias("response"),
        (k == 1).alias("blocked"),
        ((h("lat|", F.col("attempt")) % 12000).cast("double") / 100.0).alias("latency_s"))


def _h_sql(x):
    return f"('0x' || substr(md5({x}), 1, 8))::BIGINT"


_K = "'st|' || CAST(doc_id AS VARCHAR) || '|' || system || '|' || CAST(attempt AS VARCHAR)"
_L = "'lat|' || CAST(doc_id AS VARCHAR) || '|' || system || '|' || CAST(attempt AS VARCHAR)"
ATTEMPTS_SQL = f"""SELECT prompt_id, system, attempt, response, blocked, latency_s FROM (
  SELECT doc_id AS prompt_id, system, attempt::BIGINT AS attempt,
    CASE WHEN {_h_sql(_K)} % 20 = 0 THEN 'ERROR: Timeout waiting for response'
         WHEN {_h_sql(_K)} % 20 = 1 THEN 'ERROR: Bot detected - human verification required' ELSE text END AS response,
    ({_h_sql(_K)} % 20 = 1) AS blocked, CAST({_h_sql(_L)} % 12000 AS DOUBLE) / 100.0 AS latency_s,
    coalesce(min(CASE WHEN {_h_sql(_K)} % 20 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, system ORDER BY attempt
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS prev_all_blocked
  FROM documents CROSS JOIN (VALUES ('sys_a'), ('sys_b'), ('sys_c')) AS v(system)
  CROSS JOIN (VALUES (1), (2), (3), (4)) AS a(attempt)) WHERE prev_all_blocked = 1"""


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations per cell; 'error' events act as the in-progress marker."""
    e = balanced(table(spark, sf_dir, "events"))
    # the wall-clock (timestamp_ntz) is read as UTC whatever the session zone
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    ts = F.timestamp_seconds(F.timestamp_diff("MICROSECOND", epoch, F.col("ts")) / 1e6)
    return e.select(F.col("user_id").alias("cell"), ts.alias("ts"),
                    F.col("event_id").alias("seq"),
                    F.when(F.col("event_type") == "error", F.lit("Thinking"))
                     .otherwise(F.concat(F.col("event_type"), F.lit("x" * 30))).alias("text"))


POLLS_SQL = """SELECT user_id AS cell, ts, event_id AS seq,
  CASE WHEN event_type = 'error' THEN 'Thinking' ELSE event_type || repeat('x', 30) END AS text FROM events"""


def model_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses in four shapes: clean array, array inside prose, fenced
    array, no array."""
    p = balanced(table(spark, sf_dir, "part"))
    k = F.col("p_partkey") % 4
    L = F.lit
    content = (F.when(k == 0, F.concat(L('[{"prompt":"'), F.col("p_name"),
                                       L('","variant_type":"direct_request","evaluation_dimensions":["accuracy"]}]')))
                .when(k == 1, F.concat(L('Sure: [{"prompt":"'), F.col("p_name"), L('"},{"prompt":"'), F.col("p_brand"),
                                       L('","complexity_level":"expert"}] done')))
                .when(k == 2, F.concat(L("```json\n"), L('[{"prompt":"'), F.col("p_type"), L('"}]'), L("\n```")))
                .otherwise(F.concat(L("no json for "), F.col("p_name"))))
    return p.select(F.col("p_partkey").alias("intent_id"), content.alias("content"))


MODEL_OUTPUT_SQL = """SELECT p_partkey AS intent_id, CASE p_partkey % 4
  WHEN 0 THEN '[{"prompt":"' || p_name || '","variant_type":"direct_request","evaluation_dimensions":["accuracy"]}]'
  WHEN 1 THEN 'Sure: [{"prompt":"' || p_name || '"},{"prompt":"' || p_brand || '","complexity_level":"expert"}] done'
  WHEN 2 THEN '```json' || chr(10) || '[{"prompt":"' || p_type || '"}]' || chr(10) || '```'
  ELSE 'no json for ' || p_name END AS content FROM part"""


CRITERIA = ["accuracy", "helpfulness", "completeness", "clarity", "safety", "efficiency"]


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents x 3 systems x 3 raters x 6 criteria, rating 1..5 by hash
    (expanded in-row with explode; no join)."""
    d = balanced(table(spark, sf_dir, "documents")).select("doc_id")
    d = d.select("doc_id", F.explode(F.array(*[F.lit(s) for s in SYSTEMS])).alias("system"))
    d = d.select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("rater"))
    d = d.select("*", F.explode(F.array(*[F.lit(c) for c in CRITERIA])).alias("criterion"))
    key = F.concat_ws("|", F.lit("rt"), F.col("doc_id").cast("string"), F.col("system"),
                      F.col("rater").cast("string"), F.col("criterion"))
    return d.select(F.col("doc_id").alias("prompt_id"), "system", F.col("rater").cast("bigint").alias("rater"),
                    "criterion", (F.lit(1) + md5int(key) % 5).cast("int").alias("rating"))


RATINGS_SQL = f"""SELECT doc_id AS prompt_id, v.system, r.rater::BIGINT AS rater, k.criterion,
  CAST(1 + {_h_sql("concat_ws('|', 'rt', CAST(doc_id AS VARCHAR), v.system, CAST(r.rater AS VARCHAR), k.criterion)")} % 5 AS INT) AS rating
FROM documents CROSS JOIN (VALUES ('sys_a'), ('sys_b'), ('sys_c')) AS v(system)
  CROSS JOIN (VALUES (1), (2), (3)) AS r(rater)
  CROSS JOIN (VALUES ('accuracy'), ('helpfulness'), ('completeness'), ('clarity'), ('safety'), ('efficiency')) AS k(criterion)"""
