"""Collected responses: parsing model output, extracting answers from page
text, block-page detection, and the long attempts fact (status, latest
attempt, retry queue, success and progress measures).

Attempts are kept long - one row per (prompt, system, attempt) - so adding a
system adds rows, not columns; the wide per-system layout is a pivot at the
sink. "Latest attempt wins" replaces in-place updates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab as V
from ..functions.text import WS, any_contains, strip_ws

ITEM = T.ArrayType(T.StructType([
    T.StructField("prompt", T.StringType()),
    T.StructField("variant_type", T.StringType()),
    T.StructField("complexity_level", T.StringType()),
    T.StructField("expected_response_criteria", T.ArrayType(T.StringType())),
    T.StructField("evaluation_dimensions", T.ArrayType(T.StringType())),
]))

WRAPPED = T.StructType([T.StructField("v", ITEM)])

# FIXED VALUES: answer markers, end markers, loading markers, placeholders
SPEAKER_MARKER = "Copilot said"
END_MARKERS = ["You said", "Smart", "Today", "Message Copilot"]
LOADING_MARKERS = ["Generating", "Thinking", "Searching", "Analyzing", "..."]
PLACEHOLDERS = ["API_NOT_AVAILABLE", "API_ERROR", "MANUAL_EVALUATION_REQUIRED"]


# -- model output -> rows --------------------------------------------------------

def parse_items(content: Column) -> Column:
    """Recover a JSON array: the whole text, else the greedy [...] span, else a
    fenced block; null when none parses."""
    def strict(text: Column) -> Column:
        # wrapped in an object so the parser must consume the whole candidate:
        # trailing text after the array is an error, as in a strict JSON load
        return F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), WRAPPED).getField("v")
    whole = strict(content)
    greedy = strict(F.regexp_extract(content, r"\[[\s\S]*\]", 0))
    fenced = strict(F.regexp_extract(content, r"```(?:json)?\s*([\s\S]*?)\s*```", 1))
    return F.coalesce(whole, greedy, fenced)


def response_rows(outputs: DataFrame, intents: DataFrame) -> DataFrame:
    """One row per generated item, joined back to its intent's metadata;
    missing fields default to unknown / medium / []."""
    items = outputs.select("intent_id", F.posexplode(parse_items(F.col("content"))).alias("pos", "it"))
    rows = items.select(
        "intent_id", F.col("pos").cast("bigint").alias("pos"),
        F.coalesce(F.col("it.prompt"), F.lit("")).alias("synthetic_prompt"),
        F.coalesce(F.col("it.variant_type"), F.lit("unknown")).alias("prompt_variant_type"),
        F.coalesce(F.col("it.complexity_level"), F.lit("medium")).alias("complexity_level"),
        F.to_json(F.coalesce(F.col("it.expected_response_criteria"), F.array().cast("array<string>"))).alias("expected_response_criteria"),
        F.to_json(F.coalesce(F.col("it.evaluation_dimensions"), F.array().cast("array<string>"))).alias("evaluation_dimensions"))
    return rows.join(intents.select("intent_id", "action", "object", "subject", "output"), "intent_id")


# -- page text -> answer ------------------------------------------------------------

def extract_answer(body: Column) -> Column:
    """Text after the last speaker marker, cut at each end marker in turn."""
    r = strip_ws(F.element_at(F.split(body, SPEAKER_MARKER), -1))
    for m in END_MARKERS:
        r = F.when(r.contains(m), strip_ws(F.substring_index(r, m, 1))).otherwise(r)
    return F.when(body.contains(SPEAKER_MARKER), r).otherwise(F.lit(""))


def in_progress(body: Column) -> Column:
    return any_contains(F.right(body, F.lit(100)), LOADING_MARKERS)


def last_blocks(df: DataFrame, group: str, order: str, text: str, n: int = 5, min_len: int = 5) -> DataFrame:
    """Per group: the last ``n`` blocks, those longer than ``min_len`` kept,
    stripped, newline-joined. ``row_number() <= n`` is pre-limited map-side."""
    w = Window.partitionBy(group).orderBy(F.col(order).desc())
    last = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    agg = last.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("_b"))
    kept = F.filter(F.col("_b"), lambda b: F.length(b[text]) > min_len)
    return agg.select(group, F.array_join(F.transform(kept, lambda b: strip_ws(b[text])), "\n").alias("last_blocks"))


def response_extract(conv: DataFrame) -> DataFrame:
    """Per conversation: answer extracted from the last assistant page text,
    the longest assistant turn that does not echo the prompt's first 30
    characters, and the last-blocks join."""
    c = conv.withColumn("body", F.concat(F.lit(SPEAKER_MARKER + " "), F.col("text"),
                                         F.element_at(F.array(F.lit(" You said more"), F.lit(" Message Copilot"), F.lit("")),
                                                      (F.pmod(F.col("turn"), F.lit(3)) + 1).cast("int"))))
    prompt = c.groupBy("conv_id").agg(F.min_by(F.when(F.col("role") == "user", F.col("text")),
                                               F.when(F.col("role") == "user", F.col("turn"))).alias("prompt"))
    asst = c.filter(F.col("role") == "assistant").join(prompt, "conv_id", "left")
    echo = F.coalesce(F.col("prompt"), F.lit("")) != ""
    echo = echo & F.col("text").contains(F.left(F.col("prompt"), F.lit(30)))
    per = asst.groupBy("conv_id").agg(
        F.max_by(extract_answer(F.col("body")), F.col("turn")).alias("answer"),
        F.max_by(F.when(~echo, F.col("text")), F.when(~echo, F.struct(F.length("text"), -F.col("turn")))).alias("best_candidate"),
        F.count_if(echo).cast("bigint").alias("echo_candidates"))
    return per.join(last_blocks(asst, "conv_id", "turn", "text"), "conv_id", "left")


def block_pages(pages: DataFrame) -> DataFrame:
    lower = F.lower(F.col("html"))
    first = None
    for p in V.BLOCK_PAGE_PHRASES:
        first = F.when(lower.contains(p), F.lit(p)) if first is None else first.when(lower.contains(p), F.lit(p))
    return pages.select("page_id", "url", first.isNotNull().alias("is_block_page"), first.alias("matched_phrase"))


# -- attempts ---------------------------------------------------------------------------

def status(response: Column, blocked: Column) -> Column:
    return (F.when(blocked, F.lit("blocked"))
             .when(response.startswith("ERROR"), F.lit("error"))
             .when(response.isin(*PLACEHOLDERS), F.lit("placeholder"))
             .otherwise(F.lit("ok")))


def with_status(attempts: DataFrame) -> DataFrame:
    return attempts.withColumn("status", status(F.col("response"), F.col("blocked")))


STATUS_CODES = ["ok", "blocked", "error", "placeholder"]


def latest_status(slim: DataFrame) -> DataFrame:
    """Latest attempt per cell over (prompt_id, system, attempt, status,
    latency_s). Status travels as a small int so every aggregate buffer is
    fixed-width (hash aggregate with map-side combine, no sort)."""
    code = F.array_position(F.array(*[F.lit(x) for x in STATUS_CODES]), F.col("status")).cast("int")
    agg = (slim.withColumn("_code", code).groupBy("prompt_id", "system")
               .agg(F.max("attempt").alias("attempt"), F.max_by("_code", "attempt").alias("_code"),
                    F.max_by("latency_s", "attempt").alias("latency_s")))
    return agg.select("prompt_id", "system", "attempt",
                      F.element_at(F.array(*[F.lit(x) for x in STATUS_CODES]), F.col("_code")).alias("status"),
                      "latency_s")


def latest_attempt(attempts: DataFrame) -> DataFrame:
    """One row per (prompt, system): the highest attempt wins (keyed update)."""
    cols = [c for c in attempts.columns if c not in ("prompt_id", "system")]
    return (attempts.groupBy("prompt_id", "system")
                    .agg(F.max_by(F.struct(*cols), "attempt").alias("_l"))
                    .select("prompt_id", "system", "_l.*"))


def retry_queue(attempts: DataFrame, max_attempts: int = 4) -> DataFrame:
    """Cells to send again: latest attempt blocked and the attempt budget left."""
    last = (attempts.groupBy("prompt_id", "system")
                    .agg(F.max("attempt").alias("attempt"), F.max_by("blocked", "attempt").alias("blocked")))
    return last.filter(F.col("blocked") & (F.col("attempt") < max_attempts)) \
               .select("prompt_id", "system", (F.col("attempt") + 1).alias("next_attempt"))


def retry_rounds(attempts: DataFrame, max_attempts: int = 4) -> DataFrame:
    """The queue after every collection round: each blocked attempt with budget
    left asks for the next one; ``open`` tells that it has not been sent yet.
    A cell has at most ``max_attempts`` rows."""
    w = Window.partitionBy("prompt_id", "system").orderBy("attempt")
    seen = attempts.select("prompt_id", "system", "attempt", "blocked").withColumn("open", F.lead("attempt").over(w).isNull())
    return (seen.filter(F.col("blocked") & (F.col("attempt") < max_attempts))
                .select("prompt_id", "system", (F.col("attempt") + 1).alias("next_attempt"), "open"))


def _slim(attempts: DataFrame) -> DataFrame:
    """Status computed row-wise first, so the text never crosses a shuffle."""
    return with_status(attempts).select("prompt_id", "system", "attempt", "status", "latency_s")


def system_success(attempts: DataFrame) -> DataFrame:
    last = latest_status(_slim(attempts))
    return last.groupBy("system").agg(F.count_if(F.col("status") == "ok").cast("bigint").alias("ok"),
                                      F.count(F.lit(1)).cast("bigint").alias("cells"))


def attempt_stats(attempts: DataFrame) -> DataFrame:
    """Attempt-level counts (retries raise the denominator) and the
    cell-level success rate over latest attempts."""
    a = _slim(attempts)
    per = a.groupBy("system").agg(
        F.count(F.lit(1)).cast("bigint").alias("queries"),
        F.count_if(F.col("status") == "ok").cast("bigint").alias("ok"),
        F.count_if(F.col("status") == "blocked").cast("bigint").alias("blocked"),
        F.count_if(F.col("status") == "error").cast("bigint").alias("errors"),
        F.round(F.avg(F.col("latency_s")), 4).alias("avg_latency_s"))
    per = per.withColumn("success_rate", F.round(F.col("ok") / F.col("queries") * 100, 2))
    cell = latest_status(_slim(attempts)).groupBy("system").agg(
        F.round(F.avg((F.col("status") == "ok").cast("int")) * 100, 2).alias("cell_success_rate"))
    return per.join(cell, "system")


def completion_progress(attempts: DataFrame) -> DataFrame:
    """Prompts with at least one usable answer, and the truncated percent."""
    last = latest_status(_slim(attempts))
    per = last.groupBy("prompt_id").agg(F.max((F.col("status") == "ok").cast("int")).alias("done"))
    return per.agg(F.count(F.lit(1)).cast("bigint").alias("total"),
                   F.sum("done").cast("bigint").alias("completed")) \
              .withColumn("progress_pct",
                          F.when(F.col("total") > 0, F.floor(F.col("completed") * 100 / F.col("total"))).otherwise(F.lit(0))
                          .cast("bigint"))
