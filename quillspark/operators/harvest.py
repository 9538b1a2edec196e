"""Harvest: multi-source prompt tables -> filtered, keep-first deduplicated,
labelled prompts, plus summary tables.

Dedup is computed on a narrow projection (row id, key, length) with
aggregations (partial aggregation on the map side, so a hot key costs one
row per map task), then the wide rows are picked with one join on the unique row
id. Copies are told by the full md5; ``prompt_id`` prints its first 12 digits. Text crosses the network once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.text import norm_key, strip_ws
from ..session import ensure_checkpoint_dir
from . import label as L
from .key_index import key_of

ROW_ID = ["source_ord", "seq"]
FULL = 32  # hex digits of the key that decides which rows are copies


def first_n_per(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """First ``n`` rows per group. ``row_number() <= n`` plans as a
    WindowGroupLimit (partial top-n before the shuffle), so a huge group only
    ships n rows per map task."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def harvest_prompts(raw: DataFrame, *, per_source_limit: int | None = None, mode: str = "full",
                    min_len: int = 15, max_len: int = 5000) -> DataFrame:
    """raw: (source, source_ord, seq, text, language?) -> one row per kept prompt
    with prompt_id, prompt_text, prompt_length.

    full: strip -> too short dropped -> key recorded (keep-first per source)
          -> too long dropped (a too-long first copy shadows later copies)
          -> first N per source -> keep-first across sources (source order).
    lite: key recorded before both length tests.

    Plan: one narrow scan (row id, key, length) -> hash aggregate per
    (source, key) carrying the first copy's seq and length -> hash aggregate
    per key picking the lowest source -> one join of the wide rows on the
    unique row id. Both aggregates combine map-side, so a key holding a third
    of all rows ships one row per map task; (source, seq) is unique, so the
    final join has no hot key.
    """
    narrow = raw.select("source", *ROW_ID, strip_ws(F.col("text")).alias("_p"), "text")
    narrow = narrow.select("source", *ROW_ID, F.length("_p").cast("bigint").alias("prompt_length"),
                           norm_key(F.col("text") if mode == "lite" else F.col("_p"), FULL).alias("_key"))
    # keep-first per (source, key) among rows long enough to record a key:
    # the first copy's seq and its length. The length test sits inside the
    # aggregate (not a filter under it) so the text work runs after the
    # scan's split, in parallel, instead of being pushed into the scan task.
    counted = F.col("prompt_length") >= (min_len if mode == "full" else 1)
    first_seq = F.when(counted, F.col("seq"))
    w1 = (narrow.groupBy("source", "source_ord", "_key")
                .agg(F.min(first_seq).alias("seq"), F.min_by("prompt_length", first_seq).alias("prompt_length")))
    w1 = w1.filter(F.col("seq").isNotNull() & F.col("prompt_length").between(min_len, max_len))
    if per_source_limit is not None:
        w1 = first_n_per(w1, "source", ["seq"], per_source_limit)
    # keep-first across sources: a key occurs once per source here, so the
    # lowest source_ord identifies the kept copy
    w2 = w1.groupBy("_key").agg(F.min("source_ord").alias("source_ord"),
                                     F.min_by("seq", "source_ord").alias("seq"),
                                     F.min_by("prompt_length", "source_ord").alias("prompt_length"))
    # texts that cannot win for their length stay out of the join
    wide = (raw.filter(F.length("text") >= min_len).withColumn("prompt_text", strip_ws(F.col("text"))).drop("text")
               .filter(F.length("prompt_text").between(min_len, max_len)))
    return w2.join(wide, ROW_ID).withColumn("prompt_id", F.substring("_key", 1, 12)).drop("_key")


def dedup_report(raw: DataFrame, *, min_len: int = 15, max_len: int = 5000) -> DataFrame:
    """Per source: rows read, dropped as too short, removed as in-source copies,
    dropped as too long, removed as cross-source copies, kept (full mode)."""
    narrow = (raw.select("source", *ROW_ID, strip_ws(F.col("text")).alias("p"))
                 .select("source", *ROW_ID, F.length("p").cast("bigint").alias("len"),
                         norm_key(F.col("p"), FULL).alias("_key")))
    read = narrow.groupBy("source").agg(F.count(F.lit(1)).alias("n_read"),
                                        F.count_if(F.coalesce(F.col("len"), F.lit(0)) < min_len).alias("n_short"))
    w1 = (narrow.filter(F.col("len") >= min_len).groupBy("source", "source_ord", "_key")
                .agg(F.min("seq").alias("seq"), F.min_by("len", "seq").alias("len")))
    firsts = w1.groupBy("source").agg(F.count(F.lit(1)).alias("n_first"),
                                      F.count_if(F.col("len") > max_len).alias("n_long"))
    ok = w1.filter(F.col("len") <= max_len)
    kept = (ok.groupBy("_key").agg(F.min("source_ord").alias("source_ord"))
              .join(ok.select("source", "source_ord").distinct(), "source_ord")
              .groupBy("source").agg(F.count(F.lit(1)).alias("n_kept")))
    out = read.join(firsts, "source", "left").join(kept, "source", "left").na.fill(0)
    return out.select(
        "source", "n_read", "n_short",
        (F.col("n_read") - F.col("n_short") - F.col("n_first")).alias("n_copy_in_source"),
        "n_long",
        (F.col("n_first") - F.col("n_long") - F.col("n_kept")).alias("n_copy_across"),
        "n_kept")


def first_turn_prompts(conv: DataFrame, *, role: str = "user", min_len: int = 10,
                       context_min: int = 5) -> DataFrame:
    """Conversation table (conv_id, turn, role, text) -> one prompt per
    conversation: its first user message; a leading system message longer than
    ``context_min`` after stripping is appended as labelled context; prompts of
    ``min_len`` characters or less are dropped."""
    first = conv.groupBy("conv_id").agg(
        F.min_by(F.struct("role", "text"), "turn").alias("first"),
        F.min_by("text", F.when(F.col("role") == role, F.col("turn"))).alias("user_text"))
    ctx = strip_ws(F.col("first.text"))
    prompt = F.when((F.col("first.role") == "system") & (F.length(ctx) > context_min),
                    F.concat(F.col("user_text"), F.lit("\n\nContext: "), ctx)).otherwise(F.col("user_text"))
    out = first.select("conv_id", F.col("first.role").alias("first_role"),
                       strip_ws(prompt).alias("prompt_text"))
    return (out.filter(F.length("prompt_text") > min_len)
               .withColumn("prompt_length", F.length("prompt_text").cast("bigint")))


def first_copies(incoming: DataFrame, *, min_len: int = 10) -> DataFrame:
    """(key, seq): the first row of each prompt longer than ``min_len`` in a batch. The
    prompt itself stays behind; its key is the md5 of the stripped text."""
    p = strip_ws(F.col("text"))
    return (incoming.select("seq", p.alias("p")).where(F.length("p") > min_len)
                    .select("seq", key_of(F.col("p")).alias("key")).groupBy("key").agg(F.min("seq").alias("seq")))


def append_rows(incoming: DataFrame, new: DataFrame, *, run_date: str = "2026-01-06", source: str = "LMSYS_Arena") -> DataFrame:
    """The rows of ``incoming`` that ``new`` (seq) names, labelled, columns in sink order."""
    rows = (incoming.join(new.select("seq"), "seq", "left_semi")
                    .select("seq", strip_ws(F.col("text")).alias("Prompt"), F.col("language").alias("Language")))
    rows = L.label_intent_rules(L.with_lower(rows, "Prompt"), out="Intent").drop(L.LOWER)
    return rows.select(F.lit(run_date).alias("Date Added"), F.lit(source).alias("Source"), "Intent", "Prompt",
                       F.coalesce("Language", F.lit("unknown")).alias("Language"), "seq")


def incremental_append(incoming: DataFrame, loaded: DataFrame, *, min_len: int = 10,
                       run_date: str = "2026-01-06", source: str = "LMSYS_Arena") -> DataFrame:
    """Rows to append: stripped prompt longer than ``min_len``, not already
    loaded, first copy within the batch (by seq). Only 16-byte keys and row
    numbers are exchanged before the last join. A load that is repeated keeps
    its keys in a ``KeyIndex`` instead of reading ``loaded`` again."""
    have = loaded.select(key_of(strip_ws(F.col("text"))).alias("key"))
    new = first_copies(incoming, min_len=min_len).join(have, "key", "left_anti")
    return append_rows(incoming, new, run_date=run_date, source=source)


def label_prompts(df: DataFrame, *, mode: str = "full", run_date: str = "2026-01-06") -> DataFrame:
    """All row labels of the harvested record (no shuffle). Write the result before
    filtering on a label: a filter is pushed below the labels and works them out again."""
    full = mode == "full"
    vocabs = ([V.INTENT_FULL, V.DIFFICULTY_FULL, V.PRODUCTS_FULL, V.CAPABILITIES_FULL, V.EXPECTED_RESPONSE_FLAGS]
              if full else [V.INTENT_LITE, V.DIFFICULTY_LITE, V.PRODUCTS_LITE, V.CAPABILITIES_LITE])
    df = L.with_lower(df, "prompt_text")
    # every distinct keyword is tested once per row; all labels read the flags
    df, kw = L.with_keyword_flags(df, L.vocabulary_keywords(*vocabs))
    df = L.label_intent(df, V.INTENT_FULL if full else V.INTENT_LITE, subcategory=full, kw=kw)
    df = L.label_difficulty(df, V.DIFFICULTY_FULL if full else V.DIFFICULTY_LITE, kw=kw)
    df = L.label_products(df, V.PRODUCTS_FULL if full else V.PRODUCTS_LITE, codes=full, kw=kw)
    df = L.label_capabilities(df, V.CAPABILITIES_FULL if full else V.CAPABILITIES_LITE, kw=kw)
    if full:
        df = L.label_expected_response(df, kw=kw)
        lang = F.coalesce(F.nullif(F.col("language"), F.lit("")), L.language_expr("prompt_text", "cascade"))
    else:
        lang = L.language_expr("prompt_text", "lite")
    df = df.withColumns({"language": lang,
                         "date_harvested": F.to_date(F.lit(run_date))})
    return df.drop(L.LOWER, kw.out)


EVAL_COLUMNS = ["copilot_rating", "chatgpt_rating", "gemini_rating", "claude_rating", "winner", "evaluation_notes"]


def add_eval_columns(df: DataFrame) -> DataFrame:
    """Blank evaluation columns, added only when absent."""
    return df.withColumns({c: F.lit(None).cast("string") for c in EVAL_COLUMNS if c not in df.columns})


# -- summary -----------------------------------------------------------------

CAP_NAMES = [c for c, _ in V.CAPABILITIES_FULL]


def harvest_summary(labelled: DataFrame, *, mode: str = "full", top_languages: int = 10) -> DataFrame:
    """Whole summary as one long (metric, key, value) table.

    One GROUPING SETS aggregate ((source), (intent), (level), (language), ())
    computes every measure in a single scan. Its tiny output is checkpointed for
    the branches below: their filters on the grouping id would be pushed under the
    aggregate, so that each of them worked the labels out again."""
    ms = F.col("is_microsoft_related").cast("int")
    aggs = [F.count(F.lit(1)).cast("double").alias("n"),
            F.sum(ms).cast("double").alias("ms_n"),
            F.avg(ms).alias("ms_avg"),
            F.avg("prompt_length").alias("len_avg"),
            F.avg("difficulty_score").alias("score_avg")]
    aggs += [F.sum(F.col(c).cast("int")).cast("double").alias(c) for c in CAP_NAMES]
    dims = ["source", "primary_intent", "difficulty_level", "language"]
    g = (labelled.groupingSets([[d] for d in dims] + [[]], *dims)
                 .agg(*aggs, F.grouping_id().alias("gid")))
    ensure_checkpoint_dir(labelled.sparkSession)
    g = g.checkpoint()
    # gid bit i is 1 when dims[i] is rolled up (leftmost column = highest bit)
    def gid_of(d):
        return sum(1 << (len(dims) - 1 - i) for i, x in enumerate(dims) if x != d)
    parts = []
    for d, metric in zip(dims[:3], ["by_source", "by_intent", "by_difficulty"]):
        parts.append(g.filter(F.col("gid") == gid_of(d))
                      .select(F.lit(metric).alias("metric"), F.col(d).alias("key"), F.col("n").alias("value")))
    parts.append(g.filter(F.col("gid") == gid_of("language"))
                  .orderBy(F.desc("n"), F.asc("language")).limit(top_languages)
                  .select(F.lit("by_language").alias("metric"), F.col("language").alias("key"),
                          F.col("n").alias("value")))
    tot = g.filter(F.col("gid") == (1 << len(dims)) - 1)
    avg_len = (F.round(F.col("len_avg"), 0) if mode == "full" else F.floor(F.col("len_avg")).cast("double"))
    scal = [("total_prompts", F.col("n")), ("microsoft_related_count", F.col("ms_n")),
            ("microsoft_related_percentage", F.round(F.col("ms_avg") * 100, 2)),
            *[(c.replace("requires_", "cap_"), F.col(c)) for c in CAP_NAMES],
            ("avg_prompt_length", avg_len), ("avg_difficulty_score", F.round(F.col("score_avg"), 2))]
    parts.append(tot.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value"))
                                                 for k, v in scal])).alias("s"))
                    .select(F.col("s.metric").alias("metric"), F.lit(None).cast("string").alias("key"),
                            F.col("s.value").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
