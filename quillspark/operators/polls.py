"""Completion detection over ordered poll observations (cell, ts, seq, text).

Batch form of the polling loops: a change flag from the previous poll, runs
(gaps and islands) with their start and row number, and per-run measures; the
first completing poll per cell is picked with a grouped ``min(struct)``.
Order is (ts, seq), which names a poll of a cell. Runs are a segmented scan:
ranges of (cell, ts, seq) are scanned on their own, one summary row per range
and cell is combined once, and its result is what a range carries in. A cell
holding a large share of all polls is split over many tasks. Texts are told
by their md5; the text itself is fetched last, for the polls that are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_contains

# FIXED VALUES: loop constants (seconds / characters / polls)
MIN_LEN = 30
MARKERS = ["Thinking", "Generating"]
STABLE_MIN_LEN = 20
STABLE_POLLS = 3


def _epoch(c: Column) -> Column:
    return c.cast("timestamp").cast("double")


def _as_repeat(val: Column, repeats: Column, before: Column) -> Column:
    return F.coalesce(repeats & (val == before), F.lit(False))


def scan_runs(rows: DataFrame, *, parts: int | None = None) -> DataFrame:
    """Runs of equal values per cell. ``rows``: cell, t, seq, val (the value that is
    compared), size (its length), repeats (it may continue a run), counts (other rows
    only tell when the cell began). Returns the counting rows with change (a run starts
    here), run_start (time of the run's first row), run_rn (number in the run),
    prev_size (of the value before, 0 without one) and start (time of the cell's first row).

    Range partitions of (cell, t, seq) are kept in the checkpoint folder, so that
    ranges stay what they are. Within a range, windows over (range, cell) find all
    run starts but the first row's, which depends on the value carried in. Summaries
    (a row per range and cell) hold the first and last value, the last run start found,
    the number of rows and the earliest time; in the order of a cell's ranges they
    compose to what each range carries in."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = (rows.select("cell", "t", "seq", "val", "size", "repeats", "counts").repartitionByRange(parts, "cell", "t", "seq")
             .withColumn("_range", F.spark_partition_id()).checkpoint())
    w = Window.partitionBy("_range", "cell").orderBy("t", "seq")
    upto, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    counts = F.col("counts")
    x = x.withColumns({"_prev": F.last(F.when(counts, F.struct("val", "size")), ignorenulls=True).over(earlier),
                       "_rn": F.sum(counts.cast("long")).over(upto)})
    opens = counts & F.col("_prev").isNull()
    known = counts & F.col("_prev").isNotNull() & ~_as_repeat(F.col("val"), F.col("repeats"), F.col("_prev.val"))
    x = x.withColumn("_run", F.last(F.when(known, F.struct(F.col("_rn").alias("i"), F.col("t").alias("t"))), ignorenulls=True).over(upto))
    s = x.groupBy("_range", "cell").agg(
        F.min("t").alias("_t0"), F.sum(counts.cast("long")).alias("_n"),
        F.max(F.when(opens, F.struct("val", "repeats", "t"))).alias("_first"),
        F.max(F.when(counts, F.struct("t", "seq", "val", "size"))).alias("_last"), F.max("_run").alias("_lastrun"))
    c = Window.partitionBy("cell").orderBy("_range")
    before = c.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"_in": F.last("_last", ignorenulls=True).over(before), "_before": F.coalesce(F.sum("_n").over(before), F.lit(0)),
                       "start": F.min("_t0").over(c.rowsBetween(Window.unboundedPreceding, 0))})
    starts = F.col("_first").isNotNull() & ~_as_repeat(F.col("_first.val"), F.col("_first.repeats"), F.col("_in.val"))
    s = s.withColumn("_opens", F.when(starts, F.struct((F.col("_before") + 1).alias("i"), F.col("_first.t").alias("t"))))
    ends = F.coalesce(F.when(F.col("_lastrun").isNotNull(), F.struct((F.col("_lastrun.i") + F.col("_before")).alias("i"), F.col("_lastrun.t").alias("t"))), "_opens")
    s = s.withColumn("_carry", F.coalesce("_opens", F.last(ends, ignorenulls=True).over(before)))
    s = s.select("_range", "cell", "start", "_before", "_in", "_opens", "_carry")
    own = F.when(F.col("_run").isNotNull(), F.struct((F.col("_run.i") + F.col("_before")).alias("i"), F.col("_run.t").alias("t")))
    x = x.join(s, ["_range", "cell"]).where("counts").withColumn("_at", F.coalesce(own, "_carry"))
    return x.select("cell", "t", "seq", "val", "size", "repeats", "start",
                    (known | opens & F.col("_opens").isNotNull()).alias("change"), F.col("_at.t").alias("run_start"),
                    (F.col("_rn") + F.col("_before") - F.col("_at.i") + 1).alias("run_rn"),
                    F.coalesce("_prev.size", "_in.size", F.lit(0)).alias("prev_size"))


def runs(polls: DataFrame, *, min_len: int = MIN_LEN, markers=MARKERS) -> DataFrame:
    """Marker rows reset the remembered text; rows shorter than ``min_len`` are
    ignored; every other row either repeats the remembered text or starts a
    run. Adds is_marker, change, start and run_start (epoch s), t (epoch s),
    run_rn, size and prev_size (lengths of the text and the remembered one)."""
    marker = any_contains(F.col("text"), markers)
    rows = polls.select("cell", _epoch(F.col("ts")).alias("t"), "seq", marker.alias("m"), F.length("text").alias("n"),
                        F.unhex(F.md5("text")).alias("h"))
    rows = rows.select("cell", "t", "seq", F.when(F.col("m"), F.lit(b"")).otherwise(F.col("h")).alias("val"),
                       F.when(F.col("m"), 0).otherwise(F.col("n")).alias("size"), (~F.col("m")).alias("repeats"),
                       F.coalesce(F.col("m") | (F.col("n") >= min_len), F.lit(False)).alias("counts"))
    r = scan_runs(rows).withColumn("is_marker", ~F.col("repeats"))
    return r.withColumn("change", F.col("change") & ~F.col("is_marker"))


def with_text(picked: DataFrame, polls: DataFrame, at: str) -> DataFrame:
    """``picked`` with the text of the poll that the struct ``at`` (t, seq) names, if it names one."""
    texts = polls.select(F.col("cell").alias("_c"), _epoch(F.col("ts")).alias("_t"), F.col("seq").alias("_s"), "text")
    return picked.join(texts, (F.col("cell") == F.col("_c")) & (F.col(f"{at}.t") == F.col("_t")) & (F.col(f"{at}.seq") == F.col("_s")),
                       "left").drop("_c", "_t", "_s")


def quiescence(polls: DataFrame, *, gap_s: float, timeout_s: float) -> DataFrame:
    """Per cell: complete when the same text has been seen for ``gap_s``
    seconds since its last change (latency = last change - start); after
    ``timeout_s`` the remembered text is returned as partial (latency =
    last change - start if it was confirmed by a repeat, else the timeout),
    or an error with latency 0 when nothing usable is remembered."""
    r = runs(polls).filter(F.col("t") - F.col("start") < timeout_s)
    quiet = ~F.col("is_marker") & (F.col("t") - F.col("run_start") >= gap_s)
    j = r.groupBy("cell").agg(F.min(F.when(quiet, F.struct("t", "seq", "run_start", "start"))).alias("d"),
                              F.max(F.struct("t", "seq", "is_marker", "run_start", "run_rn", "start")).alias("l"))
    complete = F.col("d").isNotNull()
    partial = ~complete & ~F.col("l.is_marker")
    j = j.withColumn("at", F.when(complete, F.struct("d.t", "d.seq")).when(partial, F.struct("l.t", "l.seq")))
    return with_text(j, polls, "at").select(
        "cell",
        F.when(complete, F.lit("complete")).when(partial, F.lit("partial")).otherwise(F.lit("error")).alias("status"),
        F.when(complete | partial, F.col("text")).otherwise(F.lit("ERROR: Timeout waiting for response")).alias("response"),
        F.when(complete, F.col("d.run_start") - F.col("d.start"))
         .when(partial, F.when(F.col("l.run_rn") > 1, F.col("l.run_start") - F.col("l.start")).otherwise(F.lit(float(timeout_s))))
         .otherwise(F.lit(0.0)).alias("latency_s"),
        F.when(complete, F.col("d.t")).alias("done_at"))


def growth(polls: DataFrame) -> DataFrame:
    """Length growth at every change of the remembered text."""
    r = runs(polls).filter(F.col("change"))
    return r.select("cell", "seq", F.col("t").alias("at"), (F.col("size") - F.col("prev_size")).cast("bigint").alias("growth"))


def stable_polls(polls: DataFrame, *, n: int = STABLE_POLLS, min_len: int = STABLE_MIN_LEN) -> DataFrame:
    """Complete at the poll where the same text (longer than ``min_len``) has
    been seen ``n`` more times in a row; else the last text seen."""
    rows = polls.select("cell", _epoch(F.col("ts")).alias("t"), "seq", F.unhex(F.md5("text")).alias("val"), F.length("text").alias("size"),
                        F.coalesce(F.length("text") > min_len, F.lit(False)).alias("repeats"), F.lit(True).alias("counts"))
    j = scan_runs(rows).groupBy("cell").agg(F.min(F.when(F.col("run_rn") > n, F.struct("t", "seq"))).alias("d"),
                                            F.max(F.struct("t", "seq")).alias("l"))
    complete = F.col("d").isNotNull()
    j = with_text(j.withColumn("at", F.coalesce("d", "l")), polls, "at")
    return j.select("cell", F.when(complete, F.lit("complete")).otherwise(F.lit("timeout")).alias("status"),
                    F.col("text").alias("response"), F.when(complete, F.col("d.seq")).alias("done_seq"))
