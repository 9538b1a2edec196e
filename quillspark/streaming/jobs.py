"""Structured Streaming forms of the incremental load, completion sessions
and running statistics. Each job reads a file source, runs with a checkpoint
under the cluster's shared ``spark.checkpoint.dir`` (restartable after an
executor or driver loss), and writes an idempotent sink; the caller gets the
sink back as a batch DataFrame.

Inputs are staged in ranges of their order by one parallel job; every range is
one run with ``trigger(availableNow=True)``, which goes on from the checkpoint
of the run before, as a continuous job would after a restart.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.text import norm_key, strip_ws
from ..operators import collect as CO
from ..operators import label as L
from ..operators.harvest import append_rows, first_copies
from ..operators.key_index import KeyIndex, key_of
from ..session import ensure_checkpoint_dir


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run under the shared checkpoint dir."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, base: str, order: str, parts: int) -> None:
    """Write ``df`` in ``parts`` ranges of ``order``, several files each, in one job
    (after one pass over ``order`` alone for the bounds). Rows without an order
    value come first."""
    bounds = df.select(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10000).alias("b")).first()["b"]
    part = F.lit(0)
    for edge in sorted(set(bounds or [])):
        part = part + F.coalesce(F.col(order) > edge, F.lit(False)).cast("int")
    part_of = df.withColumn("_part", part)
    part_of.repartitionByRange("_part", order).write.partitionBy("_part").parquet(f"{base}/staged")


def run_in_parts(spark: SparkSession, base: str, start) -> None:
    """Hand the staged ranges to a stream one after the other: each becomes the input of
    one run, which goes on from the checkpoint of the run before."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop.Path(f"{base}/in"))
    held = [f.getPath() for f in fs.listStatus(hadoop.Path(f"{base}/staged")) if "=" in f.getPath().getName()]
    for k, path in enumerate(sorted(held, key=lambda p: int(p.getName().split("=")[1]))):
        fs.rename(path, hadoop.Path(f"{base}/in/p{k:05d}"))
        query = start()
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()


def source(spark: SparkSession, base: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(f"{base}/in/*")


def sink(frame: DataFrame, base: str):
    """Starts one run into the job's parquet sink."""
    return lambda: (frame.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck")
                    .outputMode("append").trigger(availableNow=True).start())


# -- R1: streaming harvest -------------------------------------------------------------

def stream_harvest(spark: SparkSession, docs: DataFrame, *, parts: int = 4, min_len: int = 15,
                   max_len: int = 5000) -> DataFrame:
    """Records arrive as files; each is stripped, keyed, length-filtered,
    labelled and deduplicated on its key against everything seen so far
    (state keyed by prompt_id in the state store), then appended."""
    base = run_dir(spark, "harvest")
    stage(docs.select("doc_id", "source", "text"), base, "doc_id", parts)
    s = source(spark, base, "doc_id long, source string, text string")
    s = s.withColumn("prompt_text", strip_ws(F.col("text"))).withColumn("prompt_length", F.length("prompt_text"))
    s = s.filter(F.col("prompt_length").between(min_len, max_len)).withColumn("_key", norm_key(F.col("prompt_text"), 32))
    s = s.dropDuplicates(["_key"]).withColumn("prompt_id", F.substring("_key", 1, 12)).drop("_key")
    s = L.label_intent_rules(L.with_lower(s, "prompt_text"), out="intent").drop(L.LOWER, "text")
    run_in_parts(spark, base, sink(s, base))
    return spark.read.parquet(f"{base}/out")


# -- R2: completion sessions -----------------------------------------------------------

def stream_sessions(spark: SparkSession, polls: DataFrame, *, gap: str = "12 hours", delay: str = "1 hour",
                    parts: int = 4) -> DataFrame:
    """Sessions of polls per cell (quiet gap ``gap``) emitted once the
    watermark passes their end; sessions still open at the end of input are
    not emitted (append mode)."""
    base = run_dir(spark, "sessions")
    stage(polls.select("cell", "ts", "seq"), base, "ts", parts)
    s = source(spark, base, "cell long, ts timestamp, seq long")
    agg = (s.withWatermark("ts", delay).groupBy("cell", F.session_window("ts", gap).alias("w"))
            .agg(F.count(F.lit(1)).alias("polls")))
    agg = agg.select("cell", F.col("w.start").cast("double").alias("session_start"),
                     F.col("w.end").cast("double").alias("session_end"), F.col("polls").cast("bigint").alias("polls"))
    run_in_parts(spark, base, sink(agg, base))
    return spark.read.parquet(f"{base}/out")


# -- R6 / R7: incremental keyed append ---------------------------------------------------

def append_job(spark: SparkSession, base: str, *, min_len: int = 10, run_date: str = "2026-01-06"):
    """What one micro-batch does: keys of the batch (first copies), those that the sink's
    index holds taken out, the rest labelled and written to the batch's own partition,
    which a replay overwrites, and their keys added to the index. The sink's rows are not
    read; a replayed batch looks its keys up in the batches before it."""
    index = KeyIndex(spark, f"{base}/keys")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        firsts = first_copies(batch, min_len=min_len).checkpoint()  # looked up in every generation; the texts are keyed once
        new = firsts.join(index.known(firsts.select("key"), before=batch_id), "key", "left_anti").checkpoint()
        rows = append_rows(batch, new, run_date=run_date)
        (rows.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{base}/sink"))
        index.add(new.select("key"), batch_id)

    return per_batch


def seed_sink(loaded: DataFrame, base: str, *, run_date: str = "2026-01-06") -> None:
    """Rows loaded before the stream, and their keys, as batch -1."""
    rows = loaded.select(F.lit(run_date).alias("Date Added"), F.lit("seed").alias("Source"), F.lit("").alias("Intent"),
                         strip_ws(F.col("text")).alias("Prompt"), F.col("language").alias("Language"), "seq")
    rows.withColumn("batch_id", F.lit(-1).cast("long")).write.partitionBy("batch_id").parquet(f"{base}/sink")
    keys = loaded.select(key_of(strip_ws(F.col("text"))).alias("key")).where("key is not null").distinct().checkpoint()  # counted, sampled and dealt
    KeyIndex(loaded.sparkSession, f"{base}/keys").add(keys, -1)


def stream_append(spark: SparkSession, incoming: DataFrame, loaded: DataFrame, *, parts: int = 4,
                  min_len: int = 10, run_date: str = "2026-01-06") -> DataFrame:
    """Keyed append on a stream (foreachBatch): only prompts that neither the sink nor an
    earlier row holds are added."""
    base = run_dir(spark, "append")
    seed_sink(loaded, base, run_date=run_date)
    stage(incoming.select("seq", "text", "language"), base, "seq", parts)
    s = source(spark, base, "seq long, text string, language string")
    job = append_job(spark, base, min_len=min_len, run_date=run_date)
    run_in_parts(spark, base, lambda: s.writeStream.foreachBatch(job).option("checkpointLocation", f"{base}/ck")
                 .trigger(availableNow=True).start())
    return spark.read.parquet(f"{base}/sink").filter(F.col("batch_id") >= 0).drop("batch_id")


# -- R9: running statistics --------------------------------------------------------------

def stream_stats(spark: SparkSession, attempts: DataFrame, *, parts: int = 4) -> DataFrame:
    """Per-system running counts over arriving attempts (complete mode); each
    trigger overwrites the small result table."""
    base = run_dir(spark, "stats")
    slim = CO.with_status(attempts).select("prompt_id", "system", "attempt", "status", "latency_s")
    stage(slim, base, "prompt_id", parts)
    s = source(spark, base, "prompt_id long, system string, attempt long, status string, latency_s double")
    agg = s.groupBy("system").agg(
        F.count(F.lit(1)).cast("bigint").alias("queries"),
        F.count_if(F.col("status") == "ok").cast("bigint").alias("ok"),
        F.count_if(F.col("status") == "blocked").cast("bigint").alias("blocked"),
        F.count_if(F.col("status") == "error").cast("bigint").alias("errors"))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    run_in_parts(spark, base, lambda: agg.writeStream.outputMode("complete").foreachBatch(per_batch)
                 .option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start())
    return spark.read.parquet(f"{base}/out")


# -- R2 - R5, R8: completion of cells as keyed state ---------------------------------------

OPEN = "last string, run_start double, start double, repeats long, marker boolean"
POLLS = "cell long, ts timestamp, seq long, text string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def advance(state: tuple | None, t: np.ndarray, text: np.ndarray, *, gap_s: float | None, stable: int | None, timeout_s: float,
            min_len: int, markers: tuple[str, ...]) -> tuple[tuple, int | None, float | None]:
    """Take a cell's polls, in order, into its state (last text, run start, first poll,
    repeats in the run, marker seen last). Returns the state, the place of the poll that
    completes the cell (the same text for ``gap_s`` seconds, or seen ``stable`` more
    times), and when its run began. Runs are found on whole arrays."""
    last, run_start, start, repeats, marker = state or (None, None, float(t[0]), 0, False)
    live = t - start < timeout_s
    is_marker = np.array([any(m in x for m in markers) for x in text], dtype=bool)
    size = np.array([len(x) for x in text])
    keep = np.flatnonzero(live & (is_marker | (size >= min_len)))
    if not len(keep):
        return (last, run_start, start, repeats, marker), None, None
    mark, value, at = is_marker[keep], np.where(is_marker[keep], "", text[keep]).astype(object), t[keep]
    before = np.concatenate([np.array([last], dtype=object), value[:-1]])
    same = ~mark & (value == before)
    if stable is not None:
        same &= size[keep] > STABLE_MIN
    place = np.arange(len(keep))
    opened = np.maximum.accumulate(np.where(same, -1, place))
    begun = np.where(opened >= 0, at[np.maximum(opened, 0)], np.nan if run_start is None else run_start)
    times = np.where(opened >= 0, place - opened, place + 1 + repeats)
    done = np.flatnonzero(same & ((at - begun >= gap_s) if stable is None else (times >= stable)))
    k = int(done[0]) if len(done) else len(keep) - 1
    state = (value[k], None if mark[k] else float(begun[k]), start, int(times[k]), bool(mark[k]))
    return state, (int(keep[k]) if len(done) else None), (float(begun[k]) if len(done) else None)


STABLE_MIN = 20


class Cells(StatefulProcessor):
    """One open cell is one state row. A cell that is complete, or whose deadline passes
    in event time, leaves it; for ``keep_s`` seconds of event time only a mark remains, by
    which later polls of the cell are passed over, and a timer takes it away."""

    def __init__(self, emit: str, keep_s: float, **rules):
        self.emit, self.keep_s, self.rules = emit, keep_s, rules

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN)
        self.closed = handle.getValueState("closed", "since double")

    def _row(self, key, status: str, text: str, latency: float | None, at: float | None, seq: int | None) -> pd.DataFrame:
        return pd.DataFrame({"cell": [key[0]], "status": [status], "response": [text], "latency_s": [latency], "done_at": [at],
                             "done_seq": pd.array([seq], dtype="Int64")})

    def _close(self, at: float) -> None:
        self.open.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.closed.update((at,))
        self.handle.registerTimer(int((at + self.keep_s) * 1000))

    def _late(self, key, state: tuple) -> pd.DataFrame:
        last, run_start, start, repeats, marker = state
        if marker or not last:
            return self._row(key, "error", "ERROR: Timeout waiting for response", 0.0, None, None)
        return self._row(key, "partial", last, run_start - start if repeats else float(self.rules["timeout_s"]), None, None)

    def handleInputRows(self, key, rows, timerValues):
        polls = pd.concat(list(rows))
        if self.closed.exists():
            return
        polls = polls.sort_values(["t", "seq"])
        held = self.open.get() if self.open.exists() else None
        state, done, begun = advance(held, polls["t"].to_numpy(), polls["text"].to_numpy(dtype=object), **self.rules)
        deadline = state[2] + self.rules["timeout_s"]
        if done is not None:
            poll = polls.iloc[done]
            self._close(float(poll["t"]))
            if self.emit == "complete":
                yield self._row(key, "complete", poll["text"], begun - state[2], float(poll["t"]), int(poll["seq"]))
            return
        watermark = timerValues.getCurrentWatermarkInMs()
        if deadline * 1000 <= max(watermark, 0):
            self._close(deadline)
            if self.emit == "late":
                yield self._late(key, state)
            return
        self.open.update(state)
        if held is None and np.isfinite(deadline):
            self.handle.registerTimer(int(deadline * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.closed.exists():
            self.closed.clear()
        elif self.open.exists():
            state = self.open.get()
            self._close(state[2] + self.rules["timeout_s"])
            if self.emit == "late":
                yield self._late(key, state)

    def close(self) -> None:
        pass


CELL_ROWS = "cell long, status string, response string, latency_s double, done_at double, done_seq long"


def cells(spark: SparkSession, polls: DataFrame, name: str, emit: str, *, delay: str, parts: int, keep_s: float, base: str | None = None, **rules) -> DataFrame:
    """Completion of cells by keyed state (transformWithState: value state and event-time
    timers in the RocksDB store). ``emit``: complete cells, or late ones."""
    base = base or run_dir(spark, name)
    stage(polls.select("cell", "ts", "seq", F.coalesce("text", F.lit("")).alias("text")), base, "ts", parts)
    s = source(spark, base, POLLS).withWatermark("ts", delay)
    s = s.select("cell", "seq", "text", "ts", F.col("ts").cast("double").alias("t"))
    out = s.groupBy("cell").transformWithStateInPandas(Cells(emit, keep_s, **rules), CELL_ROWS, "append", "EventTime")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKSDB)
    try:
        run_in_parts(spark, base, sink(out, base))
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(f"{base}/out")


LONG = 10.0 * 365 * 86400  # seconds


def stream_quiescence(spark: SparkSession, polls: DataFrame, *, gap_s: float, timeout_s: float, delay: str = "1 hour",
                      parts: int = 4, min_len: int = 30, markers=("Thinking", "Generating"), keep_s: float = LONG) -> DataFrame:
    """Completion of a cell: the same text for ``gap_s`` seconds since its last change."""
    return cells(spark, polls, "quiet", "complete", delay=delay, parts=parts, keep_s=keep_s, gap_s=gap_s, stable=None,
                 timeout_s=timeout_s, min_len=min_len, markers=tuple(markers)).drop("done_seq")


def stream_stable_polls(spark: SparkSession, polls: DataFrame, *, n: int = 3, delay: str = "1 hour",
                        parts: int = 4, keep_s: float = LONG) -> DataFrame:
    """Completion after ``n`` repeats of the same text."""
    return cells(spark, polls, "stable", "complete", delay=delay, parts=parts, keep_s=keep_s, gap_s=None, stable=n,
                 timeout_s=float("inf"), min_len=0, markers=()).select("cell", "status", "response", "done_seq")


def stream_timeouts(spark: SparkSession, polls: DataFrame, *, gap_s: float, timeout_s: float, delay: str = "1 hour",
                    parts: int = 4, min_len: int = 30, markers=("Thinking", "Generating"), keep_s: float = LONG) -> DataFrame:
    """Cells with no completion within ``timeout_s`` of their first poll get a partial or
    error verdict when the watermark passes the deadline; complete cells emit nothing here."""
    return cells(spark, polls, "timeouts", "late", delay=delay, parts=parts, keep_s=keep_s, gap_s=gap_s, stable=None,
                 timeout_s=timeout_s, min_len=min_len, markers=tuple(markers)).select("cell", "status", "response", "latency_s")
