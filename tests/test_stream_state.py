"""State of the completion streams, replayed appends, broken rounds."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import polls as PO
from quillspark.streaming import jobs as J

BASE = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(c, BASE + dt.timedelta(seconds=t), s, x) for c, t, s, x in rows], J.POLLS)


def poll_rows(seed=4):
    rnd, rows, seq = random.Random(seed), [], 0
    for c in range(1, 13):
        t = rnd.randrange(100)
        for _ in range(rnd.randrange(2, 30)):
            t += rnd.choice([1, 2, 5, 9, 20])
            seq += 1
            rows.append((c, t, seq, rnd.choices(["A" * 30, "B" * 31, "Thinking", "tiny"], weights=[6, 3, 1, 1])[0]))
    return rows


def test_state_machine_equals_batch(spark):
    rows = poll_rows()
    batch = {(r.cell, r.response, r.latency_s) for r in PO.quiescence(frame(spark, rows), gap_s=12, timeout_s=1000).collect() if r.status == "complete"}
    for cut in (1, 3):  # polls taken all at once or a few at a time
        got = set()
        by = {}
        for c, t, s, x in rows:
            by.setdefault(c, []).append((float(t), s, x))
        for c, polls in by.items():
            state, polls = None, sorted(polls)
            step = len(polls) if cut == 1 else cut
            for at in range(0, len(polls), step):
                import numpy as np
                some = polls[at:at + step]
                state, done, begun = J.advance(state, np.array([p[0] for p in some]), np.array([p[2] for p in some], dtype=object),
                                               gap_s=12, stable=None, timeout_s=1000, min_len=30, markers=("Thinking",))
                if done is not None:
                    got.add((c, some[done][2], begun - state[2]))
                    break
        assert got == batch and got


def test_finished_cells_leave_the_state(spark):
    rows = [r for r in poll_rows(9)]
    end = max(t for _, t, _, _ in rows)
    rows += [(99, end + 500, 10_000, "late and only " + "x" * 30), (98, end + 5000, 10_001, "moves the watermark " + "y" * 30)]
    base = J.run_dir(spark, "state")
    polls = frame(spark, rows)
    got = J.cells(spark, polls, "state", "complete", delay="1 second", parts=3, keep_s=1000.0, base=base, gap_s=12, stable=None,
                  timeout_s=10_000.0, min_len=30, markers=("Thinking",)).collect()
    want = {r.cell for r in PO.quiescence(polls, gap_s=12, timeout_s=10_000).collect() if r.status == "complete"}
    assert {r.cell for r in got} == want and len(got) == len(want)
    held = lambda name: {r.key.cell for r in spark.read.format("statestore").option("stateVarName", name).load(f"{base}/ck").collect()}
    assert held("open") == {c for c, _, _, _ in rows} - want and held("closed") == set()


def test_replayed_batch_changes_nothing(spark):
    base = J.run_dir(spark, "replay")
    old = spark.createDataFrame([(0, "a prompt that is there", "en")], "seq long, text string, language string")
    J.seed_sink(old, base)
    job = J.append_job(spark, base)
    one = spark.createDataFrame([(1, "a prompt that is there", "en"), (2, "first new prompt", "en"), (3, "first new prompt ", "en")], old.schema)
    two = spark.createDataFrame([(4, "first new prompt", "en"), (5, "second new prompt", None)], old.schema)
    rows = lambda: sorted((r.batch_id, r.seq, r.Prompt) for r in spark.read.parquet(f"{base}/sink").collect())
    want = [(-1, 0, "a prompt that is there"), (0, 2, "first new prompt"), (1, 5, "second new prompt")]
    for batch, k in ((one, 0), (two, 1), (two, 1), (one, 0), (two, 1)):
        job(batch, k)
    assert rows() == want
    from quillspark.operators.key_index import KeyIndex
    assert KeyIndex(spark, f"{base}/keys").compact()
    job(two, 1)
    assert rows() == want


def test_staging_is_parallel_and_whole(spark):
    base = J.run_dir(spark, "stage")
    df = spark.range(1000).select(F.when(F.col("id") % 50 != 0, F.col("id")).alias("at"), F.col("id"))
    J.stage(df, base, "at", 4)
    got = spark.read.parquet(f"{base}/staged")
    assert got.count() == 1000 and got.where("at is null").select("_part").distinct().collect()[0][0] == 0
    spans = got.where("at is not null").groupBy("_part").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).orderBy("_part").collect()
    assert len(spans) == 4 and all(a.hi < b.lo for a, b in zip(spans, spans[1:]))


def test_rounds_resume_after_a_break(spark):
    from quillspark.operators.rounds import Rounds
    sent = []

    def send(queue):
        sent.append(queue.count())
        return queue.selectExpr("prompt_id", "system", "attempt", "concat('answer ', attempt) as response",
                                "attempt < prompt_id % 6 as blocked", "cast(attempt as double) as latency_s")

    cells = spark.createDataFrame([(p, s) for p in range(12) for s in "ab"], "prompt_id long, system string")
    whole = Rounds(spark, J.run_dir(spark, "rounds"))
    want = sorted(whole.run(cells, send, max_attempts=4).collect())
    counts, sent[:] = list(sent), []
    folder = J.run_dir(spark, "rounds")

    def breaks(queue):
        if len(sent) == 1:
            raise RuntimeError("lost in round 2")
        return send(queue)

    with pytest.raises(RuntimeError):
        Rounds(spark, folder).run(cells, breaks, max_attempts=4)
    again = Rounds(spark, folder)
    assert again.log.units() == ["round-0001"]
    assert sorted(again.run(cells, send, max_attempts=4).collect()) == want and sent == counts
    assert sorted(again.run(cells, breaks, max_attempts=4).collect()) == want  # nothing is left to send
    last = {(r.prompt_id, r.system): (r.attempt, r.status) for r in again.latest().collect()}
    for p in range(12):
        n = max(1, min(4, p % 6))
        assert last[p, "a"] == last[p, "b"] == (n, "blocked" if n < p % 6 else "ok")
