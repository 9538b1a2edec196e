"""Text dedup proposal rounds equal the serial rule (our spec, written out
plainly here): in seq order each row takes its first candidate whose hash no
earlier row took; when all four are taken it keeps the fourth."""

import random

from pyspark.sql import functions as F

from conftest import SF01
from quillspark.operators import generate as G
from quillspark.plans.generate_plans import clean


def serial(rows):
    taken, out = set(), {}
    for seq in sorted(rows):
        cands = rows[seq]
        for i, h in enumerate(cands):
            if h not in taken:
                taken.add(h)
                out[seq] = (i, False)
                break
        else:
            out[seq] = (len(cands) - 1, True)
    return out


def run(spark, rows):
    data = [(seq, c, h) for seq, cs in rows.items() for c, h in enumerate(cs)]
    df = spark.createDataFrame(data, "seq long, cand int, h string").withColumn("text", F.col("h"))
    got = G.dedup_proposals(df).select("seq", "cand", "dup").collect()
    return {r.seq: (r.cand, r.dup) for r in got}


def test_hand_cases(spark):
    rows = {1: ["x", "a", "b", "c"], 2: ["x", "y", "b", "c"], 3: ["y", "z", "b", "c"],
            4: ["x", "y", "z", "c"], 5: ["x", "y", "z", "c"]}
    assert run(spark, rows) == serial(rows)
    assert serial(rows)[5] == (3, True)


def test_random_against_serial(spark):
    rnd = random.Random(7)
    for _ in range(3):
        rows = {s: [rnd.choice("abcdefgh") for _ in range(4)] for s in rnd.sample(range(1000), 40)}
        assert run(spark, rows) == serial(rows)


def test_corpus_against_serial(spark):
    c = G.v2_candidates(clean(spark, SF01)).select("seq", "cand", "h").collect()
    rows = {}
    for r in c:
        rows.setdefault(r.seq, [None] * 4)[r.cand] = r.h
    got = run(spark, rows)
    assert got == serial(rows)
    assert any(d for _, d in got.values()) or any(c > 0 for c, _ in got.values())


def test_rounds_broadcast_nothing(spark):
    """A checkpoint is taken to be as small as the scan below it; its join must not rely on that."""
    base = spark.range(50).select(F.col("id").alias("seq"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("cand"))
    out = G.dedup_proposals(base.withColumn("h", (F.col("seq") % 20 + F.col("cand")).cast("string")))
    assert out.count() == 50
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
