"""Ranks by repeated range counts equal a sort."""

import random

from quillspark.operators import evaluate as E


def test_ranks_equal_sorting(spark):
    rng = random.Random(3)
    held = {"a": [rng.random() * 10 ** rng.randrange(-12, 12) for _ in range(700)], "b": [float(rng.randrange(4)) for _ in range(300)],
            "c": [-5.0], None: [rng.gauss(0, 1) for _ in range(200)], "d": [-1e300, 1e300, 0.0, -0.5, 1e-300]}
    rows = [(g, v) for g, vs in held.items() for v in vs] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    ranks = {g: sorted({0, len(vs) // 2, len(vs) - 1, int(0.9 * (len(vs) - 1))}) for g, vs in held.items()} | {"e": [0]}
    got = E.value_at_ranks(df, "g", "v", ranks)
    assert got == {(g, r): sorted(vs)[r] for g, vs in held.items() for r in ranks[g]}


def test_profile(spark):
    rows = [("a", "ok", float(x)) for x in range(1, 11)] + [("a", "error", 99.0), ("b", "ok", None), ("c", "ok", 2.5)]
    got = {r.system: tuple(r)[1:] for r in E.latency_profile(spark.createDataFrame(rows, "system string, status string, latency_s double")).collect()}
    assert got == {"a": (10, 5.5, 5.5, 9.1, 9.55), "b": (1, None, None, None, None), "c": (1, 2.5, 2.5, 2.5, 2.5)}
