"""Evaluation analytics over long rating facts (prompt_id, system, rater,
criterion, rating): weighted scores, breakdowns, winners and win rates,
leaderboard, Fleiss' kappa, sufficiency, blind labels, latency profile,
robustness and rubric sanity.

Definitions (ours, the original declares them without computing them):
r(p,s,c) = mean over raters; score(p,s) = sum(w*r)/sum(w) over the criteria
present; winner = unique maximum of round(score, 6) among usable responses
with at least 2 systems judged; win rate = wins / judged prompts.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# FIXED VALUES: rubric weights (sum 1.00) and rating scale
WEIGHTS = [("accuracy", 0.25), ("helpfulness", 0.25), ("completeness", 0.20), ("clarity", 0.15),
           ("safety", 0.10), ("efficiency", 0.05)]
SCALE = (1, 5)
MIN_PER_CATEGORY = 30
MIN_RATERS = 3


def weights_frame(spark) -> DataFrame:
    return spark.createDataFrame(WEIGHTS, "criterion string, weight double")


def _weight_col(c) -> F.Column:
    """Weights as an in-row literal map: no join for a fixed rubric."""
    m = F.create_map(*[x for k, w in WEIGHTS for x in (F.lit(k), F.lit(w))])
    return F.element_at(m, c)


def criterion_means(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("prompt_id", "system", "criterion").agg(F.avg("rating").alias("r"))


def scores(ratings: DataFrame) -> DataFrame:
    m = criterion_means(ratings).withColumn("w", _weight_col(F.col("criterion")))
    return (m.filter(F.col("w").isNotNull()).groupBy("prompt_id", "system")
             .agg((F.sum(F.col("w") * F.col("r")) / F.sum("w")).alias("score")))


def dimension_breakdown(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("system", "criterion").agg(F.round(F.avg("rating"), 6).alias("avg_rating"),
                                                      F.count(F.lit(1)).cast("bigint").alias("n"))


def score_by(sc: DataFrame, attrs: DataFrame, key: str) -> DataFrame:
    return (sc.join(attrs.select("prompt_id", key), "prompt_id")
              .groupBy("system", key).agg(F.round(F.avg("score"), 6).alias("avg_score"),
                                          F.count(F.lit(1)).cast("bigint").alias("prompts")))


def winners(sc: DataFrame, usable: DataFrame | None = None) -> DataFrame:
    """Per prompt: the unique best system (null on a tie), and whether judged.
    One aggregate: a prompt has one row per system, so the two best scores
    per prompt are a bounded list (no self-join)."""
    s = sc if usable is None else sc.join(usable.select("prompt_id", "system"), ["prompt_id", "system"], "left_semi")
    s = s.withColumn("rs", F.round("score", 6))
    per = s.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("n_sys"), F.max_by("system", "rs").alias("cand"),
                                     F.slice(F.sort_array(F.collect_list("rs"), asc=False), 1, 2).alias("top2"))
    tie = (F.size("top2") == 2) & (F.element_at("top2", 1) == F.element_at("top2", 2))
    return per.select("prompt_id", (F.col("n_sys") >= 2).alias("judged"),
                      F.when((F.col("n_sys") >= 2) & ~tie, F.col("cand")).alias("winner"))


def leaderboard(sc: DataFrame, usable: DataFrame | None = None) -> DataFrame:
    w = winners(sc, usable)
    judged = w.filter("judged").agg(F.count(F.lit(1))).scalar()  # scalar subquery, computed once
    wins = w.filter(F.col("winner").isNotNull()).groupBy(F.col("winner").alias("system")).agg(F.count(F.lit(1)).alias("wins"))
    avg = sc.groupBy("system").agg(F.round(F.avg("score"), 6).alias("avg_score"), F.count(F.lit(1)).cast("bigint").alias("prompts"))
    out = avg.join(wins, "system", "left").na.fill(0, ["wins"]).withColumn("judged_prompts", judged)
    out = out.withColumn("win_rate", F.round(F.col("wins") / F.col("judged_prompts"), 6))
    return out.select("system", "avg_score", "prompts", F.col("wins").cast("bigint").alias("wins"),
                      F.col("judged_prompts").cast("bigint").alias("judged_prompts"), "win_rate",
                      F.dense_rank().over(Window.orderBy(F.desc("avg_score"))).cast("bigint").alias("rank"))


def fleiss_kappa(ratings: DataFrame, *, subject=("prompt_id", "system"), group="criterion", n_raters: int = 3) -> DataFrame:
    """Kappa per group over subjects rated by exactly ``n_raters`` raters."""
    subj = list(subject) + [group]
    cnt = ratings.groupBy(*subj, "rating").agg(F.count(F.lit(1)).alias("nij"))
    per = cnt.groupBy(*subj).agg(F.sum("nij").alias("n"), F.sum(F.col("nij") * F.col("nij")).alias("sq"))
    per = per.filter(F.col("n") == n_raters)
    pi = per.withColumn("Pi", (F.col("sq") - n_raters) / (n_raters * (n_raters - 1)))
    pbar = pi.groupBy(group).agg(F.avg("Pi").alias("P"), F.count(F.lit(1)).alias("N"))
    pj = cnt.join(per.select(*subj), subj, "left_semi").groupBy(group, "rating").agg(F.sum("nij").alias("cj"))
    pe = pj.join(pbar, group).groupBy(group).agg(F.sum((F.col("cj") / (F.col("N") * n_raters)) ** 2).alias("Pe"))
    k = pbar.join(pe, group)
    return k.select(group, F.col("N").cast("bigint").alias("subjects"), F.round("P", 6).alias("p_bar"),
                    F.round("Pe", 6).alias("p_e"),
                    F.when(F.col("Pe") < 1, F.round((F.col("P") - F.col("Pe")) / (1 - F.col("Pe")), 6)).alias("kappa"))


def sufficiency(ratings: DataFrame, categories: DataFrame) -> DataFrame:
    """Prompts per category against the minimum, and prompts with enough raters."""
    rated = ratings.groupBy("prompt_id").agg(F.count_distinct("rater").alias("raters"))
    cat = (categories.join(rated, "prompt_id").groupBy("category")
           .agg(F.count(F.lit(1)).cast("bigint").alias("n"))
           .select(F.lit("category").alias("metric"), F.col("category").alias("key"), "n",
                   (F.col("n") >= MIN_PER_CATEGORY).alias("sufficient")))
    rat = (rated.groupBy((F.col("raters") >= MIN_RATERS).alias("sufficient"))
                .agg(F.count(F.lit(1)).cast("bigint").alias("n"))
                .select(F.lit("raters").alias("metric"), F.lit(None).cast("string").alias("key"), "n", "sufficient"))
    return cat.unionByName(rat)


def blind_labels(pairs: DataFrame, seed: str = "blind") -> DataFrame:
    """Per prompt, systems get A, B, C... in a seeded per-prompt order."""
    w = Window.partitionBy("prompt_id").orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("prompt_id").cast("string"), F.col("system"))))
    return pairs.select("prompt_id", "system").distinct() \
                .withColumn("label", F.char((F.row_number().over(w) + 64).cast("bigint")))


PERCENTILES = (("p50_s", 0.5), ("p90_s", 0.9), ("p95_s", 0.95))
CELLS = 512  # ranges that an interval is counted into


def value_at_ranks(values: DataFrame, group: str, value: str, ranks: dict) -> dict:
    """{(group, rank): value} for 0-based ranks among each group's ascending values, exactly;
    ``ranks`` names a few ranks per group.

    Every wanted rank has an interval of values that holds it. A round counts the values of
    all open intervals into ``CELLS`` ranges each, with the least and greatest value of each
    range: one aggregate, combined map-side, with at most CELLS rows per interval. The search
    goes on between the least and greatest value of the range that holds the rank, until they
    are one. Nothing is sorted, and no task holds a group's values."""
    spark = values.sparkSession
    rows = values.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    spans = {r["g"]: (r["lo"], r["hi"]) for r in rows.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    state = {(g, r): (*spans[g], r) for g, rs in ranks.items() for r in rs if g in spans}
    while open_ := sorted({(k[0], lo, hi) for k, (lo, hi, _) in state.items() if lo < hi}, key=str):
        number = {x: i for i, x in enumerate(open_)}
        table = spark.createDataFrame([(i, *x) for x, i in number.items()], f"i int, h {rows.schema['g'].dataType.simpleString()}, lo double, hi double")
        cell = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") / CELLS - F.col("lo") / CELLS)), F.lit(CELLS - 1).cast("bigint"))
        met = rows.join(F.broadcast(table), rows["g"].eqNullSafe(table["h"])).where("v >= lo and v <= hi")
        counted: dict = {}
        for r in met.groupBy("i", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect():
            counted.setdefault(r["i"], []).append((r["cell"], r["n"], r["a"], r["b"]))
        for key, (lo, hi, left) in state.items():
            for _, n, a, b in sorted(counted.get(number.get((key[0], lo, hi)), [])):
                if left < n:
                    state[key] = (a, b, left)
                    break
                left -= n
    return {key: lo for key, (lo, _, _) in state.items()}


def latency_profile(cells: DataFrame) -> DataFrame:
    """Count, mean and exact interpolated percentiles of the usable latencies of
    each system, the percentiles by repeated range counts. One row per system passes
    the driver."""
    ok = cells.filter(F.col("status") == "ok").select("system", "latency_s")
    totals = ok.groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.count("latency_s").alias("seen"), F.round(F.avg("latency_s"), 4).alias("avg_s")).collect()
    ranks = {r["system"]: sorted({f(p * (r["seen"] - 1)) for _, p in PERCENTILES for f in (floor, ceil)}) for r in totals if r["seen"]}
    at = value_at_ranks(ok, "system", "latency_s", ranks)
    names = [n for n, _ in PERCENTILES]
    rows = []
    for r in totals:
        found = []
        for _, p in PERCENTILES:
            place = p * (r["seen"] - 1)
            ends = (at[r["system"], floor(place)], at[r["system"], ceil(place)]) if r["seen"] else (None, None)
            found += [*ends, place - floor(place)]
        rows.append((r["system"], r["n"], r["avg_s"], *found))
    kind = ", ".join(f"{n}_{x} double" for n in names for x in ("lo", "hi", "part"))
    out = cells.sparkSession.createDataFrame(rows, f"system string, n bigint, avg_s double, {kind}")
    return out.select("system", "n", "avg_s", *[F.round(F.col(f"{n}_lo") * (1 - F.col(f"{n}_part")) + F.col(f"{n}_hi") * F.col(f"{n}_part"), 4).alias(n) for n in names])


def robustness(sc: DataFrame, family: DataFrame) -> DataFrame:
    """Mean over intent families of the population stddev of score."""
    per = sc.join(family.select("prompt_id", "family"), "prompt_id").groupBy("system", "family") \
            .agg(F.stddev_pop("score").alias("sd"))
    return per.groupBy("system").agg(F.round(F.avg("sd"), 6).alias("robustness"),
                                     F.count(F.lit(1)).cast("bigint").alias("families"))


def rubric_check(spark, ratings: DataFrame) -> DataFrame:
    wsum = round(sum(w for _, w in WEIGHTS), 6)
    r = ratings.agg(F.count(F.lit(1)).cast("bigint").alias("ratings"),
                    F.count_if(~F.col("rating").between(*SCALE)).cast("bigint").alias("out_of_range"))
    return r.select(F.lit(wsum).alias("weight_sum"), F.lit(abs(wsum - 1.0) < 1e-9).alias("weights_ok"),
                    "ratings", "out_of_range")
