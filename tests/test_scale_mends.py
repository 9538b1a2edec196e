"""Work that is done once and texts that stay where they are: summary branches, rounds, keys, CSV files."""

from pyspark.sql import functions as F

from quillspark.operators import harvest as HV
from quillspark.plans import collect_plans as CP
from quillspark.sources import io as IO
from quillspark.sources.exports import Exports
from quillspark.streaming import jobs as J


def test_summary_works_labels_out_once(spark):
    """Its branches read one aggregate; none of them expands the labelled rows again."""
    rows = spark.range(40).select(
        (F.col("id") % 3).cast("string").alias("source"), F.lit("a").alias("primary_intent"), F.lit("b").alias("difficulty_level"),
        F.when(F.col("id") % 4 > 0, F.lit("en")).alias("language"), (F.col("id") % 2 == 0).alias("is_microsoft_related"),
        F.col("id").alias("prompt_length"), F.lit(1).alias("difficulty_score"), *[F.lit(True).alias(c) for c in HV.CAP_NAMES])
    out = HV.harvest_summary(rows)
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.metric, r.key): r.value for r in out.collect()}
    assert got["by_source", "0"] == 14 and got["by_language", None] == 10 and got["total_prompts", None] == 40
    assert got["microsoft_related_percentage", None] == 50 and got["avg_prompt_length", None] == 20


def test_rounds_read_the_asked_attempts_only(spark, monkeypatch):
    """The third attempts, which nobody asks for, hold what cannot be read."""
    systems = CP.FX.SYSTEMS
    docs = spark.createDataFrame([(i,) for i in range(4)], "doc_id long")
    held = spark.createDataFrame([(i, s, a, "x" if a == 3 else "1", i == 0 and a == 1) for i in range(4) for s in systems for a in (1, 2, 3)],
                                 "prompt_id long, system string, attempt long, raw string, blocked boolean")
    answers = held.select("prompt_id", "system", "attempt", F.col("raw").cast("int").cast("string").alias("response"), "blocked",
                          F.lit(1.0).alias("latency_s"))
    monkeypatch.setattr(CP.FX, "documents", lambda spark, sf: docs)
    monkeypatch.setattr(CP.FX, "attempts", lambda spark, sf: answers)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        got = {(r.prompt_id, r.system): r.attempt for r in CP.q_collect_rounds(spark, "").collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {(i, s): 2 if i == 0 else 1 for i in range(4) for s in systems}


def test_seed_keys_texts_once(spark):
    """A seed's texts are read for its rows and for its keys, not again to count, sample and deal the keys."""
    read, n = spark.sparkContext.accumulator(0), 60

    @F.udf("string")
    def text(i):
        read.add(1)
        return f"some text {i % 50}"

    loaded = spark.range(n).select(F.col("id").alias("seq"), text.asNondeterministic()("id").alias("text"), F.lit("en").alias("language"))
    base = J.run_dir(spark, "seed")
    J.seed_sink(loaded, base)
    assert read.value <= 3 * n
    index = J.KeyIndex(spark, f"{base}/keys")
    assert index.known(spark.range(60).select(J.key_of(F.concat(F.lit("some text "), F.col("id").cast("string"))).alias("key"))).count() == 50


def test_csv_files_stay_small(spark, monkeypatch):
    """A CSV file with line breaks inside fields is read by one task."""
    monkeypatch.setattr(IO, "FILE_ROWS", 10)
    rows = spark.range(95).select(F.col("id").cast("string").alias("k"), F.concat(F.lit("a\nb "), F.col("id").cast("string")).alias("t")).coalesce(1)
    path = f"{J.run_dir(spark, 'small')}/csv"
    IO.write_csv(rows, path)
    back = spark.read.options(header=True, multiLine=True).csv(path)
    assert back.select(F.input_file_name()).distinct().count() == 10
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    many = spark.range(45_000).select(F.col("id").cast("string").alias("k")).coalesce(1)
    out = Exports(spark, J.run_dir(spark, "small"))
    assert out.write("1", many, "csv")["files"] == 3 and out.latest().count() == 45_000
