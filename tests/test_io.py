"""Sources and sinks: typed CSV scan with rejects, first-N, newest file,
partitioned and idempotent outputs, manifest."""

import os
import time

from pyspark.sql import functions as F

from conftest import SF001
from quillspark.sources import fixtures as FX
from quillspark.sources import io as IO
from quillspark.streaming.jobs import run_dir


def test_typed_csv_scan_and_rejects(spark):
    base = run_dir(spark, "t-csv")
    IO.write_csv(FX.intents_text(spark, SF001), f"{base}/intents")
    typed = IO.read_intents_csv(spark, f"{base}/intents")
    n_all = FX.intents_text(spark, SF001).count()
    ok = typed.filter(F.col("_reject").isNull())
    bad = typed.filter(F.col("_reject").isNotNull())
    assert ok.count() + bad.count() == n_all
    assert {r._reject for r in bad.select("_reject").distinct().collect()} <= {
        "missing action or object", "bad feedback_count", "bad action_rank", "bad rank_in_action",
        "bad tenant_count", "bad active_weeks_p75"}
    r = ok.filter(F.col("feedback_count") == 5).first()
    assert r is not None  # ' 5 ' parses after stripping


def test_first_rows(spark):
    df = FX.documents(spark, SF001).select("doc_id")
    got = [r.doc_id for r in IO.first_rows(df, "doc_id", 3).collect()]
    assert got == sorted(r.doc_id for r in df.collect())[:3]


def test_newest_file(spark):
    base = run_dir(spark, "t-newest")
    df = spark.createDataFrame([(1, "old")], "id long, v string")
    IO.write_csv(df, f"{base}/x", mode="append")
    time.sleep(1.1)
    IO.write_csv(spark.createDataFrame([(2, "new"), (3, "new")], "id long, v string").coalesce(1), f"{base}/x",
                 mode="append")  # one newer file holding both rows
    got = sorted(r.v for r in IO.newest_file(spark, f"{base}/x", "csv", header=True).collect())
    assert got == ["new", "new"]


def test_latest_file_exports_in_parallel(spark, monkeypatch):
    from quillspark.plans import io_plans
    base = run_dir(spark, "t-latest")
    monkeypatch.setattr(io_plans, "run_dir", lambda *_: base)
    got = io_plans.q_latest_file(spark, SF001)
    folder = f"{base}/exports".removeprefix("file:")
    parts = [d for d, _, names in os.walk(folder) for n in names if n.startswith("part-")]
    assert len(parts) == 2 * FX.intents_text(spark, SF001).rdd.getNumPartitions() > 2 and len(set(parts)) == 2
    raw = IO.typed_intents(FX.intents_text(spark, SF001).withColumn("intent_id", F.col("intent_id").cast("bigint")))
    want = raw.filter(F.col("_reject").isNull()).select(*got.columns)
    assert got.count() == want.count() and got.select("action").exceptAll(want.select("action")).isEmpty()


def test_partitioned_and_dynamic_overwrite(spark):
    base = run_dir(spark, "t-part")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, k string")
    IO.write_partitioned(df, f"{base}/p", "k")
    assert sorted(d for d in os.listdir(f"{base}/p") if d.startswith("k=")) == ["k=a", "k=b"]
    IO.overwrite_partitions(spark.createDataFrame([(9, "a")], "id long, k string"), f"{base}/p", "k")
    got = sorted((r.id, r.k) for r in spark.read.parquet(f"{base}/p").collect())
    assert got == [(2, "b"), (9, "a")]  # only partition a replaced; rerunning is idempotent
    IO.overwrite_partitions(spark.createDataFrame([(9, "a")], "id long, k string"), f"{base}/p", "k")
    assert spark.read.parquet(f"{base}/p").count() == 2


def test_manifest_and_subset(spark):
    base = run_dir(spark, "t-json")
    df = spark.createDataFrame([(1, ["x", "y"]), (2, [])], "id long, tags array<string>")
    IO.write_json_with_manifest(df, f"{base}/j", {"source": "unit"})
    m = spark.read.json(f"{base}/j/manifest").first()
    assert (m.rows, m.source) == (2, "unit")
    assert spark.read.json(f"{base}/j/rows").filter("id = 1").first().tags == '["x","y"]'
    assert IO.write_subset(df, F.col("id") > 5, f"{base}/none") is False
    assert IO.write_subset(df, F.col("id") == 1, f"{base}/one") is True
