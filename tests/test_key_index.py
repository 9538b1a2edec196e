"""Key index and commit log: lookups equal sets, replays change nothing."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators.harvest import first_copies, incremental_append
from quillspark.operators.key_index import KeyIndex, key_of
from quillspark.sources.commit_log import CommitLog
from quillspark.streaming.jobs import run_dir


def keys(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string").select(key_of(F.col("name")).alias("key"))


def test_lookup_equals_sets(spark):
    rng = random.Random(7)
    index, held = KeyIndex(spark, run_dir(spark, "keys")), {}
    assert index.known(keys(spark, ["a"])).count() == 0 and not index.compact()
    for batch in (-1, 0, 1):
        names = {f"k{rng.randrange(30000)}" for _ in range(9000 if batch < 0 else 500)}
        held[batch] = names
        assert index.add(keys(spark, names), batch) and not index.add(keys(spark, ["other"]), batch)
    asked = [f"k{i}" for i in range(0, 30000, 7)] + ["other"]
    marks = {r.key: r.name for r in spark.createDataFrame([(a,) for a in asked], "name string").select("name", key_of(F.col("name")).alias("key")).collect()}
    found = lambda before=None: {marks[r.key] for r in index.known(keys(spark, asked), before).collect()}
    everything = held[-1] | held[0] | held[1]
    assert found() == everything & set(asked) and found(1) == (held[-1] | held[0]) & set(asked) and found(0) == held[-1] & set(asked)
    assert index.compact() and not index.compact() and found() == everything & set(asked)
    assert found(1) == (held[-1] | held[0]) & set(asked)  # a batch replayed after the folding
    assert index.add(keys(spark, ["other"]), 2) and "other" in found() and "other" not in found(2)
    info = index.log.info("000000000000")
    assert info["buckets"] == -(-len(held[-1]) // 3000) > 1


def test_pages_leave_little_to_confirm(spark):
    index = KeyIndex(spark, run_dir(spark, "keys"))
    index.add(spark.range(20000).select(key_of(F.col("id").cast("string")).alias("key")), 0)
    from quillspark.operators import key_index as K
    g = index._generations(None)[0]
    pages = spark.read.parquet(index.log.path(g["try"]) + "/pages")
    fresh = spark.range(50000, 60000).select(key_of(F.col("id").cast("string")).alias("key"))
    probe = fresh.select(K.bucket_of(F.col("key"), g["buckets"]).alias("bucket"), "key").join(pages, "bucket")
    assert probe.where(K._may_hold(F.col("page"), F.col("key"))).count() < 300
    assert index.known(fresh).count() == 0


def test_commit_log_late_writer(spark):
    log = CommitLog(spark, run_dir(spark, "log"))
    a, b = log.new_try(), log.new_try()
    spark.range(3).write.parquet(log.path(a))
    spark.range(5).write.parquet(log.path(b))
    assert log.units() == [] and log.commit("u1", b, rows=5) and not log.commit("u1", a)
    assert log.read("u1").count() == 5 and log.info("u1") == {"try": b, "rows": 5}
    assert not log.write("u1", spark.range(1)) and log.write("u2", spark.range(2))
    assert log.units() == ["u1", "u2"] and log.read_all("id long").count() == 7
    with pytest.raises(ValueError):
        log.commit("../u3", a)


def test_append_exchanges_keys_only(spark):
    docs = spark.createDataFrame([(1, " one long prompt ", "en"), (2, "one long prompt", None), (3, "another prompt", None),
                                  (4, "short", "en"), (5, None, "en"), (6, "loaded prompt", "en")], "seq long, text string, language string")
    have = spark.createDataFrame([("loaded prompt ",), (None,)], "text string")
    got = incremental_append(docs, have)
    assert sorted((r.seq, r.Prompt, r.Language) for r in got.collect()) == [(1, "one long prompt", "en"), (3, "another prompt", "unknown")]
    for line in first_copies(docs)._jdf.queryExecution().executedPlan().toString().splitlines():
        assert "Exchange" not in line or "text" not in line and "p#" not in line
