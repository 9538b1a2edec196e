"""Versioned exports: manifests, runs as of a name, broken and repeated runs."""

import pytest
from pyspark.sql import functions as F

from quillspark.sources.exports import Exports
from quillspark.streaming.jobs import run_dir


def test_runs_and_formats(spark):
    out = Exports(spark, run_dir(spark, "exports"))
    assert out.latest() is None and out.as_of("2026") is None
    df = spark.createDataFrame([(1, 'quote " and, comma', ["a", "b"]), (2, "two\nlines", []), (3, "", None), (4, None, ["c"])], "id long, text string, tags array<string>")
    for run, fmt in (("20260101", "csv"), ("20260102", "json"), ("20260103", "parquet")):
        got = out.write(run, df.repartition(3), fmt, note="n")
        assert (got["rows"], got["format"], got["note"], got["columns"]) == (4, fmt, "n", ["id", "text", "tags"]) and got["files"] >= 1
        back = {str(r["id"]): r["text"] for r in out.read(run).collect()}
        assert back["1"] == 'quote " and, comma' and back["2"] == "two\nlines" and not back["3"] and not back["4"]
    assert out.write("20260102", df.limit(1)) is None and out.read("20260102").count() == 4
    assert (out.as_of("20260102_230000"), out.as_of("2025"), out.as_of("9")) == ("20260102", None, "20260103")
    assert [r.tags for r in out.latest().orderBy("id").collect()] == [["a", "b"], [], None, ["c"]]
    assert out.manifests().where("rows = 4").count() == 3
    with pytest.raises(ValueError):
        out.write("20260104", df, "xlsx")


def test_broken_run_is_not_there(spark):
    out = Exports(spark, run_dir(spark, "exports"))
    fails = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        out.write("20260101", fails)
    assert out.runs() == [] and out.write("20260101", spark.range(0))["rows"] == 0 and out.latest().count() == 0
