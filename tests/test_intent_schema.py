"""Declarative intent scan: defaults, rejects, modes, malformed rows, other column orders."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import intent_schema as I
from quillspark.streaming.jobs import run_dir


def write(spark, lines):
    path = f"{run_dir(spark, 'csv')}/a.csv"
    hadoop = spark._jvm.org.apache.hadoop.fs
    out = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop.Path(path))
    out.write("\n".join(lines).encode())
    out.close()
    return path


def test_scan_of_a_file(spark):
    path = write(spark, ['id,Object, UserCount ,Action,action_rank,FeedbackCount,Reliable,Active_Days_p90',
                         '1, EMAIL ," 1,234 ",FIND,3,,true,', '2,?,,FIND,,12,TRUE,2.5', '3,,,  ,4,1,FALSE,x', '4,DOC,,READ,5,3.0,no,1',
                         '5,DOC,,READ,5', '6,"DO\nC",,READ,+7, 8 ,,1e2'])
    raw = I.read_table(spark, path)
    rows = {m: {r.id: r for r in I.scan(raw, m, keep=("id",)).collect()} for m in I.MODES}
    one = rows["any"]["1"]
    assert (one.object, one.user_count, one.action_rank, one.feedback_count, one.reliable, one.active_days_p90, one.rank_in_action, one.conversation_count) == (
        "EMAIL", "1,234", 3, 0, True, 1.0, 0, 0.0)
    assert {k: r.reject for k, r in rows["any"].items()} == {"1": None, "2": "bad action_rank", "3": "bad active_days_p90", "4": "bad feedback_count", "5": "malformed row", "6": None}
    assert rows["named"]["3"].reject == "missing action or object" and rows["named"]["2"].reject == "bad action_rank"
    assert rows["known"]["2"].reject == "missing action or object" and rows["known"]["6"].object == "DO\nC" and rows["known"]["6"].active_days_p90 == 100.0
    with pytest.raises(ValueError):
        I.scan(raw, "v9")


def test_records_carry_every_column(spark):
    raw = spark.createDataFrame([("7", "FIND", "DOC", "1", "2")], "intent_id string, Action string, Object string, action_rank string, rank_in_action string")
    intents = I.scan(raw, keep=("intent_id",))
    made = spark.createDataFrame([("7", "Find the doc.", "find"), ("8", "x", "y")], "intent_id string, synthetic_prompt string, action string")
    got = I.records(made, intents).collect()
    assert len(got) == 1 and got[0].action == "FIND" and set(got[0].asDict()) == {"intent_id", "synthetic_prompt", *(f.column for f in I.FIELDS)}
    assert len(I.FIELDS) == 40


def test_records_broadcast_no_side(spark):
    """Both sides grow with the intents: neither may be broadcast for a small guess of its size."""
    raw = spark.range(30).select("id", *[F.when(F.col("id") % 5 == 0, F.lit(" ")).otherwise(F.lit("7")).alias(f.header) for f in I.FIELDS])
    made = spark.range(30).select("id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("slot"), F.lit("x").alias("action"))
    out = I.records(made, I.scan(raw, keep=("id",)), "id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert out.count() == 240 and {r.action for r in out.select("action").distinct().collect()} == {"7"}
