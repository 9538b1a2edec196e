"""Source descriptors: hand-worked records, filters in the scans."""

from pyspark.sql import functions as F

from conftest import SF001
from quillspark.operators import descriptors as D
from quillspark.plans import source_plans as SP


def one(df, source, **options):
    return [r.text for r in D.compiled(source, lambda config: df, min_len=0, **options).orderBy("seq").collect()]


def test_message_forms(spark):
    chats = D.Source("c", 1, "thread", is_conversation=True)
    rows = [(1, '[{"role": "user", "content": "a"}, {"content": "b"}]', None), (2, '[{"content": "", "value": "v"}]', None), (3, '["plain", "x"]', '[{"text": "no"}]'),
            (4, None, '[{"text": "other name"}]'), (5, "[]", '["list"]'), (6, None, None), (7, "not json", None), (8, '[{"content": null}]', '["passed over"]')]
    df = spark.createDataFrame(rows, "seq long, thread string, dialogue string")
    assert one(df, chats) == ["a", "v", "plain", "other name", "list"]
    typed = df.select("seq", F.array(F.struct(F.lit("").alias("content"), F.col("dialogue").alias("text"))).alias("thread"))
    assert one(typed.where("seq = 3"), chats) == ['[{"text": "no"}]']
    assert one(df.select("seq", F.array(F.lit("s")).alias("messages")).limit(1), chats) == ["s"]
    assert one(df.select("seq"), chats) == []


def test_context_and_input(spark):
    rows = [(1, "do", " ctx long ", "input long"), (2, "do", " ctx ", "input long"), (3, "do", None, " input long "), (4, "do", "", "short"), (5, None, "context long", ""),
            (6, "do", "0123456789", ""), (7, "do", "01234567890", "")]
    df = spark.createDataFrame(rows, "seq long, instruction string, context string, input string")
    s = D.Source("n", 1, "instruction")
    assert one(df, s) == ["do\n\nContext: ctx long", "do", "do\n\nInput: input long", "do", "do\n\nContext: 0123456789", "do\n\nContext: 01234567890"]
    assert one(df, s, mode="lite")[:3] == ["do", "do", "do\n\nInput:  input long "]
    assert one(df, s, mode="lite")[-2:] == ["do", "do\n\nContext: 01234567890"]
    assert one(df.drop("context"), s)[0] == "do\n\nInput: input long"


def test_filters_reach_each_scan(spark):
    p = D.union_of(SP.sources(spark, SF001))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(role,user)" in p and "(length(text" in p
    scans = [line for line in p.splitlines() if "ReadSchema" in line or "FileScan" in line]
    assert len(scans) == 3 and not any("html" in s for s in scans)
    assert D.compiled(D.Source("d", 1, "text", filter_role="nobody"), SP.dialogue(spark, SF001)).count() == 0
