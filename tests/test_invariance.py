"""Results do not depend on input order or partitioning."""

from pyspark.sql import functions as F

from conftest import SF001
from quillspark.operators import harvest as HV
from quillspark.sources import fixtures as FX


def rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_harvest_order_and_partitions(spark):
    raw = FX.raw_prompts(spark, SF001)
    a = rows(HV.harvest_prompts(raw, per_source_limit=5), ["prompt_id", "source", "seq"])
    shuffled = raw.orderBy(F.rand(7)).repartition(3)
    b = rows(HV.harvest_prompts(shuffled, per_source_limit=5), ["prompt_id", "source", "seq"])
    c = rows(HV.harvest_prompts(raw.coalesce(1), per_source_limit=5), ["prompt_id", "source", "seq"])
    assert a == b == c and len(a) > 0


def test_dedup_report_consistent(spark):
    raw = FX.raw_prompts(spark, SF001)
    rep = HV.dedup_report(raw).collect()
    assert sum(r.n_read for r in rep) == raw.count()
    assert sum(r.n_kept for r in rep) == HV.harvest_prompts(raw).count()
    for r in rep:
        assert r.n_short + r.n_copy_in_source + r.n_long + r.n_copy_across + r.n_kept == r.n_read
