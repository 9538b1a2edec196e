"""Persistent index of the keys that a sink holds, for loads that add only what is new.

A key is the 16 bytes of an md5. Keys lie in generations, one per batch, each
dealt into buckets by the key; a bucket has a Bloom filter of one page of
``PAGE_BITS`` bits, and a generation as many buckets as its keys need
(``BUCKET_KEYS`` in each, about one false hit in a hundred).

Looking keys up joins them with the pages first (about 1.4 bytes per indexed
key); only keys that a page may hold are joined with the generation's keys.
The sink's rows are never read, and nothing but keys is exchanged. Generations
are committed by a log, so a batch that is replayed after a failure finds its
generation in place and changes nothing; looking up for a batch leaves out its
own generation and later ones. ``compact`` folds all generations into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commit_log import CommitLog

PAGE_BITS = 32768  # a page of Spark's bitmap functions
BUCKET_KEYS = 3000
PROBES = 7
KEYS = "bucket long, key binary"
PAGES = "bucket long, page binary"


def key_of(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _half(key: Column, first: int) -> Column:
    """Eight bytes of a key as a number."""
    return F.conv(F.substring(F.hex(key), first, 15), 16, 10).cast("long")


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(_half(key, 1), F.lit(buckets)).cast("long")


def _places(key: Column) -> Column:
    """The bits of a page that a key sets."""
    step = F.pmod(_half(key, 17), F.lit(PAGE_BITS - 1)) + 1
    return F.transform(F.sequence(F.lit(1), F.lit(PROBES)), lambda i: F.pmod(F.xxhash64(key) % PAGE_BITS + i * step, F.lit(PAGE_BITS)))


def _may_hold(page: Column, key: Column) -> Column:
    def is_set(at: Column) -> Column:
        byte = F.conv(F.hex(F.substring(page, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte.cast("long"), (at % 8).cast("int")) == 1
    return F.forall(_places(key), is_set)


class KeyIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.log = spark, CommitLog(spark, folder)

    @staticmethod
    def _unit(batch: int) -> str:
        return f"{batch + 1:012d}"  # a seed may be batch -1

    def _generations(self, before: int | None) -> list[dict]:
        """The last compacted generation and the batches behind it."""
        units = self.log.units()
        upto = max([u for u in units if u.startswith("upto-")], default=None)
        last = upto[len("upto-"):] if upto else ""
        stop = self._unit(before) if before is not None else "a"
        if stop <= last:  # a replay of a batch that was folded: the batches' own generations
            upto, last = None, ""
        return [self.log.info(u) for u in [*([upto] if upto else []), *(u for u in units if u[0] != "u" and last < u < stop)]]

    def _write(self, keys: DataFrame, unit: str) -> bool:
        attempt = self.log.new_try()
        n = keys.count()
        buckets = max(1, -(-n // BUCKET_KEYS))
        dealt = keys.select(bucket_of(F.col("key"), buckets).alias("bucket"), "key")
        path = self.log.path(attempt)
        dealt.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key").write.parquet(f"{path}/keys")
        bits = self.spark.read.schema(KEYS).parquet(f"{path}/keys").select("bucket", F.explode(_places(F.col("key"))).alias("at"))
        bits.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("page")).write.parquet(f"{path}/pages")
        return self.log.commit(unit, attempt, buckets=buckets, keys=n)

    def add(self, keys: DataFrame, batch: int) -> bool:
        """Index the distinct keys (``key``) of a batch; false if the batch is indexed."""
        return self._unit(batch) not in self.log.units() and self._write(keys, self._unit(batch))

    def known(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """Those of the distinct ``keys`` that batches before ``before`` (all, if null) have added."""
        out = None
        for g in self._generations(before):
            path = self.log.path(g["try"])
            pages = self.spark.read.schema(PAGES).parquet(f"{path}/pages")
            held = self.spark.read.schema(KEYS).parquet(f"{path}/keys")
            probe = keys.select(bucket_of(F.col("key"), g["buckets"]).alias("bucket"), "key")
            maybe = probe.join(pages, "bucket").where(_may_hold(F.col("page"), F.col("key"))).select("bucket", "key")
            hit = maybe.join(held, ["bucket", "key"], "left_semi").select("key")
            out = hit if out is None else out.unionByName(hit)
        return keys.limit(0).select("key") if out is None else out.distinct()

    def compact(self) -> bool:
        """Fold all generations into one; false if there is nothing to fold."""
        batches = [u for u in self.log.units() if u[0] != "u"]
        if not batches or f"upto-{batches[-1]}" in self.log.units():
            return False
        paths = [f"{self.log.path(g['try'])}/keys" for g in self._generations(None)]
        return self._write(self.spark.read.schema(KEYS).parquet(*paths).select("key").distinct(), f"upto-{batches[-1]}")
