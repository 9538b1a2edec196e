"""Token counts: rollups by source, language and tokenizer version, maintained by signed deltas.

A batch is a table of signed counts: an insert adds a document's counts, a
delete takes the same counts away, a revision takes the old and adds the new.
Counts are additive, so a batch is reduced to one row per rollup key before
anything is exchanged, and totals are the sum over the batches committed.

``Rollup`` maintains the totals in a shared folder. Every try of a commit
writes its deltas to a folder of its own (``tries``); a mark named like the
batch, whose content names the winning try, is put in place by a rename that
does not replace (``marks``). So a batch counts once, whoever is late: a second
writer's deltas lie in a try that no mark names, and a try that broke off
leaves nothing behind that is read. ``compact`` folds the totals and the names
of the batches counted so far into a snapshot, published the same way; totals
are the last snapshot and the deltas of the marks that it doesn't hold.

Tokens are counted where the text lies, with a public byte-pair vocabulary
whose file goes to the executors with ``addFile``.

Defined results: a null text has no tokens and no characters; null source or
language is a key of its own; repeated rows count each time; keys whose
documents were all deleted stay with zeros; an empty batch commits and
changes nothing, an empty store has no totals (an empty table); long texts are
counted whole, one at a time; other columns are ignored by the rollup and pass
through the count, whose result names replace input columns.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

KEYS = ("source", "lang", "version")
MEASURES = ("n_docs", "n_tokens", "n_chars")
SCHEMA = ", ".join([*(f"{k} string" for k in KEYS), *(f"{m} long" for m in MEASURES)])


def count_tokens(df: DataFrame, versions: dict[str, str], pattern: str, text: str = "text") -> DataFrame:
    """``df`` without the text, with ``n_chars`` and one count per version
    (``tokens_<version>``); ``versions`` names the rank files."""
    context = df.sparkSession.sparkContext
    for path in versions.values():
        context.addFile(path)
    names = {f"tokens_{v}": os.path.basename(p) for v, p in versions.items()}
    read = free_name(df, "text_read")
    plain = df.withColumn(read, F.coalesce(F.col(text).cast("string"), F.lit(""))).drop(text, "n_chars", *names)
    schema = T.StructType([*(f for f in plain.schema.fields if f.name != read), T.StructField("n_chars", T.LongType()),
                           *(T.StructField(n, T.LongType()) for n in names)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        coders = {}
        for name, file in names.items():
            with open(SparkFiles.get(file), "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            coders[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            texts = batch.pop(read)
            batch["n_chars"] = texts.str.len().astype("int64")
            for name, coder in coders.items():
                batch[name] = [len(coder.encode_ordinary(t)) for t in texts]
            yield batch

    return plain.mapInPandas(run, schema)


def signed(counted: DataFrame, versions: list[str], sign: int) -> DataFrame:
    """Deltas of documents' counts: one row per document and version."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.col(f"tokens_{v}").alias("n_tokens")) for v in versions]))
    return counted.select("source", "lang", "n_chars", each.alias("x")).select(
        "source", "lang", "x.version", F.lit(sign).cast("long").alias("n_docs"),
        (F.lit(sign) * F.col("x.n_tokens")).alias("n_tokens"), (F.lit(sign) * F.col("n_chars")).alias("n_chars"))


def summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(*[F.sum(m).cast("long").alias(m) for m in MEASURES])


class Rollup:
    """Totals in a shared folder, changed by idempotent batches. The folder's file system
    must have a rename that fails where the target exists."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        fs, at = self._fs(), self._path(kind)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _publish(self, name: str, content: str) -> bool:
        """Put a small file in place unless one is there; it appears whole or not at all."""
        fs, draft, target = self._fs(), self._path(f"drafts/{uuid.uuid4().hex}"), self._path(name)
        fs.mkdirs(target.getParent())
        out = fs.create(draft)
        out.write(content.encode())
        out.close()
        kind = getattr(self._hadoop, "Options$Rename")
        none = self.spark._sc._gateway.new_array(kind, 0)
        context = self._hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, target, none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            fs.delete(draft, False)
            return False
        return True

    def _content(self, name: str) -> str:
        source = self._fs().open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def _snapshot(self) -> tuple[int, str | None]:
        """Number and try of the last snapshot."""
        last = max(self._names("snapshots"), default=None)
        return (0, None) if last is None else (int(last), self._content(f"snapshots/{last}"))

    def _folded(self, at: str | None, batches: list[str]) -> set[str]:
        """Which of ``batches`` a snapshot holds."""
        if at is None or not batches:
            return set()
        held = self.spark.read.parquet(f"{self.folder}/tries/{at}/batches")
        return {r["batch"] for r in held.where(F.col("batch").isin(batches)).collect()}

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Apply a batch; false if it was applied before."""
        if not batch or not all(c.isalnum() or c in "-_" for c in batch):
            raise ValueError(f"not a batch name: {batch!r}")
        if batch in self._names("marks") or self._folded(self._snapshot()[1], [batch]):
            return False
        own = uuid.uuid4().hex
        summed(deltas).write.parquet(f"{self.folder}/tries/{own}/deltas")
        # a mark put where a snapshot holds the batch already is not counted by totals()
        return self._publish(f"marks/{batch}", own) and not self._folded(self._snapshot()[1], [batch])

    def _open(self) -> tuple[int, str | None, list[str]]:
        number, snapshot = self._snapshot()
        marks = self._names("marks")
        folded = self._folded(snapshot, marks)
        return number, snapshot, [m for m in marks if m not in folded]

    def _sum(self, snapshot: str | None, marks: list[str]) -> DataFrame:
        paths = [f"{self.folder}/tries/{self._content(f'marks/{m}')}/deltas" for m in marks]
        paths += [f"{self.folder}/tries/{snapshot}/totals"] if snapshot else []
        return summed(self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA))

    def totals(self) -> DataFrame:
        _, snapshot, marks = self._open()
        return self._sum(snapshot, marks)

    def compact(self) -> bool:
        """Fold all that is committed into a new snapshot; false if there was nothing to
        fold or another writer was faster."""
        number, snapshot, marks = self._open()
        if not marks:
            return False
        own = uuid.uuid4().hex
        self._sum(snapshot, marks).write.parquet(f"{self.folder}/tries/{own}/totals")
        names = self.spark.createDataFrame([(m,) for m in marks], "batch string")
        if snapshot:
            names = names.unionByName(self.spark.read.parquet(f"{self.folder}/tries/{snapshot}/batches"))
        names.write.parquet(f"{self.folder}/tries/{own}/batches")
        return self._publish(f"snapshots/{number + 1:08d}", own)
