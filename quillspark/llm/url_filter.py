"""URL filter: a sorted array of 64-bit xxhash digests, memory-mapped and probed by binary search.

A list entry is a rule, ``host/path``, with a verdict; it fits its host and
all subdomains if the URL's path starts with the rule's path. The index is
one file: sorted digests of the rules, their verdicts, and the full strings
behind an offset table. Executors map the file and never load it whole. For
every URL the possible rules (host suffixes times the rule path lengths that
occur) are hashed and looked up with one ``searchsorted`` per batch; a digest
that is found counts only if the stored string is the probed one. The longest
fitting rule gives the verdict; of equally long ones that with the longer
host, then ``block`` before ``allow``.

The file goes to the shared folder and from there to the executors with
``addFile``. ``build_index`` refuses lists of more than ``max_entries``
entries; ``judge_by_join`` is the way beyond that: the same candidates joined
with the list by digest and string.

Defined results: a null URL, or one without ``://``, has empty host and path
and fits no rule; a URL that fits no rule gets ``default``; repeated entries
of a list count once, ``block`` if they disagree; entries without ``/`` or
with an empty host are refused; an empty list or table is allowed; other
columns pass through, result names that exist already are replaced.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_ascii, scratch_path, text_or_empty

VERDICTS = ("block", "allow")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, lower-cased) and path (up to ``?`` or ``#``)."""
    text = text_or_empty(url)
    rest = F.when(F.instr(text, "://") > 0, F.substring(text, F.instr(text, "://") + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return lower_ascii(host), path


def _checked(entries: Iterable[tuple[str, str]]) -> dict[str, str]:
    rules: dict[str, str] = {}
    for rule, verdict in entries:
        if verdict not in VERDICTS or not rule or rule.startswith("/") or "/" not in rule:
            raise ValueError(f"not a rule: {rule!r}, {verdict!r}")
        host, _, path = rule.partition("/")
        rule = f"{host.lower()}/{path}"
        rules[rule] = "block" if "block" in (verdict, rules.get(rule)) else verdict
    return rules


class DigestIndex:
    """The mapped file: counts, path lengths, digests, offsets, verdicts, strings."""

    def __init__(self, file: str):
        raw = np.memmap(file, dtype=np.uint8, mode="r")
        n, n_len, self.max_labels = (int(x) for x in raw[:24].view("<i8"))
        at = 24

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            size = count * np.dtype(kind).itemsize
            part, at = raw[at:at + size].view(kind), at + size
            return part

        self.path_lengths = [int(x) for x in take(n_len, "<i8")]
        self.digests, self.offsets, self.verdicts = take(n, "<u8"), take(n + 1, "<i8"), take(n, "u1")
        self.strings = raw[at:]

    @staticmethod
    def encode(rules: dict[str, str]) -> bytes:
        keys = [k.encode() for k in rules]
        digests = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype="<u8")
        order = np.argsort(digests, kind="stable")
        lengths = sorted({len(k) - k.index("/") for k in rules})
        ends = np.cumsum([0] + [len(keys[i]) for i in order], dtype="<i8")
        verdicts = np.array([VERDICTS.index(v) for v in rules.values()], dtype="u1")
        head = np.array([len(keys), len(lengths), max((k.split("/")[0].count(".") + 1 for k in rules), default=0)], "<i8")
        return b"".join([head.tobytes(), np.array(lengths, "<i8").tobytes(), digests[order].tobytes(), ends.tobytes(),
                         verdicts[order].tobytes(), *(keys[i] for i in order)])

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Position of each key's entry, -1 without one."""
        found = np.full(len(keys), -1, dtype=np.int64)
        if not len(self.digests) or not keys:
            return found
        probes = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), dtype="<u8", count=len(keys))
        lo = np.searchsorted(self.digests, probes, "left")
        hi = np.searchsorted(self.digests, probes, "right")
        for i in np.flatnonzero(hi > lo):
            for j in range(lo[i], hi[i]):  # more than one if digests collide
                if self.strings[self.offsets[j]:self.offsets[j + 1]].tobytes() == keys[i]:
                    found[i] = j
        return found

    def candidates(self, host: str, path: str) -> list[bytes]:
        """Possible rules of a URL, longest first; of equally long ones the longer host first."""
        labels = host.split(".") if host else []
        suffixes = [".".join(labels[i:]) for i in range(max(0, len(labels) - self.max_labels), len(labels))]
        out = {s + path[:n] for s in suffixes if s for n in self.path_lengths if n <= len(path) and path[:1] == "/"}
        return [k.encode() for k in sorted(out, key=lambda k: (-len(k), -k.index("/")))]

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list, list]:
        """Longest fitting rule and its verdict for each URL (None without one)."""
        most = max(self.path_lengths, default=0)
        urls = list(zip(hosts, (p[:most] for p in paths)))
        options = {u: self.candidates(*u) for u in set(urls)}
        keys = list({k for c in options.values() for k in c})
        at = dict(zip(keys, self.find(keys).tolist()))
        best = {u: next((k for k in c if at[k] >= 0), None) for u, c in options.items()}
        rules = [best[u] for u in urls]
        return ([None if k is None else k.decode() for k in rules],
                [None if k is None else VERDICTS[self.verdicts[at[k]]] for k in rules])


def build_index(spark: SparkSession, entries: Iterable[tuple[str, str]], max_entries: int = 20_000_000) -> str:
    """Write the index to the shared folder, hand it to the executors, and return its file name."""
    rules = _checked(entries)
    if len(rules) > max_entries:
        raise ValueError(f"{len(rules)} entries; the index takes {max_entries}: use judge_by_join")
    path = scratch_path(spark, "urls") + ".digests"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(DigestIndex.encode(rules))
    out.close()
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def judge_urls(df: DataFrame, index: str, url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``."""
    host, path = url_parts(F.col(url))
    keep = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    parted = df.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), path.alias("path"))
    schema = T.StructType([*parted.schema.fields, T.StructField("rule", T.StringType()),
                           T.StructField("verdict", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mapped = DigestIndex(SparkFiles.get(index))
        for batch in batches:
            rules, verdicts = mapped.judge(batch["host"].tolist(), batch["path"].tolist())
            batch["rule"] = pd.Series(rules, dtype=object, index=batch.index)
            batch["verdict"] = pd.Series([v or default for v in verdicts], dtype=object, index=batch.index)
            yield batch

    return parted.mapInPandas(run, schema)


def judge_by_join(df: DataFrame, rules: DataFrame, key: str, url: str = "url", default: str = "allow") -> DataFrame:
    """The same verdicts for lists of any size: ``rules`` (rule, verdict) is joined
    with the candidate rules of every distinct host and path, which decide. Returns
    key (any column of ``df``, null or repeated too), host, path, rule, verdict."""
    host, path = url_parts(F.col(url))
    listed = (rules.withColumn("rule", F.concat(lower_ascii(F.substring_index("rule", "/", 1)),
                                                F.expr("substring(rule, instr(rule, '/'))")))
              .groupBy("rule").agg(F.max("verdict").alias("verdict"))  # block sorts after allow
              .withColumn("digest", F.xxhash64("rule")))
    lengths = [r[0] for r in listed.select((F.length("rule") - F.instr("rule", "/") + 1).alias("n")).distinct().collect()]
    parted = df.select(key, host.alias("host"), path.alias("path"))
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    prefixes = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]))
    options = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    places = parted.where("host <> '' and path like '/%'").select("host", "path").distinct()
    probes = places.select("host", "path", F.explode(F.array_distinct(options)).alias("rule"))
    hits = probes.withColumn("digest", F.xxhash64("rule")).join(listed, ["digest", "rule"])
    rank = F.struct(F.length("rule").alias("n"), F.instr("rule", "/").alias("h"), F.col("rule"), F.col("verdict"))
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("b"))
    return (parted.join(best, ["host", "path"], "left")
            .select(key, "host", "path", F.col("b.rule").alias("rule"),
                    F.coalesce("b.verdict", F.lit(default)).alias("verdict")))
