"""Near-duplicate groups: universal-hash minima, bands, signature check, exact check, star contraction.

A text's set holds its distinct five-word shingles. Texts with equal sets
are one node from the start. For the others, 200
universal hash minima are cut into 40 bands of five; texts that share a band
are candidates. Inside a band's bucket every member is paired with two hubs
only (the smallest id, and the least in one of four other orders of the ids,
by band), never with every other member. Pairs whose signatures agree too little are dropped
(more than 4.5 standard errors below the threshold), the rest is decided on
the full sets. The members of all buckets that still hold several components
meet in a second round without hubs, a prefix-filter join: in one common
order, rarest first, two sets within the threshold have their first common
shingle near the front of both. Every pair of different components that can
reach the threshold by the places of a common shingle goes on; a passage that
a crowd shares stands behind those places, so the crowd's members don't meet.

Components come from alternating large-star and small-star over the
confirmed links, each step an aggregate and a join, until nothing changes.

Hot groups: copies collapse in a map-side aggregate; hubs are map-side
aggregates; a hub with many partners is sent to several tasks, each with at
most ``HUB_PAIRS`` of them on average, and the partners' texts travel once per
pair; other joins have a unique side, so that Spark can split the other one.
In the prefix join the members of a shingle's largest component never meet
each other.
Fingerprints, links and components stay in tables.

Defined results: a null, empty or blank text has an empty set and no links;
a text with fewer than five words is one shingle; rows without an id link
with nothing and have no component; repeated rows share their component;
different texts that share an id are different nodes: each has the component
of its own text, named by the smallest id in it, and of several texts of that
id the one with the least digest is kept; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WORDS = 5
ROWS, BANDS = 5, 40
SLACK = 0.14  # of the signature's estimate: 4.5 standard errors at 200 minima
TURNS = tuple(int(t) for t in np.random.default_rng(77).integers(1, 1 << 62, 4))  # orders of ids for second hubs
COUNT_BITS = (10, 22)  # shingles are counted by so many bits of their hash, by their number; the counts only set the common order
HUB_PAIRS = 2000

_rng = np.random.default_rng(20240)
_A = _rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)
_SHINGLE = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROW = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text (UTF-8)."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(words) - WORDS + 1
    s = np.zeros(n, dtype=np.uint64)
    for i in range(WORDS):
        s += h[i:i + n] * _SHINGLE[i]
    return np.unique(_mix(s))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of the universal hashes a * x + b mod 2^32."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(ROWS * BANDS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 1024):
        h = x[i:i + 1024, None] * _A
        h += _B
        np.minimum(out, h.min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    return _mix((sig.reshape(BANDS, ROWS).astype(np.uint64) * _ROW).sum(axis=1, dtype=np.uint64) ^ _BAND).view(np.int64)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, mark (digest of the text), n (set size), same (digest of the set), sig (a byte of each minimum), bands."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part, rows = batch.iloc[at:at + 512], []
                for t in part["t"]:
                    s = shingle_set(t)
                    if len(s):
                        sig = signature(s)
                        rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), sig.astype(np.uint8).tobytes(),
                                     band_keys(sig)))
                    else:
                        rows.append((0, None, None, None))
                n, same, sig, bands = map(list, zip(*rows))
                yield pd.DataFrame({"id": part["id"].astype("Int64").to_numpy(), "mark": part["mark"].to_numpy(), "n": n, "same": same, "sig": sig, "bands": bands})

    return identified(docs, key, text).mapInPandas(run, "id long, mark string, n long, same binary, sig binary, bands array<long>")


def identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, t (the text's bytes) and mark (their digest)."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").cast("binary").alias("t"))
    return rows.withColumn("mark", F.md5(F.coalesce("t", F.lit(b""))))


def keyed(rows: DataFrame, keys, turns: tuple[int, ...]) -> DataFrame:
    """(id, key, turn): one row per key; ``turn`` sets the order in which the second hub is least."""
    each = rows.select("id", F.posexplode(keys).alias("at", "key"))
    return each.select("id", "key", F.get(F.array(*[F.lit(t) for t in turns]), F.col("at") % len(turns)).alias("turn"))


def star_pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of members of a bucket and its two hubs. rows: id, key, turn."""
    hubs = (rows.groupBy("key", "turn").agg(F.min("id").alias("h1"), F.max("id").alias("top"),
                                            F.min(F.col("id").bitwiseXOR(F.col("turn"))).alias("h2"))
            .where("h1 < top").select("key", "turn", F.array("h1", F.col("h2").bitwiseXOR(F.col("turn"))).alias("hubs")))
    met = rows.join(hubs, ["key", "turn"]).select("id", F.explode(F.array_distinct("hubs")).alias("hub")).where("id <> hub")
    return met.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def paired(pairs: DataFrame, rows: DataFrame, what: str) -> DataFrame:
    """Pairs (a, b) with ``what`` of both, from ``rows`` (id, what). The ``a`` side is a hub:
    it is sent to as many tasks as its pairs need, the ``b`` side goes along with its pair."""
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("spots"))
    placed = pairs.join(hubs, "a").withColumn("spot", F.pmod(F.xxhash64("b"), F.col("spots")).cast("int"))
    far = placed.join(rows.select(F.col("id").alias("b"), F.col(what).alias("xb")), "b").select("a", "spot", "b", "xb")
    near = hubs.join(rows.select(F.col("id").alias("a"), F.col(what).alias("xa")), "a").select(
        "a", "xa", F.explode(F.sequence(F.lit(0), F.col("spots") - 1)).alias("spot"))
    return far.join(near, ["a", "spot"]).select("a", "b", "xa", "xb")


def likely(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose signatures agree on enough minima."""
    @F.pandas_udf("double")
    def agreement(x: pd.Series, y: pd.Series) -> pd.Series:
        one = np.frombuffer(b"".join(x), dtype=np.uint8).reshape(len(x), -1)
        two = np.frombuffer(b"".join(y), dtype=np.uint8).reshape(len(y), -1)
        return pd.Series((one == two).mean(axis=1))

    return paired(pairs, sigs, "sig").where(agreement("xa", "xb") >= threshold - SLACK).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose full sets have intersection / union >= num / den. texts: id, t."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached = lru_cache(maxsize=64)(shingle_set)
        for batch in batches:
            keep, xa, xb = [], batch.column("xa"), batch.column("xb")
            for i in range(len(batch)):
                one, two = cached(xa[i].as_py()), cached(xb[i].as_py())
                if min(len(one), len(two)) * den < max(len(one), len(two)) * num:
                    keep.append(False)
                    continue
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(den * both >= num * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    return paired(pairs, texts, "t").mapInArrow(run, "a long, b long")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """id, component, s (the shingles as bytes). rows: id, component, t."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at:at + 512]
                yield part[["id", "component"]].assign(s=[shingle_set(t).tobytes() for t in part["t"]])

    return rows.select("id", "component", "t").mapInPandas(run, "id long, component long, s binary")


def _places(shingles: np.ndarray, bits: int) -> np.ndarray:
    return (shingles >> np.uint64(64 - bits)).astype(np.int64)


def count_bits(n_shingles: int) -> int:
    """Enough counters that a place holds one shingle or so by chance, between two bounds."""
    return min(COUNT_BITS[1], max(COUNT_BITS[0], int(n_shingles).bit_length()))


def set_counts(sets: DataFrame, bits: int) -> np.ndarray:
    """How many shingles of all sets fall on each of 2 ** bits places. sets: s."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), 512):
                held = np.frombuffer(b"".join(batch["s"].iloc[at:at + 512]), dtype=np.uint64)
                np.add.at(n, _places(held, bits), 1)
        at = np.flatnonzero(n > 0)
        yield pd.DataFrame({"at": at, "n": n[at]})

    # a count says how many there are at least: what only one shingle holds stays 0
    crowded = sets.select("s").mapInPandas(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).where("n > 1")
    got = crowded.select("at", F.least("n", F.lit((1 << 31) - 1)).cast("int").alias("n")).toArrow()
    out = np.zeros(1 << bits, dtype=np.int32)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out


def prefix_pairs(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a < b) of different components, with all those whose sets have
    intersection / union >= num / den. sets: id, component, s (the shingles).

    With every set in one order, a pair's common shingles lie at or behind the first
    of them, so that one leaves num / (num + den) of both sizes in either set."""
    total = sets.agg(F.sum(F.octet_length("s"))).first()[0] or 0
    bits = count_bits(total // 8)
    counts = set_counts(sets, bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part, keys, left = batch.iloc[at:at + 256], [], []
                for held in part["s"]:
                    s = np.frombuffer(held, dtype=np.uint64)
                    seen = counts[_places(s, bits)]
                    front = np.lexsort((s, seen))[:len(s) - -(-len(s) * num // den) + 1]
                    rest = len(s) - np.arange(len(front))
                    met = seen[front] > 1  # a place with one shingle is of this set alone
                    keys.append(s[front][met].view(np.int64))
                    left.append(rest[met])
                times = [len(k) for k in keys]
                size = part["s"].map(len).to_numpy() // 8
                yield pd.DataFrame({"key": np.concatenate(keys), "id": np.repeat(part["id"].to_numpy(), times),
                                    "component": np.repeat(part["component"].to_numpy(), times),
                                    "n": np.repeat(size, times), "left": np.concatenate(left)})

    fronts = written(sets.select("id", "component", "s").mapInPandas(run, "key long, id long, component long, n long, left long"), "fronts")
    shared = (fronts.groupBy("key", "component").agg(F.count("*").alias("m"))
              .groupBy("key").agg(F.max_by("component", "m").alias("big"), F.count("*").alias("m")).where("m > 1").select("key", "big"))
    met = written(fronts.join(shared, "key").withColumn("other", F.col("component") != F.col("big")).drop("big"), "met")
    # side 0: the others with all; side 1: the largest component with the others
    small = (met.where(F.col("left") * (num + den) >= 2 * num * F.col("n"))
             .select("key", F.when(F.col("other"), 0).otherwise(1).alias("side"), F.col("id").alias("x"),
                     F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("left").alias("lx")))
    large = met.select("key", F.explode(F.when(F.col("other"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("side"),
                       F.col("id").alias("y"), F.col("component").alias("cy"), F.col("n").alias("ny"), F.col("left").alias("ly"))
    pairs = small.join(large, ["key", "side"]).where(
        f"cx <> cy and (nx < ny or nx = ny and x < y) and least(lx, ly) * {num + den} >= {num} * (nx + ny)")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all nodes of ``edges`` (a, b): the smallest id of each
    connected component, by alternating large-star and small-star."""
    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    def large(e: DataFrame) -> DataFrame:  # edges point from the smaller (a) to the larger (b)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        return e.join(least, "a").select(F.col("m").alias("a"), "b").distinct()  # e holds every neighbour above a

    def small(e: DataFrame) -> DataFrame:
        least = e.groupBy("b").agg(F.min("a").alias("m"))
        met = e.join(least, "b")
        return (met.select(F.col("m").alias("x"), F.col("a").alias("y"))
                .unionByName(least.select(F.col("m").alias("x"), F.col("b").alias("y")))
                .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())

    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "star")
    before = None
    while (mark := state(now)) != before:
        before = mark
        now = written(small(large(now)), "star")
    return now.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component")).unionByName(
        now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", num: int = 75, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, kept, mark (md5 of the text)."""
    prints = written(fingerprints(docs, key, text), "prints")
    # a node stands for all texts with the same set; its row is the one of the smallest id
    alike = written(prints.where("n > 0 and id is not null").groupBy("same").agg(F.min(F.struct("id", "mark")).alias("row"))
                    .select("same", F.col("row.id").alias("doc"), F.col("row.mark").alias("mark"), F.monotonically_increasing_id().alias("id")), "nodes")
    row = prints.select(F.col("id").alias("doc"), "mark", "sig", "bands").join(alike.select("doc", "mark", "id"), ["doc", "mark"])
    firsts = written(row.groupBy("id").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands")), "firsts")
    rows = identified(docs, key, text).withColumnRenamed("id", "doc")

    def texts(ids: DataFrame) -> DataFrame:  # ids: distinct
        wanted = alike.join(ids, "id").select("doc", "mark", "id")
        return rows.join(wanted, ["doc", "mark"]).groupBy("id").agg(F.first("t").alias("t"))  # repeated rows once

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        met = written(likely(pairs, firsts, num / den), f"pairs-{name}")
        ends = met.select(F.col("a").alias("id")).unionByName(met.select(F.col("b").alias("id"))).distinct()
        return written(confirmed(met, written(texts(ends), f"texts-{name}"), num, den), f"links-{name}")

    banded = keyed(firsts, F.col("bands"), TURNS)
    links = checked(star_pairs(banded), "hubs")
    parts = written(components(links), "parts")

    # buckets with members of several components: all their members meet without hubs
    where = banded.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = (where.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"))
             .where("lo < hi and n > 2").select("key"))
    crowd = written(where.join(mixed, "key").select("id", "component").distinct(), "crowd")
    sets = written(shingle_sets(texts(crowd.select("id")).join(crowd, "id")), "sets")
    more = checked(prefix_pairs(sets, num, den), "crowd")
    if not more.isEmpty():
        parts = written(components(more.unionByName(parts.where("id <> component").select(
            F.col("component").alias("a"), F.col("id").alias("b")))), "parts2")
    placed = alike.select("id", "same", F.struct("doc", "mark").alias("row")).join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = placed.groupBy("component").agg(F.min("row").alias("stays"))
    named = placed.join(least, "component").select("same", "stays")
    judged = prints.select("id", "n", "same", "mark").join(named, "same", "left")
    stays = F.when(F.col("id").isNotNull(), F.col("stays"))
    return judged.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce(stays["doc"], "id").alias("component_id"),
                         F.coalesce((F.col("id") == stays["doc"]) & (F.col("mark") == stays["mark"]), F.lit(True)).alias("kept"), "mark")
