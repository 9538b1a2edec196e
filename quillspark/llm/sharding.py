"""Sharding by histogram sort: shards of near-equal bytes, equal texts side by side.

Rows are ordered by (hash of the group value, id). The splitters of the order
are found by counting: each round takes candidate key boundaries inside the
intervals that still hold a splitter, counts the exact bytes below each of
them over all partitions (one aggregate; a few hundred sums reach the
driver), and keeps the boundary nearest to the wanted share or a narrower
interval. A boundary between two groups is taken as soon as it is within the
tolerance; only a group too heavy for that is split, by the same rounds over
the ids inside it. Then the rows are exchanged once, by cells much smaller
than a shard, so that no shard is one task.

Defined results: a null text has no bytes and groups with other nulls; a
null id sorts first; rows that tie on everything go to the same or the next
shard in any order, each with its own slot; a text of any length is one row
whose bytes are counted, never read in Python; an empty table gives no rows;
columns other than the named ones pass through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, written

BITS = 62  # of a group's hash
FIRST_PROBES, PROBES = 1024, 64
CELL_BITS, TIE_CELLS = 9, 32


@dataclass
class Splitter:
    """Looks for the boundary with ``target`` bytes below it, in [lo, hi) of the
    group hash or, once ``key`` is set, of the ids of that group."""

    target: int
    below: int  # bytes below lo
    lo: int
    hi: int
    key: int | None = None
    done: bool = False


def _nearest(s: Splitter, edges: list[tuple[int, int]], slack: int) -> bool:
    """Move the splitter to the best of the counted edges (position, bytes below);
    true if it needs no further round."""
    at, got = min(edges, key=lambda e: abs(e[1] - s.target))
    if abs(got - s.target) <= slack or s.key is not None and s.hi - s.lo <= 1:
        s.lo, s.below, s.done = at, got, True
        return True
    left = max((e for e in edges if e[1] <= s.target), key=lambda e: (e[1], e[0]))
    right = min((e for e in edges if e[0] > left[0]), key=lambda e: e[0])
    s.lo, s.below, s.hi = left[0], left[1], right[0]
    return False


def _count(rows: DataFrame, spans: list[tuple[int | None, int, int]], probes: int) -> dict:
    """Exact bytes of each slice of each span: {(span, slice): bytes}."""
    span, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, (key, lo, hi) in enumerate(spans):
        pos = F.col("h") if key is None else F.col("tie")
        here = (pos >= lo) & (pos < hi)
        if key is not None:
            here &= F.col("h") == key
        step = -(-(hi - lo) // probes)
        span = F.when(here, F.lit(i)).otherwise(span)
        slot = F.when(here, F.expr(f"({'h' if key is None else 'tie'} - ({lo}L)) div {step}L")).otherwise(slot)
    counted = rows.select("size", span.alias("span"), slot.alias("slot")).where("span is not null")
    return {(r["span"], r["slot"]): int(r["n"]) for r in
            counted.groupBy("span", "slot").agg(F.sum("size").alias("n")).collect()}


def find_splitters(rows: DataFrame, n_shards: int, tolerance: float) -> list[tuple[int, int | None]]:
    """Boundaries (group hash, id or None) of ``rows`` (h, tie, size): at most one
    less than the shards, each the first position of its shard."""
    top = rows.agg(F.sum("size").alias("n"), F.min("tie").alias("lo"), F.max("tie").alias("hi")).first()
    if not top["n"]:
        return []
    total, slack = int(top["n"]), int(tolerance * int(top["n"]) / n_shards)
    todo = [Splitter(total * i // n_shards, 0, 0, 1 << BITS) for i in range(1, n_shards)]
    splitters, probes = list(todo), FIRST_PROBES
    while todo:
        for s in todo:
            if s.key is None and s.hi - s.lo == 1:  # one group is heavier than the tolerance
                s.key, s.lo, s.hi = s.lo, int(top["lo"]), int(top["hi"]) + 1
        spans = sorted({(s.key, s.lo, s.hi) for s in todo}, key=lambda x: (x[0] is not None, x))
        counts = _count(rows, spans, probes)
        for s in todo:
            i = spans.index((s.key, s.lo, s.hi))
            step = -(-(s.hi - s.lo) // probes)
            edges, below = [(s.lo, s.below)], s.below
            for j in range(-(-(s.hi - s.lo) // step)):
                below += counts.get((i, j), 0)
                edges.append((min(s.lo + (j + 1) * step, s.hi), below))
            _nearest(s, edges, slack)
        todo, probes = [s for s in todo if not s.done], PROBES
    return sorted(((s.lo, None) if s.key is None else (s.key, s.lo) for s in splitters),
                  key=lambda x: (x[0], x[1] is not None, x[1] or 0))


def shard_of(h: Column, tie: Column, splitters: list[tuple[int, int | None]]) -> Column:
    """Number of splitters at or below a row, by halving."""
    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        key, at = splitters[mid]
        past = h >= key if at is None else (h > key) | ((h == key) & (tie >= at))
        return F.when(past, pick(mid + 1, hi)).otherwise(pick(lo, mid))

    return pick(0, len(splitters)).cast("int")


def assign(df: DataFrame, n_shards: int, group: str, size: str, tie: str, tolerance: float = 0.01) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in
    each shard). ``group`` is the hash of what should stay together, ``size``
    the bytes to balance, ``tie`` an integer id. Input columns of these two
    names are replaced."""
    keep = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    h, at, weight, hb, tb, n, start, rank = (free_name(df, c) for c in ("_h", "_tie", "_size", "_hb", "_tb", "_n", "_start", "_rank"))
    rows = written(df.select(*keep, F.shiftrightunsigned(F.col(group), 64 - BITS).alias(h),
                             F.coalesce(F.col(tie), F.lit(-(1 << 62))).cast("long").alias(at),
                             F.col(size).cast("long").alias(weight)), "shard")
    narrow = rows.select(F.col(h).alias("h"), F.col(at).alias("tie"), F.col(weight).alias("size"))
    splitters = find_splitters(narrow, n_shards, tolerance)
    celled = (rows.withColumn("shard", shard_of(F.col(h), F.col(at), splitters))
              .withColumn(hb, F.shiftright(F.col(h), BITS - CELL_BITS).cast("int"))
              .withColumn(tb, F.pmod(F.xxhash64(at), F.lit(TIE_CELLS)).cast("int")))
    # at most (2 ** CELL_BITS + n_shards) * TIE_CELLS cells, whatever the input
    cells = celled.groupBy("shard", hb, tb).agg(F.count("*").alias(n))
    before = Window.partitionBy("shard").orderBy(hb, tb).rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("shard", hb, tb, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy("shard", hb, tb).orderBy(h, at)
    return (celled.withColumn(rank, F.row_number().over(inside))
            .join(F.broadcast(starts), ["shard", hb, tb])
            .select(*keep, "shard", (F.col(start) + F.col(rank) - 1).alias("slot")))


def shard_documents(docs: DataFrame, n_shards: int = 24, overhead: int = 8, tolerance: float = 0.01) -> DataFrame:
    """Documents' ids with ``size`` (UTF-8 bytes of the text plus ``overhead``),
    ``text_crc32``, ``shard`` and ``slot``; equal texts are a group."""
    text = F.col("text").cast("string")
    narrow = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
                         F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
                         F.xxhash64(text).alias("text_group"))
    return assign(narrow, n_shards, "text_group", "size", "doc_id", tolerance).drop("text_group")
