"""Conversation structure repair: the cheapest edits to a legal turn order, by Hirschberg's divide and conquer.

A legal conversation's role initials read ``(s?(ua)+)?``. Its rows, in order of
their turn, are kept (cost 0), given the role that is due (Rerole, 2) or
deleted (3); empty turns of the role that is due may be inserted anywhere (2).
Blank rows and repetitions of an earlier row must be deleted; a row cut off
before its last full stop adds 1 unless it is deleted. Of the cheapest edits
those whose initials, read as text, come first are the audit.

Four states say what a prefix of the result ends in: nothing, s, u, a. A row
(with the inserts before it) is a 4 x 4 table of costs between states. A
forward vector holds for every state the least cost to get there and the
state's rank, that is the order of the four audits so far: an audit's prefix
up to a row ends in that row's edit, so none is the beginning of another and
their order decides, whatever follows. The backward vector holds the least
cost to the end. Both meet in the middle of a conversation; of the states with
the least sum, the one of the least rank is the crossing of the audit-least
optimum, and either half is solved anew between known states. Memory is linear
in the rows.

Tables and ranks compose, so the same recursion runs on rows and on blocks of
them. Rows are put in order by a range partitioning on (conversation, turn),
which spreads a hot conversation over many tasks; every task packs its rows
into blocks of at most ``BLOCK`` rows, each with its composed table. A
conversation of several blocks meets once as one narrow row per block, to find
the crossings at the blocks' edges; then every block is solved where it lies.
Equal rows are counted before they are exchanged, repetitions found by an
aggregate over digests. The result holds one row per conversation, as the
operator's outcome is one audit and one repaired conversation.

Defined results: a null role or text is one space; rows without a conversation
id form one conversation; null turns come first; rows that share a turn are
ordered by role, then by the digest of the text; the initial of an empty role
is empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE_RUN, let, written

BLOCK = 4096
COPIES = 4096  # rows that one exploded array holds
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
FAR = 1 << 50
NOTHING, S, U, A = range(4)
DUE = (U, U, A, U)  # where Rerole and Insert lead
ROLE = ("", "system", "user", "assistant")
TRAIL = (0, 2, 1, 0)  # inserts that a result ending in a state still needs
LEGAL = {"su", "ua", "au"}


def _row_table(kind: str) -> list[list[tuple[int, str] | None]]:
    """Cheapest (cost, edits) of a row between two states: inserts, then the row's own edit."""
    table: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]
    keeps = {"s": {NOTHING: S}, "u": {NOTHING: U, S: U, A: U}, "a": {U: A}}.get(kind.lower(), {})
    for start in range(4):
        at = start
        for inserts in range(3):
            edits = [(DELETE, "D", at)]
            if kind != "D":
                cut = CUT * kind.isupper()
                edits += [(REROLE + cut, "R", DUE[at]), *([(KEEP + cut, "K", keeps[at])] if at in keeps else [])]
            for cost, edit, to in edits:
                option = (cost + INSERT * inserts, "I" * inserts + edit)
                if table[start][to] is None or option < table[start][to]:
                    table[start][to] = option
            at = DUE[at]
    return table


#: By kind of row: its initial (x: any other), upper case if it is cut off; D: it must go.
ROW = {kind: _row_table(kind) for kind in "suaxSUAXD"}


def _piece(table: list[list[tuple[int, str] | None]]) -> tuple[list[list[int]], list[list[int]]]:
    """Costs between states, and for each start the order of its edits among the ends."""
    costs = [[FAR if o is None else o[0] for o in row] for row in table]
    ranks = [[0] * 4 for _ in range(4)]
    for start, row in enumerate(table):
        for rank, to in enumerate(sorted((t for t in range(4) if row[t]), key=lambda t: row[t][1])):
            ranks[start][to] = rank
    return costs, ranks


PIECE = {kind: _piece(table) for kind, table in ROW.items()}


def forward(pieces: list, lo: int, hi: int, start: int) -> tuple[list[int], list[int]]:
    """Least cost from ``start`` to every state behind the pieces, and the states' ranks."""
    cost, rank = [FAR] * 4, [0] * 4
    cost[start] = 0
    for costs, ranks in pieces[lo:hi]:
        new, key = [FAR] * 4, [(4, 0)] * 4
        for q in range(4):
            if cost[q] < FAR:
                for t in range(4):
                    value = cost[q] + costs[q][t]
                    if value < FAR and (value < new[t] or value == new[t] and (rank[q], ranks[q][t]) < key[t]):
                        new[t], key[t] = value, (rank[q], ranks[q][t])
        order = sorted(range(4), key=key.__getitem__)
        cost, rank = new, [order.index(t) for t in range(4)]
    return cost, rank


def backward(pieces: list, lo: int, hi: int, end: int) -> list[int]:
    """Least cost from every state to ``end`` behind the pieces."""
    cost = [FAR] * 4
    cost[end] = 0
    for costs, _ in reversed(pieces[lo:hi]):
        cost = [min(costs[q][t] + cost[t] for t in range(4)) for q in range(4)]
    return cost


def composed(pieces: list) -> tuple[list[list[int]], list[list[int]]]:
    both = [forward(pieces, 0, len(pieces), start) for start in range(4)]
    return [c for c, _ in both], [r for _, r in both]


def last_state(pieces: list) -> int:
    """Where the audit-least optimum of a whole conversation ends."""
    cost, rank = forward(pieces, 0, len(pieces), NOTHING)
    return min(range(4), key=lambda t: (cost[t] + INSERT * TRAIL[t], rank[t]))


def crossings(pieces: list, start: int, end: int) -> list[int]:
    """The state before every piece, and ``end``."""
    states = [start] * len(pieces) + [end]
    todo = [(0, len(pieces))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        cost, rank = forward(pieces, lo, mid, states[lo])
        rest = backward(pieces, mid, hi, states[hi])
        states[mid] = min(range(4), key=lambda q: (cost[q] + rest[q], rank[q]))
        todo += [(lo, mid), (mid, hi)]
    return states


def realised(kinds: str, roles: list[str], texts: list[str], start: int, end: int, trail: int) -> tuple[str, int, list[str], list[str]]:
    """Audit, cost and repaired roles and texts of a block between two states."""
    states = crossings([PIECE[k] for k in kinds], start, end)
    audit, total, new_roles, new_texts = [], 0, [], []
    for kind, role, text, (q, t) in zip(kinds, roles, texts, pairwise(states)):
        cost, edits = ROW[kind][q][t]
        audit.append(edits)
        total += cost
        for edit in edits:
            if edit != "D":
                new_roles.append(role if edit == "K" else ROLE[DUE[q]])
                new_texts.append("" if edit == "I" else text)
            q = DUE[q] if edit == "I" else q
    for _ in range(trail):
        end = DUE[end]
        audit.append("I")
        total += INSERT
        new_roles.append(ROLE[end])
        new_texts.append("")
    return "".join(audit), total, new_roles, new_texts


BLOCKS = ("conv string, part int, seq int, alone boolean, kinds string, roles array<string>, texts array<string>, costs array<long>, "
          "ranks array<long>, blank long, duplicate long, truncated long, illegal long, first string, last string")


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of the ordered rows of a task. ``alone``: a whole conversation, which no other task can share."""
    part = TaskContext.get().partitionId()
    rows: list[tuple[str, str, str]] = []
    ready: list[tuple] = []
    conv, seq, first_of_part = None, 0, True

    def block(alone: bool) -> tuple:
        kinds = "".join(["D" if f in ("blank", "duplicate") else (k.upper() if f else k)
                         for f, k in ((f, r[:1] if r[:1] in ("s", "u", "a") else "x") for r, _, f in rows)])
        costs, ranks = composed([PIECE[k] for k in kinds]) if not alone else ([], [])
        faults = [f for _, _, f in rows]
        initials = [r[:1] for r, _, _ in rows]
        return (conv, part, seq, alone, kinds, [r for r, _, _ in rows], [t for _, t, _ in rows], sum(costs, []), sum(ranks, []),
                faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                sum(x + y not in LEGAL for x, y in pairwise(initials)), initials[0], initials[-1])

    names = [c.strip().split(" ")[0] for c in BLOCKS.split(",")]
    for batch in batches:
        for name, role, text, fault in zip(batch["conv"], batch["role"], batch["text"], batch["fault"]):
            if rows and name != conv:
                ready.append(block(seq == 0 and not first_of_part))
                first_of_part, rows, seq = False, [], 0
            elif len(rows) == BLOCK:
                ready.append(block(False))
                rows, seq = [], seq + 1
            conv = name
            rows.append((role, text, fault))
            if len(ready) == 500:
                yield pd.DataFrame(ready, columns=names)
                ready = []
    if rows:
        ready.append(block(False))
    if ready:
        yield pd.DataFrame(ready, columns=names)


def _met(blocks: pd.DataFrame) -> pd.DataFrame:
    """States at the edges of a conversation's blocks."""
    blocks = blocks.sort_values(["part", "seq"])
    square = lambda x: [list(x[i:i + 4]) for i in range(0, 16, 4)]
    pieces = [(square(c), square(r)) for c, r in zip(blocks["costs"], blocks["ranks"])]
    states = crossings(pieces, NOTHING, end := last_state(pieces))
    return blocks[["conv", "part", "seq"]].assign(start=states[:-1], end=states[1:], trail=[0] * (len(pieces) - 1) + [TRAIL[end]])


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for kinds, roles, texts, start, end, trail in zip(*(batch[c] for c in ("kinds", "roles", "texts", "start", "end", "trail"))):
            if pd.isna(start):
                start, end = NOTHING, last_state([PIECE[k] for k in kinds])
                trail = TRAIL[end]
            out.append(realised(kinds, roles, texts, int(start), int(end), int(trail)))
        done = pd.DataFrame(out, columns=["audit", "cost", "roles", "texts"], index=batch.index)
        yield batch.drop(columns=["kinds", "roles", "texts", "start", "end", "trail"]).join(done)


def ordered_rows(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, mark, copy, fault): every row of ``turns``, equal ones numbered."""
    rows = turns.select(F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("conv"), F.col(turn).alias("turn"),
                        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    distinct = rows.withColumn("mark", F.md5("text")).groupBy("conv", "turn", "role", "mark").agg(
        F.first("text").alias("text"), F.count("*").alias("n"))
    first = distinct.groupBy("conv", "role", "mark").agg(F.min(F.struct("turn")).alias("seen"))  # nulls come first
    told = distinct.join(first, ["conv", "role", "mark"]).withColumn("again", ~F.col("seen.turn").eqNullSafe(F.col("turn"))).drop("seen")
    many = told.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {COPIES}"))).alias("run"))
    each = many.select("*", F.explode(F.sequence(F.col("run") * COPIES, F.least("n", (F.col("run") + 1) * COPIES) - 1)).alias("copy"))
    fault = let(F.regexp_replace("text", WHITE_RUN, ""), lambda t: F.when(t == "", "blank").when(F.col("again") | (F.col("copy") > 0), "duplicate")
                .when(~F.substring(t, -1, 1).isin(".", "!", "?"), "truncated"))
    return each.select("conv", "turn", "role", "mark", "copy", "text", fault.alias("fault"))


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (role, text)."""
    rows = ordered_rows(turns, conv, turn, role, text)
    keys = ["conv", "turn", "role", "mark", "copy"]
    blocks = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "role", "text", "fault").mapInPandas(_packed, BLOCKS), "blocks")
    split = blocks.where("not alone")
    edges = (split.select("conv", "part", "seq", "costs", "ranks").groupBy("conv")
             .applyInPandas(_met, "conv string, part int, seq int, start int, end int, trail int"))
    none = F.lit(None).cast("int")
    wide = [c for c in blocks.columns if c not in ("alone", "costs", "ranks")]
    todo = (split.join(edges, ["conv", "part", "seq"]).select(*wide, F.lit(False).alias("alone"), "start", "end", "trail")
            .unionByName(blocks.where("alone").select(*wide, "alone", none.alias("start"), none.alias("end"), none.alias("trail"))))
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    solved = todo.mapInPandas(_solved, "conv string, part int, seq int, blank long, duplicate long, truncated long, illegal long, "
                                       "first string, last string, alone boolean, audit string, cost long, roles array<string>, texts array<string>")
    piece = F.struct("part", "seq", "first", "last", "audit", "roles", "texts")
    sums = [F.sum(c).alias(c) for c in counts]
    whole = (solved.where("alone").select("conv", *counts, F.array(piece).alias("pieces"))
             .unionByName(solved.where("not alone").groupBy("conv").agg(*sums, F.sort_array(F.collect_list(piece)).alias("pieces"))))
    pieces = F.col("pieces")
    inner = F.zip_with(F.slice(pieces, 1, F.size(pieces) - 1), F.slice(pieces, 2, F.size(pieces)),
                       lambda x, y: F.when(F.concat(x["last"], y["first"]).isin(*LEGAL), 0).otherwise(1))
    flat = lambda name: F.flatten(F.transform(pieces, lambda p: p[name]))
    gaps = rows.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    kind = turns.schema[conv].dataType
    return whole.join(gaps, "conv").select(
        F.expr("if(conv = '', null, substr(conv, 2))").cast(kind).alias(conv), "gaps", "blank", "duplicate", "truncated",
        (F.col("illegal") + F.aggregate(inner, F.lit(0).cast("long"), lambda n, x: n + x)).alias("illegal"), "cost",
        F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit"),
        F.zip_with(flat("roles"), flat("texts"), lambda r, t: F.struct(r.alias("role"), t.alias("text"))).alias("repaired"))
