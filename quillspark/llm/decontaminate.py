"""Benchmark decontamination: CGK embedding and bit-sampling LSH over item-sized windows, exact edit check.

Texts and items are normalised: lower case, runs of anything but letters and
digits as one space. An item leaks if some stretch of a text is within
``max_share`` of the item's length in edit distance.

1. Windows. An item of m characters, of which k may be edited, is cut into
   pieces of min(PIECE, m // (k + 1)) characters. Within k edits at least
   need = pieces - k >= 1 of them stay whole, on diagonals (place in the text
   less place in the item) at most k apart. The pieces of all items are looked
   up at every place of a text at once (numpy); where ``need`` of an item's
   pieces meet, an item-sized window opens at each of their diagonals. None
   that can leak is lost here, whatever ``max_share`` is.
2. Embedding. A CGK walk goes over a string by random bits: step j writes the
   character under the pointer, which moves on if the bit of (j, character) is
   set. Item and window take the same bits, so edits become differing steps
   until both walks fall into step again: edit distance becomes Hamming
   distance. ``WALKS`` walks are taken.
3. Bit sampling. A repetition samples ``BITS`` steps of a walk; a window is a
   candidate if it agrees with its item on all of them in any repetition. The
   repetitions follow from ``recall`` and the share of steps that agree under
   the hardest edits (``agreement``, measured on insertions or deletions
   alone), for one window; a leak has several.
4. Check. The exact edit distance of the item to the best stretch around the
   windows of a candidate, widened by k on both sides (bit-parallel dynamic
   programme).

An item of fewer than ``min_chars`` characters has no distance: it leaks
where its words stand in a row in a text. Every run of as many words as a
short item has is looked up.

Items are read in blocks of at most ``BLOCK`` rows; a block is a stated query
set sent to the executors, and every text meets every block where it lies,
without a shuffle. The work grows with ``max_share``: the shorter the pieces,
the more windows open.

Defined results: a null or empty text or item (also one without letters or
digits) matches nothing; items shorter than ``min_chars`` after
normalisation match whole words only, at distance 0; an item that repeats in a text counts once, with
its nearest stretch (the first of equals); equal items each match; rows
repeated in the input give repeated results; an empty table on either side
gives no rows; texts of any length are looked up ``SLICE`` characters at a
time; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 8
BLOCK = 20_000
SLICE = 1 << 20
WALKS, BITS = 8, 2
PAIRS = 2000  # windows embedded at once


class _Plain(dict):
    """Letters and digits stand for themselves, other characters for a space."""

    def __missing__(self, point: int) -> int:
        self[point] = point if chr(point).isalnum() else 32
        return self[point]


_PLAIN = _Plain()


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().translate(_PLAIN).split())


def codes(text: str) -> np.ndarray:
    """A byte per character; equal characters have equal bytes."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return (points ^ (points >> 7)).astype(np.uint8)


def _grams(c: np.ndarray, size: int = PIECE) -> np.ndarray:
    """The ``size`` bytes from every position as one number, mixed."""
    if len(c) < size:
        return np.zeros(0, dtype=np.uint64)
    if size == 8:
        g = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(c, 8)).view("<u8").ravel()
    else:
        g = np.zeros(len(c) - size + 1, dtype=np.uint64)
        for j in range(size):
            g |= c[j:len(c) - size + 1 + j].astype(np.uint64) << np.uint64(8 * j)
    return g * np.uint64(0x9E3779B97F4A7C15)


def agreement(max_share: float) -> float:
    """Share of steps on which a walk over an item and over an edited copy agree, at least."""
    return max(0.08, 0.3 - 0.8 * max(0.0, max_share - 0.1))


def repetitions(recall: float, max_share: float) -> int:
    """Samples of BITS steps of which one agrees throughout with probability ``recall``."""
    if not 0 < recall < 1:
        raise ValueError("recall lies between 0 and 1")
    return max(1, ceil(log(1 - recall) / log(1 - agreement(max_share) ** BITS)))


def edit_distance(item: str, stretch: str) -> tuple[int, int]:
    """Least edit distance of ``item`` to any part of ``stretch``, and where that part ends (the first of equals)."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(item):
        masks[ch] = masks.get(ch, 0) | 1 << i
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for j, ch in enumerate(stretch, 1):
        eq = masks.get(ch, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        right, left = down | (~(diag | up) & full), up & diag
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right, left = (right << 1) & full, (left << 1) & full  # an alignment may start anywhere
        up, down = left | (~(diag | right) & full), right & diag
        if score < best:
            best, end = score, j
    return best, end


class Items:
    """A block of items, their pieces and their samples of the walks."""

    def __init__(self, rows: list[tuple[int, str]], max_share: float, min_chars: int, recall: float):
        plain = [(i, normalise(t)) for i, t in rows]
        self.rows = [(i, t) for i, t in plain if len(t) >= max(min_chars, 2)]
        self.short: dict[int, dict[str, list[int]]] = {}  # by number of words
        for i, t in plain:
            if 0 < len(t) < max(min_chars, 2):
                self.short.setdefault(t.count(" ") + 1, {}).setdefault(t, []).append(i)
        self.k = [min(int(max_share * len(t)), len(t) - 1) for _, t in self.rows]
        by_size: dict[int, list[int]] = {}
        for n, (_, t) in enumerate(self.rows):
            by_size.setdefault(min(PIECE, len(t) // (self.k[n] + 1)), []).append(n)
        self.need = [0] * len(self.rows)
        self.tables = []  # (size of the pieces, pieces in order, item and place of each)
        for size, members in sorted(by_size.items()):
            grams, owner, place = [], [], []
            for n in members:
                c = codes(self.rows[n][1])
                at = np.arange(0, len(c) // size * size, size)
                self.need[n] = len(at) - self.k[n]
                grams.append(_grams(c, size)[at])
                owner.append(np.full(len(at), n))
                place.append(at)
            grams, owner, place = (np.concatenate(x) for x in (grams, owner, place))
            order = np.argsort(grams, kind="stable")
            self.tables.append((size, grams[order], owner[order], place[order]))
        self._sample(repetitions(recall, max_share))
        self._index()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "seen"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._index()

    def _index(self) -> None:
        self.seen = []
        for _, grams, _, _ in self.tables:
            seen = np.zeros(1 << 22, dtype=bool)
            seen[(grams >> np.uint64(42)).astype(np.int64)] = True
            self.seen.append(seen)

    def _sample(self, times: int) -> None:
        """The walks' bits, the steps that each item samples and what it has there."""
        steps = 2 * max((len(t) for _, t in self.rows), default=1)
        rng = np.random.default_rng(41)
        self.bits = rng.integers(0, 2, (WALKS, steps, 256), dtype=np.uint8)
        each = -(-times // WALKS)
        self.at = np.zeros((len(self.rows), WALKS, each, BITS), dtype=np.int16 if steps < 1 << 15 else np.int32)
        self.want = np.zeros(self.at.shape, dtype=np.uint8)
        draws = rng.random((WALKS, each, BITS))
        text = [codes(t) for _, t in self.rows]
        size = np.array([len(t) for t in text], dtype=np.int64)
        first = np.cumsum(size) - size
        buf = np.concatenate([*text, [0]]).astype(np.uint8)
        for lo in range(0, len(text), PAIRS):
            hi = min(lo + PAIRS, len(text))
            for w in range(WALKS):
                out, reach = self.walk(buf, first[lo:hi], first[lo:hi] + size[lo:hi], w, 2 * int(size[lo:hi].max()))
                reach = np.clip(reach, 1, 2 * size[lo:hi])
                self.at[lo:hi, w] = (draws[w][None] * reach[:, None, None]).astype(self.at.dtype)
                self.want[lo:hi, w] = np.take_along_axis(out, self.at[lo:hi, w].reshape(hi - lo, -1).astype(np.int64), 1).reshape(hi - lo, each, BITS)

    def walk(self, buf: np.ndarray, start: np.ndarray, stop: np.ndarray, w: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """What walk ``w`` writes from each start (0 from its stop on), and how many steps it takes inside."""
        out = np.zeros((len(start), steps), dtype=np.uint8)
        reach = np.zeros(len(start), dtype=np.int64)
        at, bits = start.copy(), self.bits[w]
        for j in range(steps):
            inside = at < stop
            c = np.where(inside, buf[np.minimum(at, len(buf) - 1)], 0)
            out[:, j] = c
            reach += inside
            at += bits[j][c]
        return out, reach

    def diagonals(self, c: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """For each item that can leak, the diagonals on which enough of its pieces meet, in order."""
        found = []
        for (size, grams, owners, places), seen in zip(self.tables, self.seen):
            hits_at, lo, hi = [], [], []
            for at in range(0, max(1, len(c)), SLICE):
                g = _grams(c[at:at + SLICE + size - 1], size)
                maybe = np.flatnonzero(seen[(g >> np.uint64(42)).astype(np.int64)])
                left, right = np.searchsorted(grams, g[maybe], "left"), np.searchsorted(grams, g[maybe], "right")
                real = right > left
                hits_at.append(maybe[real] + at)
                lo.append(left[real])
                hi.append(right[real])
            at, lo, hi = np.concatenate(hits_at), np.concatenate(lo), np.concatenate(hi)
            if not len(at):
                continue
            times = hi - lo
            entry = np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(times.sum())
            owner, piece = owners[entry], places[entry]
            start = np.repeat(at, times) - piece
            order = np.lexsort((start, owner))
            owner, start, piece = owner[order], start[order], piece[order]
            cuts = np.flatnonzero(np.diff(owner)) + 1
            for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(owner)]])):
                n = int(owner[a])
                k, need = self.k[n], self.need[n]
                if b - a < need:
                    continue
                s, p = start[a:b], piece[a:b]
                if need == 1:
                    found.append((n, np.unique(s)))
                    continue
                stop = np.searchsorted(s, s + k, "right")
                held = np.zeros(b - a + 1, dtype=np.int64)
                past = 0
                for i in np.flatnonzero(stop - np.arange(len(s)) >= need).tolist():
                    if stop[i] > past and len(np.unique(p[i:stop[i]])) >= need:
                        held[i] += 1
                        held[stop[i]] -= 1
                        past = stop[i]
                met = np.cumsum(held[:-1]) > 0
                if met.any():
                    found.append((n, np.unique(s[met])))
        return found

    def agreeing(self, buf: np.ndarray, item: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Which windows agree with their item on all steps of some repetition."""
        out = np.zeros(len(item), dtype=bool)
        size = np.array([len(t) for _, t in self.rows], dtype=np.int64)
        order = np.argsort(size[item], kind="stable")
        for lo in range(0, len(order), PAIRS):
            some = order[lo:lo + PAIRS]
            for w in range(WALKS):
                some = some[~out[some]]
                if not len(some):
                    break
                wrote, _ = self.walk(buf, start[some], stop[some], w, 2 * int(size[item[some]].max()))
                at = self.at[item[some], w]
                got = np.take_along_axis(wrote, at.reshape(len(some), -1).astype(np.int64), 1).reshape(at.shape)
                out[some[(got == self.want[item[some], w]).all(axis=2).any(axis=1)]] = True
        return out

    def exact(self, text: str) -> dict[str, int]:
        """The short items in a normalised text, and where each first starts."""
        found: dict[str, int] = {}
        if not self.short or not text:
            return found
        spaces = [at for at, ch in enumerate(text) if ch == " "]
        first, last = [0, *(at + 1 for at in spaces)], [*spaces, len(text)]
        for n, items in self.short.items():
            for a, b in zip(first, last[n - 1:]):
                t = text[a:b]
                if t in items:
                    found.setdefault(t, a)
        return found

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(index of the text, item id, distance, start, end) in the normalised
        text, one row per text and item."""
        plain = [normalise(t) for t in texts]
        held = [codes(t) for t in plain]
        first = np.cumsum([0, *map(len, held)])
        opened = [(x, n, d) for x, c in enumerate(held) for n, d in self.diagonals(c)]
        out = []
        if opened:
            # where each window lies: a start before the text is its first character
            times = [len(d) for _, _, d in opened]
            of, item = (np.repeat([o[i] for o in opened], times) for i in (0, 1))
            size = np.array([len(t) for _, t in self.rows])[item] + np.array(self.k)[item]
            start = np.concatenate([d for _, _, d in opened])
            near = self.agreeing(np.concatenate([*held, np.zeros(1, dtype=np.uint8)]), item, first[of] + np.maximum(start, 0),
                                 first[of] + np.clip(start + size, 0, first[of + 1] - first[of]))
            cut = np.cumsum([0, *times])
            for (x, n, d), a, b in zip(opened, cut, cut[1:]):
                if near[a:b].any():
                    best = self.nearest(plain[x], n, d)
                    out += [(x, self.rows[n][0], *best)] if best else []
        for x, text in enumerate(plain):
            for t, a in self.exact(text).items():
                out += [(x, i, 0, a, a + len(t)) for i in self.short[t.count(" ") + 1][t]]
        return out

    def nearest(self, text: str, n: int, diagonals: np.ndarray) -> tuple[int, int, int] | None:
        """Distance, start and end of the item's nearest stretch around some diagonals, if it leaks."""
        item, k, best = self.rows[n][1], self.k[n], None
        m = len(item)
        cuts = np.flatnonzero(np.diff(diagonals) > 2 * k) + 1
        for run in np.split(diagonals, cuts):
            begin = max(0, int(run[0]) - k)
            d, end = edit_distance(item, text[begin:max(0, int(run[-1]) + m + k)])
            if d <= k and (best is None or d < best[0]):
                best = (d, max(0, begin + end - m), begin + end)
        return best


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
               item_text: str = "text", max_share: float = 0.1, recall: float = 0.9999, min_chars: int = 40) -> DataFrame:
    """One row per text and item that leaks into it: key, item key, ``distance``,
    ``span_start`` and ``span_end`` in the normalised text. ``recall`` is the chance of
    a leak to be among them, at least; it sets the repetitions."""
    named = items.where(F.col(item_key).isNotNull()).select(F.col(item_key).cast("long").alias("i"), F.col(item_text).cast("string").alias("t"))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    schema = f"`{key}` long, `{item_key}` long, distance long, span_start long, span_end long"

    def against(block: list[tuple[int, str]]) -> DataFrame:
        held = Items(block, max_share, min_chars, recall)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                ids, texts = batch["id"].tolist(), batch["t"].tolist()
                got = [(ids[at + x], *leak) for at in range(0, len(ids), 500) for x, *leak in held.leaks(texts[at:at + 500])]
                frame = pd.DataFrame(got, columns=[key, item_key, "distance", "span_start", "span_end"])
                yield frame.astype({key: "Int64", **{c: "int64" for c in frame.columns[1:]}})

        return rows.mapInPandas(run, schema)

    out, block = None, []
    for row in named.orderBy("i", "t").toLocalIterator():
        block.append((row["i"], row["t"]))
        if len(block) == BLOCK:
            out, block = (against(block) if out is None else out.unionByName(against(block))), []
    if block or out is None:
        out = against(block) if out is None else out.unionByName(against(block))
    return out
