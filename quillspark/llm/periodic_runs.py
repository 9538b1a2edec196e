"""Periodic runs: repetitions of a text's words found through a dictionary of basic factors.

A run is a longest stretch of words that repeats with a smallest period p and
holds at least ``MIN_PERIODS`` periods and ``MIN_WORDS`` words.

1. Names. The dictionary of basic factors names every stretch of 2^k words of a
   text, equal stretches alike: a name of level k + 1 is the pair of the names
   of its halves, numbered by sorting. A stretch that does not occur twice has
   no longer stretch that does, so such places leave the dictionary.
2. Successors. At level k, every place looks for the next place of its name. Two
   places within a window of twice the stretch's length (a distance of at most
   2^k) are terms of an arithmetic progression whose difference proposes a
   period. A run of period p <= 2^k and length >= 2^k + p has its whole
   progression at every word: 2^k <= 2 * p for the least such level, so three
   periods suffice; periods below 8 are seen at level 3, since a run has 24
   words at least.
3. Extension. Places side by side with the same distance are one proposal; it
   extends to the words that its last stretch and its successor hold. It can
   go no further: another word that kept the period would be one more such
   place. For the same reason no smaller period fits: its places would have
   nearer successors.
4. A run is proposed at every level that suits; equal (start, period) count once.

Texts are cut where they lie (``mapInPandas``), nothing is shuffled; a group of
texts of at most ``GROUP_WORDS`` words is worked on at once, a longer text
alone. Memory grows with the longest single text only.

``find_runs`` returns the runs and the collapsed text: of every run, its first
period stays. Defined results: a null, empty or blank text has no runs and
collapses to the empty text; words are maximal stretches other than space and
\\t..\\r and are compared byte by byte; repeated rows and null ids give a row
each; an empty table gives none; other columns pass through, result names that
exist already are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

MIN_WORDS, MIN_PERIODS = 24, 3
FIRST_LEVEL = 3  # stretches of 8 words: MIN_WORDS holds two of them and a period up to 8
GROUP_WORDS = 1 << 20
CHUNK = 1 << 16


def _named(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """A number per pair, equal for equal pairs."""
    return np.unique(major * (int(minor.max(initial=0)) + 1) + minor, return_inverse=True)[1]


def _repeated(names: np.ndarray) -> np.ndarray:
    return np.bincount(names)[names] > 1


def _proposals(at: np.ndarray, names: np.ndarray, length: int) -> np.ndarray:
    """(start, period, end) of what the progressions of one level's names span. ``at`` ascends."""
    order = np.argsort(names, kind="stable")
    place = at[order]
    step = np.diff(place)
    near = (np.diff(names[order]) == 0) & (step <= length)
    first, period = place[:-1][near], step[near]
    order = np.argsort(first)
    first, period = first[order], period[order]
    if not len(first):
        return np.zeros((0, 3), dtype=np.int64)
    apart = np.flatnonzero((np.diff(first) != 1) | (np.diff(period) != 0))
    opens, closes = np.concatenate([[0], apart + 1]), np.concatenate([apart, [len(first) - 1]])
    return np.stack([first[opens], period[opens], first[closes] + length + period[opens]], axis=1)


def runs_of(words: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs in a sequence of word numbers, by start, then
    period. Several texts may follow one another if they share no number."""
    at, names, k, found = np.arange(len(words)), np.asarray(words, dtype=np.int64), 0, []
    while len(at) and MIN_PERIODS * (1 << max(0, k - 1)) < len(words):
        keep = _repeated(names)
        at, names = at[keep], names[keep]
        if not len(at):
            break
        if k >= FIRST_LEVEL:
            found.append(_proposals(at, names, 1 << k))
        right = np.searchsorted(at, at + (1 << k))  # of a stretch whose second half still has a name
        whole = right < len(at)
        whole[whole] = at[right[whole]] == at[whole] + (1 << k)
        at, names, k = at[whole], _named(names[whole], names[right[whole]]), k + 1
    got = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
    got[:, 2] -= got[:, 0]
    got = got[(got[:, 2] >= MIN_WORDS) & (got[:, 2] >= MIN_PERIODS * got[:, 1])]
    return np.unique(got, axis=0)[:, [0, 2, 1]]  # by start, then period


def dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words stand in some run behind its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word."""
    space = np.zeros(len(text) + 2, dtype=np.int8)
    space[0] = space[-1] = 1
    c = np.frombuffer(text, dtype=np.uint8)
    space[1:-1] = (c == 32) | ((c >= 9) & (c <= 13))
    turn = np.diff(space)
    return np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)


def _joined(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    parts = []
    for at in range(0, len(starts), CHUNK):
        parts.append(b" ".join([text[a:b] for a, b in zip(starts[at:at + CHUNK].tolist(), ends[at:at + CHUNK].tolist())]))
    return b" ".join(parts)


def collapse(texts: list[bytes]) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """Runs and collapsed text of each text, a group of texts at a time."""
    out, group, size = [], [], 0

    def flush() -> None:
        numbers, cuts = [], [0]
        for text, starts, ends in group:
            known: dict[bytes, int] = {}
            own = (known.setdefault(text[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist()))
            numbers.append(np.fromiter(own, dtype=np.int64, count=len(starts)) + cuts[-1])  # no number is shared by two texts
            cuts.append(cuts[-1] + len(starts))
        runs = runs_of(np.concatenate(numbers))
        first = np.searchsorted(runs[:, 0], cuts)
        for i, (text, starts, ends) in enumerate(group):
            own = runs[first[i]:first[i + 1]] - np.array([cuts[i], 0, 0])
            if len(own):
                keep = ~dropped(own, len(starts))
                starts, ends = starts[keep], ends[keep]
            out.append(([tuple(r) for r in own.tolist()], _joined(text, starts, ends)))

    for text in texts:
        starts, ends = word_places(text)
        if group and size + len(starts) > GROUP_WORDS:
            flush()
            group, size = [], 0
        group.append((text, starts, ends))
        size += len(starts)
    if group:
        flush()
    return out


def find_runs(df: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", n_words: str = "n_words") -> DataFrame:
    """``df`` without its text, with the runs of each text, the collapsed text and the number of words."""
    plain = df.drop(runs, collapsed, n_words)
    name = free_name(plain, "text_bytes")
    rows = plain.withColumn(name, F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")).drop(text)
    kind = T.ArrayType(T.StructType([T.StructField(f, T.LongType()) for f in ("start", "length", "period")]))
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != name), T.StructField(runs, kind),
                           T.StructField(collapsed, T.StringType()), T.StructField(n_words, T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at:at + 1000].copy()
                texts = part.pop(name).tolist()
                got = collapse(texts)
                part[runs] = [[dict(zip(("start", "length", "period"), r)) for r in found] for found, _ in got]
                part[collapsed] = [t.decode("utf-8", "replace") for _, t in got]
                part[n_words] = [len(word_places(t)[0]) for t in texts]
                yield part

    return rows.mapInPandas(run, schema)
