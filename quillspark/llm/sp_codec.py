"""SentencePiece encoding and decoding: streaming Viterbi over a unigram view of the vocabulary.

The best segmentation is found from left to right. Only a window is kept: a
piece is at most ``longest`` characters, so the paths that can still win end
in the last ``longest`` positions. Walking their back pointers shows where
they meet; everything before that boundary is the same in all of them, so its
ids are committed and the window moves on. No piece spans the start of a word
or a line break, so all paths meet there and the ids of a word are committed
at its end at the latest. The distinct words of a group of texts (about
``GROUP_CHARS`` characters) are therefore cut once each, the short ones in
step (``lattice.py``), those longer than ``BATCH_CHARS`` by the stream.

Decoding joins the pieces' bytes and drops the mark put before the text; it
gives back every text exactly: characters without a piece, the word mark
itself included, are spelled in byte pieces.

Rows are encoded where they lie (``mapInPandas``), without a shuffle. The
vocabulary's size is checked before it is sent along.

Defined results: a null text counts as empty; an empty text has no ids; an
invalid byte sequence in decoding becomes U+FFFD; of equal paths the one with
the longest last piece wins; repeated rows are encoded each; an empty table
gives no rows; other columns pass through, result names that exist already
are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lattice import Lattice, Trie, parts
from .pieces import Pieces

GROUP_CHARS = 4_000_000
BATCH_CHARS = 48  # longer words are streamed
CHECK_EVERY = 32


NOT_A_PIECE = ()


def stream_ids(text: str, pieces: Pieces) -> Iterator[tuple[int, ...]]:
    """Ids of the best segmentation of ``text``, in committed runs."""
    look, longest, n = pieces.table.get, pieces.longest, len(text)
    start = 0  # of the window; the lists hold positions start, start + 1, ...
    best, back, step = [0.0], [0], [()]

    def path(to: int) -> tuple[int, ...]:
        runs = []
        while to > start:
            runs.append(step[to - start])
            to = back[to - start]
        return tuple([i for ids in reversed(runs) for i in ids])

    for at in range(n):
        here, single = best[at - start], False
        if here is None:
            continue
        for end in range(at + 1, min(n, at + longest) + 1):
            got = look(text[at:end], NOT_A_PIECE)
            if end - start >= len(best):
                best.append(None)
                back.append(0)
                step.append(())
            if got is None:  # longer pieces begin like this
                continue
            if not got:
                break
            single |= end == at + 1
            value, k = here + got[1], end - start
            if best[k] is None or value > best[k]:
                best[k], back[k], step[k] = value, at, got[:1]
        if not single:
            spelled = [pieces.bytes_[b] for b in text[at].encode("utf-8", "surrogatepass")]
            value, k = here + sum(p for _, p in spelled), at + 1 - start
            if best[k] is None or value > best[k]:
                best[k], back[k], step[k] = value, at, tuple(i for i, _ in spelled)
        if at - start >= CHECK_EVERY and at % CHECK_EVERY == 0:
            alive = {k + start for k in range(at + 1 - start, len(best)) if best[k] is not None}
            while len(alive) > 1:
                last = max(alive)
                alive.remove(last)
                alive.add(back[last - start])
            meet = alive.pop()
            if meet > start:
                yield path(meet)
                del best[:meet - start], back[:meet - start], step[:meet - start]
                start = meet
    if n > start:
        yield path(n)


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places of the stretches (start, length), one stretch behind the other."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


class Codec:
    """Encoder of many texts at once: every distinct word of a group is cut once."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.trie = pieces, Trie(pieces)
        marked_break = any("\n" in p and p != "\n" for p in pieces.table)
        self.pattern = r" [^ ]*|[^ ]+" if marked_break else r"\n| [^ \n]*|[^ \n]+"

    def _short(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the runs, one behind the other, and how many each has."""
        trie = self.trie
        lattice = Lattice(runs, trie)
        edges, count = lattice.best(lattice.weights(trie.logp, trie.byte_logp))
        spelled = [trie.byte_ids[lattice.bytes_of(k)] for k in range(len(lattice.spelled))]
        size = np.concatenate([np.ones(len(trie.ids), dtype=np.int64), [len(x) for x in spelled]]).astype(np.int64)
        piece = lattice.piece[edges]
        ids = np.concatenate([trie.ids, *spelled])[_spread((np.cumsum(size) - size)[piece], size[piece])]
        ends = np.concatenate([[0], np.cumsum(size[piece])])
        last = np.cumsum(count)
        return ids, ends[last] - ends[last - count]

    def _ids(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, count = [], []
        for a, b in parts(runs):
            part = runs[a:b]
            far = [k for k, run in enumerate(part) if len(run) > BATCH_CHARS]
            short = [k for k, run in enumerate(part) if len(run) <= BATCH_CHARS]
            got, n = self._short([part[k] for k in short])
            if far:
                each = dict(zip(short, np.split(got, np.cumsum(n)[:-1]))) if short else {}
                for k in far:
                    each[k] = np.array([i for run in stream_ids(part[k], self.pieces) for i in run], dtype=np.int32)
                got, n = np.concatenate([each[k] for k in range(len(part))]), np.array([len(each[k]) for k in range(len(part))])
            ids.append(got)
            count.append(n)
        return np.concatenate(ids), np.concatenate(count)

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        cut, known = re.compile(self.pattern).findall, {}
        own = [np.fromiter([known.setdefault(run, len(known)) for run in cut(" " + t)] if t else (), dtype=np.int64) for t in texts]
        if not known:
            return [np.zeros(0, dtype=np.int32) for _ in texts]
        ids, count = self._ids(list(known))
        first = np.cumsum(count) - count
        return [ids[_spread(first[runs], count[runs])] for runs in own]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()


def encode(df: DataFrame, pieces: Pieces, text: str = "text", ids: str = "ids", check: str | None = None) -> DataFrame:
    """``df`` with the ids of each text and, if ``check`` names a column, whether they decode to it."""
    plain = df.drop(ids, *([check] if check else []))
    schema = T.StructType([*plain.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())),
                           *([T.StructField(check, T.BooleanType())] if check else [])])

    codec = Codec(pieces)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in parts([t or "" for t in batch[text]], GROUP_CHARS):
                part = batch.iloc[a:b].copy()
                part[ids] = codec.encode_all(part[text].tolist())
                if check:
                    part[check] = [spelled(i, pieces.spell) == (t or "") for i, t in zip(part[ids], part[text])]
                yield part

    return plain.mapInPandas(run, schema)


def spelled(ids: np.ndarray, spell: tuple[bytes, ...]) -> str:
    """The text of some ids, without the mark put before it."""
    return b"".join([spell[i] for i in ids.tolist()])[1:].decode("utf-8", "replace")


def decode(df: DataFrame, pieces: Pieces, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of each row's ids (null ids: empty)."""
    plain = df.drop(text)
    spell = pieces.spell

    @F.pandas_udf("string")
    def joined(column: pd.Series) -> pd.Series:
        return pd.Series(["" if i is None else spelled(i, spell) for i in column])

    return plain.withColumn(text, joined(F.col(ids)))
