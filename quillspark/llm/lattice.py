"""Lattices of many short strings at once: the pieces that fit at every place, and the recursions over them.

The strings lie one behind the other with a gap between them. A trie over the
vocabulary is walked from all places at once, one character further at each
step, which yields every piece that fits anywhere (an edge). Recursions go
over the strings' places from left to right, all strings in step: the edges
that leave a place of the same rank end in different places, so that one
vector operation per rank does the work of all strings.

Memory is linear in the characters of a batch; callers bound it (``parts``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np

from .pieces import Pieces

PART_CHARS = 1 << 18
SLOT_BITS = 18
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)  # odd, for hashing


class Trie:
    """The vocabulary's pieces by character. ``ids`` and ``logp`` go by a piece's rank."""

    def __init__(self, pieces: Pieces):
        named = sorted((p, v) for p, v in pieces.table.items() if v)
        self.ids = np.array([v[0] for _, v in named], dtype=np.int32)
        self.logp = np.array([v[1] for _, v in named])
        self.longest = pieces.longest
        self.byte_ids = np.array([i for i, _ in pieces.bytes_], dtype=np.int32)
        self.byte_logp = np.array([p for _, p in pieces.bytes_])
        points = sorted({ord(c) for p, _ in named for c in p})
        self.point = np.zeros(0x110000, dtype=np.uint16 if len(points) < 65535 else np.int32)
        self.point[points] = np.arange(1, len(points) + 1)
        node = {p: k for k, p in enumerate(sorted({p[:k] for p, _ in named for k in range(1, len(p) + 1)}))}
        self.piece = np.full(len(node), -1, dtype=np.int32)
        self.piece[[node[p] for p, _ in named]] = np.arange(len(named))
        self.first = np.full(len(points) + 1, -1, dtype=np.int32)
        steps = []
        self.width = len(points) + 1
        for p, k in node.items():
            if len(p) == 1:
                self.first[self.point[ord(p)]] = k
            else:
                steps.append((node[p[:-1]] * self.width + int(self.point[ord(p[-1])]), k))
        key, to = (np.array(x, dtype=np.int64) for x in (zip(*steps) if steps else ((), ())))
        self.inner = np.zeros(len(node), dtype=bool)  # nodes with longer pieces
        self.inner[key // self.width] = True
        self.tables = []  # a step stands in the first table where its slot was free
        while len(key):
            slot = self._slot(key, len(self.tables))
            here = np.unique(slot, return_index=True)[1]
            keys, nexts = np.full(1 << SLOT_BITS, -1, dtype=np.int64), np.zeros(1 << SLOT_BITS, dtype=np.int32)
            keys[slot[here]], nexts[slot[here]] = key[here], to[here]
            self.tables.append((keys, nexts))
            key, to = np.delete(key, here), np.delete(to, here)

    @staticmethod
    def _slot(key: np.ndarray, k: int) -> np.ndarray:
        return ((key.astype(np.uint64) * MULTIPLIERS[k % len(MULTIPLIERS)]) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes one character further, -1 where there is none."""
        want = node * np.int64(self.width) + char
        out = np.full(len(want), -1, dtype=np.int32)
        todo = np.flatnonzero(char > 0)
        for k, (keys, nexts) in enumerate(self.tables):
            slot = self._slot(want[todo], k)
            found = keys[slot]
            hit = found == want[todo]
            out[todo[hit]] = nexts[slot[hit]]
            todo = todo[~hit & (found >= 0)]
        return out


class Lattice:
    """Edges of a batch of strings: ``start``, ``end``, ``piece`` by the start's rank
    in its string (``cuts``). A character without a piece of its own has an edge
    ``piece`` >= the number of pieces: it names a row of ``spelled`` (code points)."""

    def __init__(self, runs: list[str], trie: Trie):
        self.trie = trie
        length = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))
        codes = np.frombuffer("\0".join([*runs, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        self.first = np.cumsum(length + 1) - length - 1
        self.last = self.first + length
        chars = trie.point[codes].astype(np.int64)
        chars[self.last] = 0
        inside = np.ones(len(codes), dtype=bool)
        inside[self.last] = False
        self.size = len(codes)
        at = np.flatnonzero(inside)
        rank = at - np.repeat(self.first, length)
        node = trie.first[chars[at]]
        starts, pieces, spans, ranks = [], [], [], []
        alone = np.ones(len(at), dtype=bool)
        place, k = np.arange(len(at)), 1
        while len(place):
            fits = node >= 0
            place, node = place[fits], node[fits]
            piece = trie.piece[node]
            real = piece >= 0
            if k == 1:
                alone[place[real]] = False
            starts.append(place[real])
            pieces.append(piece[real])
            spans.append(np.full(int(real.sum()), k))
            more = trie.inner[node]
            place, node = place[more], node[more]
            k += 1
            node = trie.step(node, chars[at[place] + k - 1])
        bare = np.flatnonzero(alone)
        self.spelled, which = np.unique(codes[at[bare]], return_inverse=True)
        starts.append(bare)
        pieces.append(which.astype(np.int32) + len(trie.ids))
        spans.append(np.ones(len(bare), dtype=np.int64))
        place = np.concatenate(starts)
        order = np.argsort(rank[place].astype(np.int32), kind="stable")
        place = place[order]
        self.start, self.piece = at[place], np.concatenate(pieces)[order]
        self.end = self.start + np.concatenate(spans)[order]
        top = int(length.max(initial=0))
        self.cuts = np.searchsorted(rank[place], np.arange(top + 1))

    def bytes_of(self, k: int) -> list[int]:
        return list(chr(self.spelled[k]).encode("utf-8", "surrogatepass"))

    def weights(self, logp: np.ndarray, byte_logp: np.ndarray) -> np.ndarray:
        """``logp`` and the weight of each spelled character."""
        return np.concatenate([logp, [byte_logp[self.bytes_of(k)].sum() for k in range(len(self.spelled))]])

    def steps(self) -> Iterator[slice]:
        for a, b in zip(self.cuts, [*self.cuts[1:], len(self.start)]):
            yield slice(a, b)

    def forward(self, weight: np.ndarray, head: np.ndarray | None = None, ranks: int | None = None) -> np.ndarray:
        """Log-probability of every prefix, over all its segmentations. A single string may
        go on from what is known of its first places (``head``), for so many ranks."""
        alpha = np.full(self.size, -np.inf)
        alpha[self.first] = 0.0
        if head is not None:
            alpha[:len(head)] = head
        for s in islice(self.steps(), ranks):
            end = self.end[s]
            alpha[end] = np.logaddexp(alpha[end], alpha[self.start[s]] + weight[self.piece[s]])
        return alpha

    def expected(self, weight: np.ndarray) -> np.ndarray:
        """Probability of every edge, given its string."""
        alpha = self.forward(weight)
        beta = np.full(self.size, -np.inf)
        beta[self.last] = 0.0
        flow = weight[self.piece]
        for s in reversed(list(self.steps())):  # edges of one rank and string share their start
            value = flow[s] + beta[self.end[s]]
            start = self.start[s]
            order = np.argsort(start, kind="stable")
            start, value = start[order], value[order]
            heads = np.flatnonzero(np.concatenate([[True], start[1:] != start[:-1]])) if len(start) else np.zeros(0, dtype=int)
            if len(heads):
                beta[start[heads]] = np.logaddexp.reduceat(value, heads)
        whole = np.repeat(alpha[self.last], self.last - self.first + 1)
        return np.exp(alpha[self.start] + flow + beta[self.end] - whole[self.start])

    def best(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of each string's best segmentation, in order, and how many it has. Of
        equal paths, the one whose last piece is longest wins."""
        value = np.full(self.size, -np.inf)
        value[self.first] = 0.0
        back = np.full(self.size, -1, dtype=np.int64)
        for s in self.steps():
            end = self.end[s]
            new = value[self.start[s]] + weight[self.piece[s]]
            better = new > value[end]
            value[end[better]] = new[better]
            back[end[better]] = np.arange(s.start, s.stop)[better]
        used = np.zeros(self.size, dtype=bool)
        at = self.last[self.last > self.first]
        while len(at):
            used[at] = True
            at = self.start[back[at]]
            at = at[back[at] >= 0]
        marks = np.concatenate([[0], np.cumsum(used)])
        return back[used], marks[self.last + 1] - marks[self.first]


def log_probabilities(runs: list[str], trie: Trie, by: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Log-probability of each string over all its segmentations, for each of several
    weightings (pieces' and bytes' log-probabilities)."""
    out = np.zeros((len(runs), len(by)))
    for a, b in parts(runs):
        if b - a == 1 and len(runs[a]) > PART_CHARS:
            out[a] = [_long_forward(runs[a], trie, *w) for w in by]
            continue
        lattice = Lattice(runs[a:b], trie)
        for k, w in enumerate(by):
            out[a:b, k] = lattice.forward(lattice.weights(*w))[lattice.last]
    return out


def _long_forward(run: str, trie: Trie, logp: np.ndarray, byte_logp: np.ndarray, step: int = PART_CHARS) -> float:
    """Stretch by stretch: only the places that the next stretch's pieces can start from are kept."""
    head = np.zeros(1)
    for at in range(0, len(run), step):
        lattice = Lattice([run[at:at + step + trie.longest]], trie)
        rest = len(run) - at
        alpha = lattice.forward(lattice.weights(logp, byte_logp), head, min(step, rest))
        head = alpha[step:step + trie.longest]
    return float(alpha[rest])


def parts(runs: list[str], limit: int = PART_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive parts of ``runs`` of about ``limit`` characters."""
    if not runs:
        return
    total = np.cumsum(np.fromiter(map(len, runs), dtype=np.int64, count=len(runs)) + 1)
    a = 0
    while a < len(runs):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + limit, "right")))
        yield a, b
        a = b


def expected_pieces(runs: list[str], times: np.ndarray, trie: Trie) -> np.ndarray:
    """Expected count of every piece and byte piece (by id) in ``times`` copies (strings x
    columns) of the strings: ids x columns. A string beyond ``PART_CHARS`` characters counts
    in stretches of that length."""
    if any(len(run) > PART_CHARS for run in runs):
        cut = [[run[at:at + PART_CHARS] for at in range(0, max(1, len(run)), PART_CHARS)] for run in runs]
        times = np.repeat(times, list(map(len, cut)), axis=0)
        runs = [part for some in cut for part in some]
    total = np.zeros((int(max(trie.ids.max(initial=0), trie.byte_ids.max(initial=0))) + 1, times.shape[1]))
    for a, b in parts(runs):
        lattice = Lattice(runs[a:b], trie)
        share = lattice.expected(lattice.weights(trie.logp, trie.byte_logp))
        of = np.searchsorted(lattice.last, lattice.start)  # the edge's string
        plain = lattice.piece < len(trie.ids)
        for k in range(times.shape[1]):
            mass = share * times[a:b, k][of]
            total[:, k] += np.bincount(trie.ids[lattice.piece[plain]], weights=mass[plain], minlength=len(total))
            spelled = np.bincount(lattice.piece[~plain] - len(trie.ids), weights=mass[~plain], minlength=len(lattice.spelled))
            for c in np.flatnonzero(spelled):
                np.add.at(total[:, k], trie.byte_ids[lattice.bytes_of(c)], spelled[c])
    return total
