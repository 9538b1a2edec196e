"""LM scoring: marginal probability of a text over all its segmentations into subword pieces.

The vocabulary's own unigram scores weight the lattice of a word's
segmentations; a forward recursion in log space sums them all. A document's
probability (``score``) is the product over its words and an end symbol,
whose probability is its share of the training tokens.

``fitted_score`` is the same sum under weights learned from the training
texts: one step of expectation maximisation over all training words, smoothed
by the vocabulary's scores, which are worth ``PRIOR`` pieces.

``learned_score`` adds what the training texts say of whole words: a training
word is also a piece of its own, worth its count less a discount (Good-Turing's
for words seen once and twice). What the discounts leave, and one token more,
is shared by the subword segmentations of any word, known or not; their weights
are fitted to the training vocabulary, each word once, which is what new words
look like (``SPELLINGS`` steps of expectation maximisation). The probabilities
of all words and the end symbol, half a token more, add up to one.

Words repeat, so tasks turn blocks of documents into local word numbers and one
row per word of the block. These rows meet by word, once, where a word is
counted and scored (many at once, ``lattice.py``), and go back to the blocks.
What is shuffled is the block vocabularies, a hot word being one row per block.

Defined results: a null, empty or blank text is the end symbol alone; a null
id is scored and counts as training; without training texts, no token is
known, counts are zero, the vocabulary's scores stand and the end symbol is
one of as many symbols as the vocabulary has; rows are kept one by one,
repeated ones included; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, log, log2, log10

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .lattice import Trie, expected_pieces, log_probabilities
from .pieces import Pieces

BLOCK_BYTES = 16 << 20
SMOOTH = 0.1  # of a base count
PRIOR = 1000.0  # expected pieces that the vocabulary's scores are worth
SPELLINGS = 3  # steps that fit the pieces to the training vocabulary


def _logsum(xs: list[float]) -> float:
    top = max(xs)
    return top if len(xs) == 1 else top + log(sum([exp(x - top) for x in xs]))


def forward(run: str, pieces: Pieces) -> tuple[list[float], list[list]]:
    """Log-probability of every prefix of ``run``, and the edges by start."""
    into: list[list[float]] = [[] for _ in range(len(run) + 1)]
    into[0].append(0.0)
    alpha, edges = [], []
    for at in range(len(run)):
        here = _logsum(into[at]) if into[at] else None
        alpha.append(here)
        edges.append(pieces.edges(run, at) if here is not None else [])
        for end, logp, _ in edges[-1]:
            into[end].append(here + logp)
        into[at] = []
    alpha.append(_logsum(into[-1]))
    return alpha, edges


def marginal(word: str, pieces: Pieces) -> float:
    """Natural log-probability of a word (with its mark) over all segmentations."""
    return forward(" " + word, pieces)[0][-1]


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, seq = TaskContext.get().partitionId(), 0
    numbers: dict[bytes, int] = {}
    docs, learnt, size = [], [], 0

    def flush() -> Iterator[pd.DataFrame]:
        name = f"{part}-{seq}"
        for at in range(0, len(docs), 2000):
            out = pd.DataFrame(docs[at:at + 2000], columns=["id", "train", "n", "data"])
            yield out.assign(block=name, word=None, number=None, c=None)[COLUMNS]
        counts = np.bincount(np.concatenate(learnt), minlength=len(numbers)) if learnt else np.zeros(len(numbers), dtype=int)
        words = list(numbers)
        for at in range(0, len(words), 100_000):
            some = words[at:at + 100_000]
            yield pd.DataFrame({"block": name, "id": None, "train": None, "n": None, "data": None, "word": some,
                                "number": np.arange(at, at + len(some)), "c": counts[at:at + len(some)]})[COLUMNS]

    for batch in batches:
        for key, train, text in zip(batch["id"], batch["train"], batch["t"]):
            found = (text or b"").lower().split()
            got = np.array([numbers.setdefault(w, len(numbers)) for w in found], dtype=np.int64)
            which, times = np.unique(got, return_counts=True)
            docs.append((None if pd.isna(key) else int(key), bool(train), len(found),
                         which.astype("<u4").tobytes() + times.astype("<u4").tobytes()))
            if train:
                learnt.append(got)
            size += len(text or b"")
            if size >= BLOCK_BYTES:
                yield from flush()
                numbers, docs, learnt, size, seq = {}, [], [], 0, seq + 1
    if docs:
        yield from flush()


COLUMNS = ["block", "id", "train", "n", "data", "word", "number", "c"]


def fit_pieces(words: DataFrame, pieces: Pieces, trie: Trie) -> Pieces:
    """Pieces with weights fitted to the training words of ``words`` (word, c), from those
    of ``trie``; ``pieces`` are the vocabulary's."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for batch in batches:
            total = total + expected_pieces(_runs(batch["word"]), batch[["c"]].to_numpy(dtype=float), trie)[:, 0]
        if np.ndim(total):
            hit = np.flatnonzero(total)
            yield pd.DataFrame({"piece": hit, "n": total[hit]})

    counted = words.where("c > 0").mapInPandas(count, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    learnt = {r["piece"]: r["n"] for r in counted.collect()}  # at most the vocabulary
    mass = {i: learnt.get(i, 0.0) + PRIOR * exp(p) for i, p in pieces.logps().items()}
    total = sum(mass.values())
    return pieces.reweighted({i: log(m / total) for i, m in mass.items()})


def _runs(words) -> list[str]:
    return [" " + w.decode("utf-8", "replace") for w in words]


def score_documents(docs: DataFrame, train: F.Column, pieces: Pieces, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, train, n_tokens, n_known, train_tokens,
    base_score, score, fitted_score, learned_score. ``train`` tells the rows to learn from."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(train, F.lit(True)).alias("train"),
                       F.col(text).cast("string").cast("binary").alias("t"))
    blocks = written(rows.mapInPandas(_blocks, "block string, id long, train boolean, n long, data binary, "
                                               "word binary, number int, c long"), "blocks")
    listed = blocks.where("word is not null").select("block", "number", "word", "c")
    same, one = Window.partitionBy("word"), Window.partitionBy("word").orderBy("block", "number")
    words = written(listed.withColumn("total", F.sum("c").over(same)).withColumn("first", F.row_number().over(one) == 1)
                    .select("block", "number", "word", F.col("total").alias("c"), "first"), "words")
    distinct = words.where("first").select("word", "c")
    sums = distinct.agg(F.sum("c").alias("n"), *[F.count_if(cond).alias(name) for name, cond in (
        ("v", F.col("c") > 0), ("once", F.col("c") == 1), ("twice", F.col("c") == 2))]).first()
    ends = blocks.where("data is not null and train").count()
    n, v = (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0)
    trie = Trie(pieces)
    fitted = Trie(fit_pieces(distinct, pieces, trie))
    spelling = trie
    for _ in range(SPELLINGS):
        spelling = Trie(fit_pieces(distinct.withColumn("c", F.least("c", F.lit(1))), pieces, spelling))
    discount = min(max(sums["once"] / max(sums["once"] + 2 * sums["twice"], 1), 0.1), 0.9)
    whole, new, end_whole = (n + 1.5, (discount * (sums["v"] or 0) + 1) / (n + 1.5), log10((ends + 0.5) / (n + 1.5)))
    end_logp = log10(ends / n) if ends else -log10(len(pieces.spell))
    floor = n + SMOOTH * (v + 1)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = [(t.logp, t.byte_logp) for t in (trie, fitted, spelling)]
        for batch in batches:  # a word's rows stand together
            which, unique = pd.factorize(batch["word"])
            got = (log_probabilities(_runs(unique), trie, by) / log(10))[which]
            known = np.maximum(batch["c"].to_numpy(dtype=float) - discount, 0) / whole
            spelt = got[:, 2] + log10(new)
            with np.errstate(divide="ignore"):
                mixed = np.logaddexp2(np.log2(known), spelt * log2(10)) / log2(10)
            yield pd.DataFrame({"of": batch["block"], "number": batch["number"], "c": batch["c"], "own": got[:, 0], "learnt": got[:, 1],
                                "mixed": mixed})

    back = words.select("block", "number", "word", "c").mapInPandas(weigh, "of string, number int, c long, own double, learnt double, mixed double")

    def add_up(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        size = int(two["number"].max()) + 1 if len(two) else 0
        value, c = np.zeros((5, size)), two["c"].to_numpy(dtype=float)
        value[:, two["number"].to_numpy(dtype=np.int64)] = [c > 0, np.log10((c + SMOOTH) / floor), two["own"], two["learnt"], two["mixed"]]
        sums = []
        for data in one["data"]:
            got = np.frombuffer(data, dtype="<u4").reshape(2, -1)
            sums.append(value[:, got[0]] @ got[1])
        sums = np.array(sums).reshape(-1, 5)
        return pd.DataFrame({
            key: one["id"].astype("Int64"), "train": one["train"], "n_tokens": one["n"].astype("int64") + 1,
            "n_known": np.rint(sums[:, 0]).astype("int64") + (ends > 0), "train_tokens": n,
            "base_score": sums[:, 1] + log10((ends + SMOOTH) / floor), "score": sums[:, 2] + end_logp, "fitted_score": sums[:, 3] + end_logp,
            "learned_score": sums[:, 4] + end_whole})

    return (blocks.where("data is not null").select("block", "id", "train", "n", "data").groupBy("block")
            .cogroup(back.groupBy("of"))
            .applyInPandas(add_up, f"`{key}` long, train boolean, n_tokens long, n_known long, train_tokens long, "
                                   "base_score double, score double, fitted_score double, learned_score double"))
