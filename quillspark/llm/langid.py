"""Language identification: one unigram model of subword pieces per language, marginalised over segmentations.

All languages share a fixed public vocabulary. A language's piece
probabilities come from its training texts: the expected count of every piece
over all segmentations of its words (forward and backward recursion under the
vocabulary's own weights), smoothed by ``PRIOR`` pieces of the vocabulary's
distribution. A text's likelihood in a language is the product over its words
of the word's probability, which a forward recursion sums over all
segmentations. The language of the greatest likelihood wins; the score is its
share of all languages' likelihoods.

Words are runs of letters (with the marks on them) in lower case, so digits,
punctuation and markup say nothing. Tasks take texts in groups of about
``GROUP_CHARS`` characters and work on a group's distinct words at once
(``lattice.py``). Nothing of the texts is shuffled: a task of training sends
one row per language and piece it has met, and the model has at most
``MAX_CELLS`` cells (languages x pieces), which is checked. Counts are added
as integers, so that the order of the tasks does not matter.

Defined results: a null, empty or letterless text is ``und`` with score 0, as
is every text if there was nothing to learn from; ties go to the language that
comes first by name; a null language is not learned from, nor is a text
without letters, though its language is known then and scored by the prior;
repeated rows count each time; rows are scored one by one, whatever their
length; an empty table gives no rows; other columns pass through, result
names that exist already are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name
from .lattice import Trie, expected_pieces, log_probabilities, parts
from .pieces import Pieces

GROUP_CHARS = 12_000_000
PRIOR = 2000.0  # expected pieces that the vocabulary's weights are worth
MAX_CELLS = 16_000_000
UNIT = 1 << 30  # counts are exact multiples of 1 / UNIT
UNKNOWN = "und"
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _groups(texts: pd.Series) -> Iterator[tuple[int, int]]:
    return parts(["" if t is None else t for t in texts], GROUP_CHARS)


def numbered(texts: list[str | None]) -> tuple[list[str], list[np.ndarray]]:
    """The distinct words of some texts, and each text's words by number."""
    known: dict[str, int] = {}
    own = [np.fromiter((known.setdefault(w, len(known)) for w in words_of(t)), dtype=np.int64) for t in texts]
    return [" " + w for w in known], own


@dataclass
class Model:
    """Log-probability of every piece (rank in the trie) and byte per language."""

    langs: list[str]
    trie: Trie
    logp: np.ndarray
    byte_logp: np.ndarray

    def word_logps(self, runs: list[str]) -> np.ndarray:
        """Log-probability of each string in each language."""
        return log_probabilities(runs, self.trie, [(np.ascontiguousarray(p), np.ascontiguousarray(q))
                                                   for p, q in zip(self.logp.T, self.byte_logp.T)])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        runs, own = numbered(texts)
        langs, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.langs or not runs:
            return langs, score
        value = self.word_logps(runs)
        for i, words in enumerate(own):
            if len(words):
                which, times = np.unique(words, return_counts=True)
                total = times @ value[which]
                best = int(total.argmax())
                langs[i], score[i] = self.langs[best], 1 / np.exp(total - total[best]).sum()
        return langs, score


def fit(texts: DataFrame, pieces: Pieces, lang: str = "lang", text: str = "text") -> Model:
    """Learn from all rows of ``texts`` that have a language."""
    rows = texts.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("t"))
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().limit(MAX_CELLS // len(pieces.spell) + 1).collect())
    if len(langs) * len(pieces.spell) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS // len(pieces.spell)} languages: the model would have over {MAX_CELLS} cells")

    trie, place = Trie(pieces), {name: k for k, name in enumerate(langs)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for batch in batches:
            of = batch["lang"].map(place).to_numpy()
            for a, b in _groups(batch["t"]):
                runs, own = numbered(batch["t"].iloc[a:b].tolist())
                times = np.zeros((len(runs), len(langs)))
                for k in range(len(langs)):
                    held = [w for w, x in zip(own, of[a:b]) if x == k]
                    times[:, k] = np.bincount(np.concatenate(held), minlength=len(runs)) if held else 0
                total = total + expected_pieces(runs, times, trie)
        if np.ndim(total):
            piece, k = np.nonzero(total)
            yield pd.DataFrame({"k": k, "piece": piece, "n": np.rint(total[piece, k] * UNIT).astype(np.int64)})

    counted = rows.mapInPandas(count, "k int, piece int, n long").groupBy("k", "piece").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    base = np.zeros(len(pieces.spell))
    for i, p in pieces.logps().items():
        base[i] = np.exp(p)
    mass = np.repeat(PRIOR * base[:, None], len(langs), 1)
    for r in counted.toLocalIterator():  # at most MAX_CELLS rows
        mass[r["piece"], r["k"]] += float(r["n"]) / UNIT
    with np.errstate(divide="ignore"):
        logp = np.log(mass / mass.sum(axis=0, keepdims=True))
    return Model(langs, trie, logp[trie.ids], logp[trie.byte_ids])


def identify(df: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` without its text, with the predicted language of each row's text and the score."""
    plain = df.drop(lang, score) if text not in (lang, score) else df
    name = free_name(plain, "text_read")
    rows = plain.withColumn(name, F.col(text).cast("string")).drop(text)
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != name), T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.pop(name)
            for a, b in _groups(texts):
                part = batch.iloc[a:b].copy()
                part[lang], part[score] = model.predict(texts.iloc[a:b].tolist())
                yield part

    return rows.mapInPandas(run, schema)
