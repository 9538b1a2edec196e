"""Learned scores of held-out texts."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.llm import lattice_lm
from quillspark.llm import queries as Q
from quillspark.llm.pieces import Pieces


@pytest.fixture(scope="module")
def pieces():
    return Pieces.load(f"{Q.TOKENIZERS}/piece_bpe_32k.model")


def test_held_out_scores_stand_by_the_base(spark, tmp_path):
    """Words learned whole: held-out texts of known words are not scored by their spelling."""
    rng = random.Random(3)
    words = ["".join(rng.choice(["qua", "zhi", "trel", "on", "xu"]) for _ in range(5)) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(120)] + [(None, None), (1000, "Ωunseen日 " + words[0]), (1001, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op5_lattice_lm(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.n_tokens > 10]
    assert held and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert sum(r.score for r in held) > 1.05 * sum(r.base_score for r in held)  # both are below 0
    assert sum(r.vocabulary_score for r in held) < 2 * sum(r.base_score for r in held)


def test_learned_word_shares(spark, pieces):
    """One document per word: the shares of known words and of the end are what they should be, and
    without anything to learn from all scores are finite."""
    docs = spark.createDataFrame([(0, "ab ab ab cd cd ef"), (1, "ab"), (2, "cd"), (3, "ef"), (4, ""), (5, "gh" * 400)], "doc_id long, text string")
    got = {r.doc_id: r for r in lattice_lm.score_documents(docs, F.col("doc_id") < 1, pieces).collect()}
    n, discount = 7, 1 / 3  # one word seen once, one twice
    end, new = 1.5 / (n + 1.5), (discount * 3 + 1) / (n + 1.5)
    assert abs(10 ** got[4].learned_score - end) < 1e-9
    share = {k: 10 ** got[k].learned_score / end for k in (1, 2, 3)}
    for k, c in ((1, 3), (2, 2), (3, 1)):
        assert (c - discount) / (n + 1.5) < share[k] < (c - discount) / (n + 1.5) + new
    assert sum(share.values()) + end < 1
    assert -1e5 < got[5].learned_score < -100
    none = lattice_lm.score_documents(docs, F.lit(False), pieces).collect()
    assert all(math.isfinite(r.learned_score) and r.learned_score < 0 for r in none)
    assert lattice_lm.score_documents(docs.limit(0), F.lit(True), pieces).count() == 0
