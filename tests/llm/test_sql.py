"""Queries with SQL against DuckDB, and the token count query against a serial count."""

from __future__ import annotations

import base64
import os
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from oracle_compare import compare, duck  # noqa: E402

from quillspark.llm import queries as Q  # noqa: E402

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("key", sorted(Q.ORACLE))
def test_against_sql(spark, con, key):
    r = compare(spark, con, key, Q.QUERIES[key], Q.ORACLE[key], SF001)
    assert r["cols_match"] and r["types_match"] and r["hash_match"], r


def test_token_counts_query(spark):
    import tiktoken

    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "source", "lang", "text").collect()]
    first = {}
    for i, _, _, t in rows:
        first[t] = min(first.get(t, i), i)
    want = Counter()
    for version, name in (("bpe50k", "byte_bpe_50k.tiktoken"), ("multi50k", "byte_bpe_multi_50k.tiktoken")):
        with open(f"{Q.TOKENIZERS}/{name}", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding(name, pat_str=Q.TOKEN_PATTERN, mergeable_ranks=ranks, special_tokens={})
        for i, source, lang, t in rows:
            kept = first[t] == i
            text = "\n".join(dict.fromkeys(t.split("\n"))) if kept else ""
            for k, n in enumerate((kept, kept and len(coder.encode_ordinary(text)), len(text))):
                want[source, lang, version, k] += int(n)
    got = {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens, r.n_chars) for r in Q.op4_token_counts(spark, SF001).collect()}
    assert got == {k[:3]: tuple(want[(*k[:3], i)] for i in range(3)) for k in want} and any(r[3] != "\n".join(dict.fromkeys(r[3].split("\n"))) for r in rows)

