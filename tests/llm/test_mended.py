"""Clashing ids and names, late writers, hard edits, and the pipeline against a serial run."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import decontaminate, near_dup, quality_mil, quality_rules, sharding, sp_codec, token_rollup, url_filter
from quillspark.llm import queries as Q
from quillspark.llm.common import scratch_path
from quillspark.llm.pieces import Pieces


def prose(rng, n, size=3000):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").lower().encode())
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(x, y):
    both = len(x & y)
    return bool(x and y) and 100 * both >= 75 * (len(x) + len(y) - both)


def test_near_dup_ids_that_clash(spark):
    rng = random.Random(1)
    a, b = prose(rng, 60), prose(rng, 60)
    near_a, near_b = a + " tail", "head " + b
    rows = [(1, a), (1, b), (2, b), (3, a), (4, near_a), (2, near_b), (5, prose(rng, 60)), (5, prose(rng, 60)), (None, a), (6, None), (6, ""), (1, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    marks = {F_md5(t): t for _, t in rows}
    seen = {(r.doc_id, marks[r.mark]): (r.component_id, r.kept) for r in got}
    assert seen[1, a] == (1, True) and seen[3, a] == seen[4, near_a] == (1, False)
    assert seen[1, b] == (1, True) and seen[2, b] == seen[2, near_b] == (1, False)
    assert all(c == 5 and k for (i, _), (c, k) in seen.items() if i == 5)
    docs = df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1).cast("long")})
    kept = [tuple(r)[:2] for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (1, b), *[r for r in rows if r[0] == 5], (None, a), (6, "")], key=str)


def F_md5(text):
    import hashlib
    return hashlib.md5((text or "").encode()).hexdigest()


def test_near_dup_hubs_of_many_pairs(spark, monkeypatch):
    """One hub's pairs over several spots, few counters: as brute force says."""
    monkeypatch.setattr(near_dup, "HUB_PAIRS", 7)
    monkeypatch.setattr(near_dup, "COUNT_BITS", (4, 6))
    rng = random.Random(3)
    base = prose(rng, 80).split()
    rows = []
    for i in range(90):
        w = list(base) if i < 50 else prose(rng, 80).split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(999)}"
        rows.append((i, " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))
    for _ in range(20):
        for i in range(len(rows)):
            for j in range(i):
                if alike(sets[i], sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in got} == {i: (comp[i], len(sets[i]), comp[i] == i) for i in range(len(rows))}


def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, ch in enumerate(item, 1):
        diag, row[0] = row[0], i
        for j, other in enumerate(text, 1):
            diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (ch != other))
    return min(row)


@pytest.mark.parametrize(("share", "low"), [(0.05, 40), (0.13, 40), (0.2, 10), (0.3, 10)])
def test_decontamination_by_any_share(share, low):
    """Insertions, deletions, exchanges and all three, of items of 12 to 400 characters."""
    rng = random.Random(int(share * 100))
    found = leaks = 0
    for n in (12, 40, 85, 200, 400):
        if n < low:
            continue
        items = decontaminate.Items([(i, prose(rng, n // 4 + 2)[:n].strip()) for i in range(12)], share, low, 0.9999)
        for at, (i, item) in enumerate(items.rows):
            body, k = list(item), items.k[at]
            if at % 4 == 3:  # evenly spread exchanges: every eighth character or so
                for x in range(k):
                    body[x * len(item) // k] = "!"
            for x in range(k if at % 4 < 3 else 0):
                spot = rng.randrange(1, len(body) - 1) if len(body) > 2 else 0
                body[spot:spot + (at % 4 != 0)] = [] if at % 4 == 1 else ["q"]
            text = decontaminate.normalise(prose(rng, 20) + " " + "".join(body).replace("!", "7") + " " + prose(rng, 20))
            d = brute_distance(item, text)
            got = [r for r in items.leaks([text]) if r[1] == i]
            assert not got or got[0][2] == d <= k
            leaks += d <= k
            found += bool(got)
    assert leaks >= 30 and found >= 0.99 * leaks


def test_decontamination_repetitions():
    assert [decontaminate.repetitions(r, 0.1) for r in (0.5, 0.99, 0.9999)] == [8, 49, 98]
    assert decontaminate.repetitions(0.99, 0.3) > decontaminate.repetitions(0.99, 0.1)
    rng = random.Random(2)
    weak = decontaminate.Items([(i, prose(rng, 40)) for i in range(40)], 0.1, 40, 0.01)
    assert weak.at.shape[2] == 1 and decontaminate.Items([(1, prose(rng, 40))], 0.1, 40, 0.9999).at.shape[2] == 13
    # an unrelated window agrees with few samples
    texts = [prose(rng, 40) + " " + t[:12] + " " + prose(rng, 40) for _, t in weak.rows]
    assert not weak.leaks(texts)


def rollup_docs(spark, rows):
    df = spark.createDataFrame(rows, "source string, lang string, n_chars long, tokens_v long")
    return token_rollup.signed(df, ["v"], 1)


def test_rollup_late_writer_and_compaction(spark):
    store = token_rollup.Rollup(spark, scratch_path(spark, "rollup"))
    assert store.totals().count() == 0 and not store.compact()
    tokens = lambda: {(r.source, r.lang): (r.n_docs, r.n_tokens, r.n_chars) for r in store.totals().collect()}
    first, late = rollup_docs(spark, [("a", "en", 10, 5)]), rollup_docs(spark, [("a", "en", 1000, 500)])
    # a second writer that looked before the first one's mark was there
    token_rollup.summed(late).write.parquet(f"{store.folder}/tries/late/deltas")
    assert store.commit("b1", first) and not store._publish("marks/b1", "late")
    assert tokens() == {("a", "en"): (1, 5, 10)}
    assert not store.commit("b1", late) and tokens() == {("a", "en"): (1, 5, 10)}
    # revision: the old counts go, the new come
    old = rollup_docs(spark, [("a", "en", 10, 5)]).selectExpr("source", "lang", "version", "-n_docs n_docs", "-n_tokens n_tokens", "-n_chars n_chars")
    assert store.commit("b2", old.unionByName(rollup_docs(spark, [("a", "en", 12, 7), (None, None, 3, 1)])))
    want = {("a", "en"): (1, 7, 12), (None, None): (1, 1, 3)}
    assert tokens() == want and store.compact() and tokens() == want and not store.compact()
    assert not store.commit("b1", late) and not store.commit("b2", late) and tokens() == want
    # a writer that looked before the snapshot and marks after it: not counted
    store._fs().delete(store._path("marks/b1"), False)
    assert store._publish("marks/b1", "late") and tokens() == want
    assert store.commit("b3", rollup_docs(spark, [("z", "de", 1, 1)])) and store.compact()
    assert tokens() == {**want, ("z", "de"): (1, 1, 1)}


def test_names_that_clash(spark):
    odd = ["__m", "__c", "_loss", "__base", "__loss", "_counts", "__h", "_h", "_tie", "_size", "__tb", "__host", "__path", "text_read", "__t", "mark", "kept_x"]
    df = spark.createDataFrame([(1, "Some words. " * 30, "http://a.example.net/en/1", *range(len(odd)))], f"doc_id long, text string, url string, {', '.join(f'`{c}` int' for c in odd)}")
    keeps = lambda out: [out.first()[c] for c in odd] == list(range(len(odd)))
    assert keeps(quality_rules.apply_rules(df)) and keeps(url_filter.judge_urls(df, url_filter.build_index(spark, Q.URL_RULES)))
    assert keeps(token_rollup.count_tokens(df, {"v": f"{Q.TOKENIZERS}/byte_bpe_50k.tiktoken"}, Q.TOKEN_PATTERN))
    grouped = df.withColumns({"g": F.xxhash64("text"), "n": F.lit(5).cast("long")})
    assert keeps(sharding.assign(grouped, 3, "g", "n", "doc_id"))
    assert keeps(quality_mil.score(df, quality_mil.Model({})))
    assert keeps(sp_codec.encode(df, Pieces.load(f"{Q.TOKENIZERS}/piece_bpe_32k.model")))
    assert decontaminate.find_leaks(df, df.select(F.col("doc_id").alias("item_id"), "text", "mark")).count() == 1


def test_url_join_without_keys(spark):
    df = spark.createDataFrame([(None, "http://x.net/"), (None, "http://b.org/fr/q"), (1, "http://ok.com/")], "page_id long, url string")
    rules = spark.createDataFrame(Q.URL_RULES, "rule string, verdict string")
    assert sorted((r.host, r.rule) for r in url_filter.judge_by_join(df, rules, "page_id").collect() if r.rule) == [("b.org", "org/fr/"), ("x.net", "net/")]


def test_classifier_learns_from_whole_documents(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(60):
        clean = [prose(rng, 64) + "." for _ in range(rng.randrange(1, 90))]
        if i % 2:  # one passage of many decides
            clean.insert(rng.randrange(len(clean) + 1), " ".join("$#" * 9 for _ in range(64)))
        rows.append((i, "\n".join(clean)))
        labels.append((i, 1 - i % 2))
    docs, named = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    scored = quality_mil.score(docs, quality_mil.fit(docs, named, "quality")).collect()
    assert sum((r.score >= 0.5) == (r.doc_id % 2 == 0) for r in scored) >= 57
    few = quality_mil.fit(docs, named, "quality", max_passages=40)
    assert few.weights or few.prior in (0.0, 0.5, 1.0)
    assert quality_mil.fit(docs, named, "quality", max_passages=0).prior == 0.5


def test_pipeline_end_to_end(spark, tmp_path):
    """Rules and classifier stage as their operators say; groups, leaks and ids by brute force."""
    rng = random.Random(21)
    sentence = lambda n: " ".join(f"{'aeiou'[rng.randrange(5)]}w{rng.randrange(4000)}" for _ in range(n)) + "."
    bench = [sentence(20) for _ in range(4)]
    rows = []
    for i in range(80):
        text = " ".join(sentence(12) for _ in range(8))
        if i % 9 == 4 and i % 7 != 4:  # not a copy of junk
            text = rows[-1][1] + " more"
        if i % 11 == 5:
            text += " " + bench[i % 4]
        if i % 7 == 3:
            text = "#$ %& " * 60
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 7 != 3), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    left = {i: t for i, t, *_ in rows if i % 7 != 3}
    sets = {i: shingles(t) for i, t in left.items()}
    comp = {i: i for i in left}
    for _ in range(10):
        for i in left:
            for j in left:
                if j < i and alike(sets[i], sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    plain = {i: decontaminate.normalise(t) for i, t in left.items()}
    items = [decontaminate.normalise(t) for t in bench]
    want = {i for i in left if comp[i] == i and not any(t in plain[i] for t in items)}
    assert set(got) == want and len(want) < len(left)
    pieces = Pieces.load(f"{Q.TOKENIZERS}/piece_bpe_32k.model")
    for i, r in got.items():
        assert r.text == left[i] and r.round_trip and r.n_ids == len(r.ids)
        assert list(r.ids) == [k for part in sp_codec.stream_ids(" " + r.text, pieces) for k in part]
