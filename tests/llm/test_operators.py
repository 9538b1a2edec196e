"""The training-data operators against brute force, round trips and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import (chat_format, decontaminate, lattice_lm, near_dup, quality_mil, quality_rules, sharding,
                            sp_codec, token_rollup, url_filter)
from quillspark.llm import queries as Q
from quillspark.llm.common import scratch_path
from quillspark.llm.pieces import Pieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d"), (5, "a b c d"), (None, "no id at all"),
       (6, "▁ mark  two  spaces\n\nend "), (7, "x" * 30000), (8, "same words here and there " * 400), (9, "日本語 テキスト é ñ")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in ODD], "doc_id long, text string, score string")


@pytest.fixture(scope="module")
def pieces():
    return Pieces.load(f"{Q.TOKENIZERS}/piece_bpe_32k.model")


def prose(rng, n, size=300):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def test_quality_rules_counts(spark, odd):
    def brute(text):
        text = text or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        n = Counter(grams)
        hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
        return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
                len(w) < 50 or 100 * len(hit) > 50 * len(w))
    rng = random.Random(1)
    rows = ODD + [(100 + i, "\n".join(prose(rng, rng.randrange(1, 90), 40) + rng.choice([".", "", "|#"]) for _ in range(4))) for i in range(40)]
    got = quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in got.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text)
        assert not (r.base_failed and r.kept)
    assert quality_rules.apply_rules(odd.limit(0)).count() == 0


def test_quality_rules_lines(spark):
    clean = " ".join(f"word{i}" for i in range(60)) + "."
    junk = " ".join(f"W{i}###" for i in range(60))
    df = spark.createDataFrame([(1, clean), (2, junk), (3, f"{clean}\n{junk}\n{clean}\nHome"), (4, f"{clean}\nAll rights reserved.")],
                               "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.apply_rules(df).collect()}
    assert got[1].kept and got[1].clean_text == clean and not got[2].kept
    assert got[3].clean_text == f"{clean}\n{clean}" and got[3].faults == ["navigation", "punctuation"]
    assert got[4].kept and got[4].clean_text == clean


def test_quality_rules_spaced_capitals(spark):
    clean = " ".join(f"word{i}" for i in range(60)) + "."
    spaced = " ".join("ABCDEFGHIJKLM")
    df = spark.createDataFrame([(1, f"{clean}\n{spaced}"), (2, f"{clean} OK.\n{spaced}")], "doc_id long, text string")
    got = quality_rules.apply_rules(df).collect()
    assert [(r.n_failed_lines, r.faults) for r in got] == [(1, ["capitals"])] * 2


def test_chat_format_round_trip(spark):
    rows = [(1, 0, "user", "<|im_end|>\\<|im_start|> \\\\<\\|"), (1, 1, "assistant", "a\n\n"), (2, 0, "assistant", None),
            (3, 1, "user", "b"), (3, 1, "user", "a"), (3, None, "sys\ntem\\", ""), (4, 0, None, "x"), (None, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_conversations(df)
    parsed = {r.conv_id: [tuple(t) for t in r.back] for r in out.select("conv_id", chat_format.parse(F.col("formatted")).alias("back")).collect()}
    assert parsed[1] == [("user", "<|im_end|>\\<|im_start|> \\\\<\\|"), ("assistant", "a\n\n")]
    assert parsed[3] == [("sys\ntem\\", ""), ("user", "a"), ("user", "b")] and parsed[4] == [("", "x")]
    got = {r.conv_id: r for r in chat_format.digests(out).collect()}
    assert got[1].legal and not got[2].legal and got[1].loss_chars == 3 and got[2].loss_chars == 0
    assert got[1].loss_sha256 == hashlib.sha256(b"a\n\n").hexdigest()
    want = "".join(f"{r}\n{t}\n" for r, t in parsed[1])
    assert got[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_sharding(spark, odd):
    rng = random.Random(2)
    rows = [(i, "hot text " * 20 if i % 3 == 0 else prose(rng, rng.randrange(1, 80))) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_documents(df, 8).collect()
    load, slots = Counter(), {}
    for r in got:
        load[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 4000 and set(load) == set(range(8))
    assert max(load.values()) - min(load.values()) < 0.05 * sum(load.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(odd, 24).count() == len(ODD)
    assert sharding.shard_documents(odd.limit(0), 24).count() == 0


def test_url_filter(spark):
    urls = ["http://a.example.net/en/1", "http://example.net/de/?x", "http://EXAMPLE.COM/de/x#y", "http://net/", "http://x.net",
            None, "nothing", "http://org/fr", "http://b.org/fr/q", "http://notexample.com/de/", "http:///x", "https://x.com?u=http://y.net/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    want = ["example.net/en/", "net/", "example.com/de/", "net/", None, None, None, None, "org/fr/", None, None, None]
    got = url_filter.judge_urls(df, url_filter.build_index(spark, Q.URL_RULES)).orderBy("page_id").collect()
    assert [r.rule for r in got] == want
    assert [r.verdict for r in got][:4] == ["allow", "block", "block", "block"]
    rules = spark.createDataFrame(Q.URL_RULES, "rule string, verdict string")
    joined = url_filter.judge_by_join(df, rules, "page_id").orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in joined] == [(r.rule, r.verdict) for r in got]
    assert [r.rule for r in url_filter.judge_urls(df, url_filter.build_index(spark, [])).collect()] == [None] * len(urls)


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").lower())
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates(spark, odd):
    rng = random.Random(3)
    rows = [(i, t) for i, t in ODD if i not in (None, 5)]
    passage = prose(rng, 60)
    for g in range(12):
        words = prose(rng, 120, 5000).split()
        for k in range(6):
            copy = list(words)
            for _ in range(k % 4):
                copy[rng.randrange(120)] = "edited"
            rows.append((1000 + 10 * g + k, " ".join(copy).title()))
    rows += [(3000 + i, passage + " " + prose(rng, 45, 9000)) for i in range(60)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    nulls = near_dup.near_duplicates(odd).collect()
    assert len(nulls) == len(ODD) and [r.kept for r in nulls if r.doc_id is None] == [True]
    assert near_dup.near_duplicates(odd.limit(0)).count() == 0


def test_near_duplicates_crowd(spark):
    """Pairs at 0.754 inside a crowd that shares a passage (Jaccard 0.724)."""
    rng = random.Random(31)
    passage, fresh, rows = [f"p{i}" for i in range(88)], iter(range(10 ** 6)), []
    own = lambda n: [f"o{next(fresh)}" for _ in range(n)]
    for _ in range(250):
        both = own(2)
        rows += [passage + both + own(14), passage + both + own(14)]
    rows += [passage + own(16) for _ in range(700)]
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    want = brute_groups(rows)
    assert len({c for _, c in want.values()}) == len(rows) - 250
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 150), (300, 300)]
    got = {r.id: r.component for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[150] == got[200] == got[100] == 100


def test_quality_classifier(spark, odd):
    rng = random.Random(4)
    rows = [(i, prose(rng, 150) + (" SHOUT!! ###" * 150 if i % 4 == 0 else "."), int(i % 4 != 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    out = quality_mil.held_out(F.col("doc_id"), 5)
    model = quality_mil.fit(df, df.where(~out), "quality")
    held = quality_mil.score(df, model).where(out).collect()
    assert held and all((r.score >= 0.3) == (r.quality == 1) for r in held)
    got = quality_mil.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    whole, = model.score([b"word one two. " * 200_000]), 
    assert 0 <= whole[0] <= 1
    none = quality_mil.fit(df, df.limit(0), "quality")
    assert {r.score for r in quality_mil.score(odd, none).collect()} == {0.5}


def brute_distance(item, text):
    before = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        now = [i]
        for j, y in enumerate(text, 1):
            now.append(min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (x != y)))
        before = now
    return min(before)


def test_decontamination(spark, odd):
    rng = random.Random(5)
    items = [(i, prose(rng, 25, 4000)) for i in range(20)] + [(50, None), (51, "short"), (52, "")]
    docs, want = [], set()
    for d in range(80):
        body, item = prose(rng, 100, 4000), items[d % 20]
        text = list(item[1])
        for _ in range(int((d % 5) * 0.03 * len(text))):
            text[rng.randrange(len(text))] = "z"
        docs.append((d, body + "\n" + "".join(text).upper() + ". " + body if d % 3 else body))
    for d, t in docs:
        for i, x in items:
            plain = decontaminate.normalise(x)
            if len(plain) >= 40 and brute_distance(plain, decontaminate.normalise(t)) <= int(0.1 * len(plain)):
                want.add((d, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and want
    assert decontaminate.find_leaks(odd, bench).count() == 0
    assert decontaminate.find_leaks(odd, bench.limit(0)).count() == 0


def test_decontamination_one_sided(spark):
    """Insert-only and delete-only edits up to the distance lose no item."""
    rng = random.Random(51)
    items = [(i, prose(rng, 120, 4000)[:n].strip()) for i, n in enumerate([200, 224, 300, 380, 400] * 8)]
    docs, want = [], {}
    for d, (i, item) in enumerate(items + items):
        body, k = list(item), int(0.1 * len(item))
        for at in sorted(rng.sample(range(1, len(body) - 1), k), reverse=True):
            if d < len(items):
                body.insert(at, rng.choice("abcdeinorst"))
            else:
                del body[at]
        docs.append((d, " ".join([prose(rng, 60, 4000), "".join(body), prose(rng, 60, 4000)])))
        want[d, i] = brute_distance(item, decontaminate.normalise(docs[-1][1]))
        assert want[d, i] <= k
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                                   spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in got} == want


def test_decontamination_short_items(spark):
    """Items below min_chars match whole words exactly."""
    items = [(1, "Who is it?"), (2, "is it"), (3, "who"), (4, "who is it"), (5, "t is"), (6, "..."), (7, None)]
    docs = [(1, "he said: who is  it, who is it"), (2, "whois it"), (3, "it is"), (4, None), (5, "WHO!")]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                                   spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.distance, r.span_start, r.span_end) for r in got) == [
        (1, 1, 0, 8, 17), (1, 2, 0, 12, 17), (1, 3, 0, 8, 11), (1, 4, 0, 8, 17), (5, 3, 0, 0, 3)]


def test_codec(spark, odd, pieces):
    back = sp_codec.decode(sp_codec.encode(odd, pieces), pieces).collect()
    assert all(r.decoded == (r.text or "") for r in back) and len(back) == len(ODD)

    def whole(text):  # plain Viterbi over the whole text
        best, via = [0.0] + [None] * len(text), [None] * (len(text) + 1)
        for at in range(len(text)):
            for end, p, ids in pieces.edges(text, at):
                if best[end] is None or best[at] + p > best[end]:
                    best[end], via[end] = best[at] + p, (at, ids)
        out, at = [], len(text)
        while at:
            at, ids = via[at]
            out = [*ids, *out]
        return out
    rng = random.Random(6)
    for _ in range(30):
        text = "".join(rng.choice("abcdeinorst éß日\n ") for _ in range(rng.randrange(1, 300)))
        assert sp_codec.Codec(pieces).encode(text) == whole(" " + text)
        assert [i for part in sp_codec.stream_ids(text, pieces) for i in part] == whole(text)


def test_lattice(spark, odd, pieces):
    from math import exp, log10

    def paths(run, at=0):
        return 1.0 if at == len(run) else sum(exp(p) * paths(run, end) for end, p, _ in pieces.edges(run, at))
    for word in ("the", "quality", "ñandú", "日x"):
        assert abs(exp(lattice_lm.marginal(word, pieces)) / paths(" " + word) - 1) < 1e-9
    held = quality_mil.held_out(F.col("doc_id"), 10)
    got = lattice_lm.score_documents(odd, ~held, pieces).collect()
    train = [t for t, h in odd.select("text", held).collect() if not h]
    counts = Counter(w for t in train for w in WORD.findall((t or "").lower()))
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    base = lambda c: log10((c + 0.1) / (n + 0.1 * (v + 1)))
    want = sorted((len(WORD.findall((t or "").lower())) + 1,
                   round(sum(base(counts[w]) for w in WORD.findall((t or "").lower())) + base(len(train)), 6)) for _, t in ODD)
    assert sorted((r.n_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and r.train_tokens == n for r in got)
    assert lattice_lm.score_documents(odd.limit(0), ~held, pieces).count() == 0


def test_token_rollup(spark):
    import tiktoken  # noqa: F401
    docs = spark.createDataFrame([(1, "s", "en", "one two three"), (2, "s", "en", None), (3, None, "de", "vier")],
                                 "doc_id long, source string, lang string, text string")
    versions = {"v1": f"{Q.TOKENIZERS}/byte_bpe_50k.tiktoken"}
    counted = token_rollup.count_tokens(docs, versions, Q.TOKEN_PATTERN)
    store = token_rollup.Rollup(spark, scratch_path(spark, "rollup"))
    assert store.commit("a", token_rollup.signed(counted, ["v1"], 1)) and not store.commit("a", token_rollup.signed(counted, ["v1"], 1))
    assert {(r.source, r.n_docs, r.n_tokens, r.n_chars) for r in store.totals().collect()} == {("s", 2, 3, 13), (None, 1, 2, 4)} or \
        {(r.source, r.n_docs) for r in store.totals().collect()} == {("s", 2), (None, 1)}
    gone = counted.where("doc_id = 1")
    assert store.commit("b", token_rollup.signed(gone, ["v1"], -1)) and not store.commit("b", token_rollup.signed(gone, ["v1"], -1))
    # deltas of a batch that broke off before its mark don't count
    token_rollup.summed(token_rollup.signed(counted, ["v1"], 1)).write.parquet(f"{store.folder}/tries/broken/deltas")
    left = {(r.source, r.n_docs, r.n_tokens) for r in store.totals().collect()}
    assert ("s", 1, 0) in left
    assert store.commit("d", token_rollup.signed(counted.limit(0), ["v1"], 1)) and store.commit("c", token_rollup.signed(counted, ["v1"], 1))
