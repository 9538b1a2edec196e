"""Periodic runs, turn repair and language identification against brute force."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import langid, lattice, lattice_lm, periodic_runs, sp_codec, turn_repair
from quillspark.llm import queries as Q
from quillspark.llm.pieces import Pieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def pieces():
    return Pieces.load(f"{Q.TOKENIZERS}/piece_bpe_32k.model")


def brute_runs(w):
    n, out = len(w), []
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            seg = w[s:i + p]
            if len(seg) >= max(24, 3 * p) and not any(seg[q:] == seg[:-q] for q in range(1, p)):
                out.append((s, len(seg), p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted_words(rng):
    n, kinds = rng.randrange(0, 200), rng.choice([1, 2, 2, 3, 6, 60])
    w = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 30:
            a, p = rng.randrange(n), rng.choice([1, 2, 3, 5, 7, 8, 9, 12, 16, 17, 31, 33, 40])
            for i in range(a + p, rng.randrange(a, n)):
                w[i] = w[i - p]
    return w


def brute_collapse(w):
    runs = brute_runs(w)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return runs, " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_sequences():
    rng = random.Random(3)
    texts = [planted_words(rng) for _ in range(500)]
    got = periodic_runs.collapse([" ".join(w).encode() for w in texts])
    for w, (runs, text) in zip(texts, got):
        assert (runs, text.decode()) == brute_collapse(w)


def test_runs_of_long_text_and_of_every_period():
    block = [f"x{i}" for i in range(5000)]
    assert periodic_runs.collapse([" ".join(block * 3 + block[:7]).encode()])[0][0] == [(0, 15007, 5000)]
    for p in range(1, 40):
        w = [f"v{i % p}" for i in range(max(24, 3 * p))]
        assert periodic_runs.collapse([" ".join(w).encode()])[0][0] == [(0, len(w), p)]
        assert periodic_runs.collapse([" ".join(w[:-1]).encode()])[0][0] == []


def test_runs_query(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " \n".join(planted_words(rng)), "r") for i in range(120)]
    rows += [(500, None, "r"), (501, "", "r"), (502, " \t ", "r"), (None, "a b " * 20, "r"), (503, "é é " * 30, "r"), (503, "é é " * 30, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter()
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        n, h = len(w), -1 if i is None else zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        runs, text = brute_collapse(w)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
        listed = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
        want[(i, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(),
              hashlib.sha256(text.encode()).hexdigest(), n)] += 1
    got = Q.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, got.collect())) == want and any(r[1] for r in want)
    assert periodic_runs.find_runs(df.limit(0)).count() == 0
    clash = periodic_runs.find_runs(df.withColumn("text_bytes", F.lit(1)))
    assert clash.columns == ["doc_id", "text_bytes", "runs", "collapsed", "n_words"]


def brute_repair(rows):
    """Counts, cost, audit and repaired rows of (role, text) in order, by shortest paths over audits."""
    seen, faults = set(), []
    for role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[:1] for r, _ in rows]
    counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
    counts.append(sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])))
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, last, out = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return [*counts, cost, audit], list(out)
        name = {"u": "user", "a": "assistant"}[due[last]]
        heapq.heappush(heap, (cost + 2, audit + "I", i, due[last], (*out, (name, ""))))
        if i < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, out))
            if faults[i] in ("", "truncated"):
                cut, first = faults[i] == "truncated", initials[i]
                heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, due[last], (*out, (name, rows[i][1]))))
                if first == due[last] or first == "s" and last == "":
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, first, (*out, rows[i])))


def random_turns(rng, n):
    roles = rng.choice([["user", "assistant"], ["user", "assistant", "system", "tool", ""], ["assistant"]])
    return [(roles[k % len(roles)] if rng.random() < 0.7 else rng.choice(roles),
             rng.choice(["Fine.", "yes", " ", "", "a.b", f"t{rng.randrange(9)}!", f"t{rng.randrange(99)}", "é?\n "])) for k in range(n)]


def test_repair_of_sequences():
    rng = random.Random(11)
    for _ in range(1500):
        rows = random_turns(rng, rng.randrange(1, 25))
        counts, out = brute_repair(rows)
        seen, kinds = set(), ""
        for role, text in rows:
            bare = re.sub(r"[\x20\x09-\x0D]", "", text)
            k = role[:1] if role[:1] in ("s", "u", "a") else "x"
            kinds += "D" if not bare or (role, text) in seen else k if bare[-1] in ".!?" else k.upper()
            seen.add((role, text))
        table = [turn_repair.PIECE[k] for k in kinds]
        end = turn_repair.last_state(table)
        audit, cost, roles, texts = turn_repair.realised(kinds, [r for r, _ in rows], [t for _, t in rows], 0, end, turn_repair.TRAIL[end])
        assert ([cost, audit], list(zip(roles, texts))) == (counts[4:], out)
        cuts = [0, *sorted(rng.sample(range(1, len(rows)), min(len(rows) - 1, 3))), len(rows)]
        blocks = [turn_repair.composed(table[a:b]) for a, b in zip(cuts, cuts[1:])]
        states = turn_repair.crossings(blocks, 0, turn_repair.last_state(blocks))
        assert states[-1] == end
        parts = [turn_repair.realised(kinds[a:b], [""] * (b - a), [""] * (b - a), s, t, 0)[0] for a, b, s, t in zip(cuts, cuts[1:], states, states[1:])]
        assert "".join(parts) + "I" * turn_repair.TRAIL[end] == audit


def test_repair_query(spark, tmp_path):
    rng = random.Random(12)
    rows = [(c, t, role, text) for c in range(150) for t, (role, text) in enumerate(random_turns(rng, rng.randrange(1, 12))) if rng.random() < 0.9]
    rows += [(900, t, role, text) for t, (role, text) in enumerate(random_turns(rng, 9500))]  # several blocks and tasks
    rows += [(901, None, "user", "No turn."), (901, 3, None, None), (None, 0, "user", "No id."), (None, 1, "assistant", "Right."), (902, 7, "user", None)]
    rows += [(903, 1 + (k > 50), "user", "Same.") for k in range(100)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("copy", F.lit("x"))
    df.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    held = {}
    for c, t, role, text in rows:
        held.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fate, text)
        for _ in range({0: 0, 3: 2}.get(fate, 1)):
            held[c].append((t, "user" if fate == 4 else role, text))
    want = {}
    for c, turns in held.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        counts, out = brute_repair([r[1:] for r in turns])
        want[c] = (gaps, *counts, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())
    got = Q.op12_turn_repair(spark, str(tmp_path)).collect()
    assert list(got[0].asDict()) == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert turn_repair.repair(df.limit(0)).count() == 0


def test_lattice_equals_single_strings(pieces):
    rng = random.Random(2)
    runs = [" " + "".join(rng.choice("etaoin shrdlu日😀éß.0́") for _ in range(rng.randrange(0, 30))) for _ in range(300)] + ["", "\n", " ", "x" * 700]
    trie = lattice.Trie(pieces)
    many = lattice.Lattice(runs, trie)
    weight = many.weights(trie.logp, trie.byte_logp)
    alpha = many.forward(weight)[many.last]
    best, count = many.best(weight)
    at = np.cumsum(count) - count
    for k, run in enumerate(runs):
        assert abs(alpha[k] - lattice_lm.forward(run, pieces)[0][-1]) < 1e-8 if run else alpha[k] == 0
        ids = [i for p in many.piece[best[at[k]:at[k] + count[k]]].tolist()
               for i in ([int(trie.ids[p])] if p < len(trie.ids) else trie.byte_ids[many.bytes_of(p - len(trie.ids))].tolist())]
        assert ids == [i for part in sp_codec.stream_ids(run, pieces) for i in part]


def test_long_strings_go_by_stretches(pieces):
    rng = random.Random(4)
    trie = lattice.Trie(pieces)
    run = "".join(rng.choice("etaoin shrdlu日😀") for _ in range(1000))
    for step in (16, 100, 999, 1000, 5000):
        assert abs(lattice._long_forward(run, trie, trie.logp, trie.byte_logp, step) - lattice_lm.forward(run, pieces)[0][-1]) < 1e-7


def test_lm_document_scores(spark, pieces):
    """Whole texts against the sum over all segmentations of every word."""
    texts = ["The cat", "cat 日x", None, "a", "held out cat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in lattice_lm.score_documents(docs, F.col("doc_id") < 4, pieces).collect()}
    train = [w for t in texts[:4] for w in (t or "").lower().split()]
    n = len(train) + 4
    mass = {i: lattice_lm.PRIOR * np.exp(p) for i, p in pieces.logps().items()}
    for w in train:
        ways = every_segmentation(" " + w, pieces)
        for p, ids in ways:
            for i in ids:
                mass[i] += p / sum(q for q, _ in ways)
    fitted = pieces.reweighted({i: np.log(m / sum(mass.values())) for i, m in mass.items()})
    for k, t in enumerate(texts):
        for by, name in ((pieces, "score"), (fitted, "fitted_score")):
            want = sum(np.log10(sum(p for p, _ in every_segmentation(" " + w, by))) for w in (t or "").lower().split()) + np.log10(4 / n)
            assert abs(getattr(got[k], name) - want) < 1e-6
        assert got[k].train_tokens == n and got[k].n_tokens == len((t or "").split()) + 1
        assert got[k].n_known == 1 + sum(w in train for w in (t or "").lower().split())


def test_codec_long_words_and_equal_runs(spark, pieces):
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abeé日o\n▁") for _ in range(rng.choice([1, 5, 49, 200]))) for _ in range(30)) for _ in range(20)] + [" ", "\n\n", None, ""]
    codec = sp_codec.Codec(pieces)
    for text, ids in zip(texts, codec.encode_all(texts)):
        assert ids.tolist() == ([i for part in sp_codec.stream_ids(" " + text, pieces) for i in part] if text else [])
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    assert all(r.decoded == (r.text or "") for r in sp_codec.decode(sp_codec.encode(df, pieces), pieces).collect())
    assert sp_codec.encode(df.limit(0), pieces).count() == 0


def every_segmentation(run, pieces):
    """(probability, pieces) of all ways to cut a string."""
    if not run:
        return [(1.0, ())]
    return [(np.exp(p) * q, (*ids, *more)) for end, p, ids in pieces.edges(run, 0) for q, more in every_segmentation(run[end:], pieces)]


def test_langid_sums_all_segmentations(spark, pieces):
    texts = [("a", "the cat"), ("a", "The 12 cats!"), ("b", "la tête"), ("b", None), (None, "ignored"), ("c", "...")]
    df = spark.createDataFrame(texts, "lang string, text string")
    model = langid.fit(df, pieces)
    assert model.langs == ["a", "b", "c"]
    mass = {k: {i: langid.PRIOR * np.exp(p) for i, p in pieces.logps().items()} for k in model.langs}
    for k, words in (("a", ["the", "cat", "the", "cats"]), ("b", ["la", "tête"])):
        for w in words:
            ways = every_segmentation(" " + w, pieces)
            for p, ids in ways:
                for i in ids:
                    mass[k][i] += p / sum(q for q, _ in ways)
    total = {k: sum(v.values()) for k, v in mass.items()}
    probe = ["cat", "tête", "日x", "zebra"]
    got = model.word_logps([" " + w for w in probe])
    for j, w in enumerate(probe):
        for n, k in enumerate(model.langs):
            fitted = pieces.reweighted({i: np.log(m / total[k]) for i, m in mass[k].items()})
            assert abs(got[j, n] - np.log(sum(p for p, _ in every_segmentation(" " + w, fitted)))) < 1e-3  # counts are rounded
    langs, score = model.predict(["cat cat", "tête", None, "", " 12 ²! ", "cat tête"])
    assert langs[:5] == ["a", "b", "und", "und", "und"] and list(score[2:5]) == [0, 0, 0] and 0 < score[0] < 1


def test_langid_query(spark, tmp_path, pieces):
    rng = random.Random(8)
    vocab = {k: ["".join(rng.choice(c) for _ in range(rng.randrange(2, 8))) for _ in range(80)] for k, c in (("x", "aeioulmnr"), ("y", "kzwpthsüöy"), ("z", "ежюишпрс"))}
    rows = [(i, None if i % 50 == 0 else " ".join(rng.choice(vocab[k]) for _ in range(rng.randrange(1, 60))), None if i % 31 == 0 else k, "s")
            for i, k in ((i, "xyz"[i % 3]) for i in range(400))]
    rows += [(1000, "long " * 40000 + "text", "x", "s"), (None, "12 34", "x", "s"), (1000, "", "y", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = Q.op13_langid(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = {r[0]: (r[1], "xyz"[r[0] % 3]) for r in rows[:400]}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id in truth:
            text, lang = truth[r.doc_id]
            assert r.lang_pred == (lang if text else "und")
    empty = langid.fit(df.limit(0), pieces)
    assert {r.lang_pred for r in langid.identify(df, empty).collect()} == {"und"}
    assert langid.identify(df.limit(0), empty).count() == 0
    assert langid.identify(df.withColumn("text_read", F.lit(1)), empty).columns == ["doc_id", "lang", "text_read", "lang_pred", "score"]
