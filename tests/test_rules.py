"""Hand-made edge frames for the exact rules (expected values worked out by
hand from the rule text)."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillspark import vocab as V
from quillspark.functions.text import norm_key
from quillspark.operators import collect as CO
from quillspark.operators import context as C
from quillspark.operators import evaluate as E
from quillspark.operators import generate as G
from quillspark.operators import harvest as HV
from quillspark.operators import label as L
from quillspark.operators import polls as PO

RAW = "source string, source_ord int, seq long, text string, language string"


def test_whitespace_key(spark):
    texts = ["Hello\tWorld", "hello\x0bworld", "hello\xa0world", " hello world ", "　HELLO   world\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    keys = {r.k for r in df.select(norm_key("t").alias("k")).collect()}
    assert keys == {hashlib.md5(b"hello world").hexdigest()[:12]}


def test_shadowing_same_source(spark):
    a = "x" + " " * 5000 + "abcdefghijklmnop"
    b = "x abcdefghijklmnop"
    raw = spark.createDataFrame([("s1", 1, 1, a, None), ("s1", 1, 2, b, None)], RAW)
    assert HV.harvest_prompts(raw).count() == 0  # the too-long first copy shadows b


def test_shadowing_other_source(spark):
    a = "x" + " " * 5000 + "abcdefghijklmnop"
    b = "x abcdefghijklmnop"
    raw = spark.createDataFrame([("s1", 1, 1, a, None), ("s2", 2, 2, b, None)], RAW)
    got = [r.seq for r in HV.harvest_prompts(raw).collect()]
    assert got == [2]


def test_first_n_after_dedup_and_short(spark):
    rows = [("s1", 1, 1, "short", None), ("s1", 1, 2, "the first long prompt", None),
            ("s1", 1, 3, "the first long prompt", None), ("s1", 1, 4, "second long enough prompt", None),
            ("s1", 1, 5, "third long enough prompt", None)]
    raw = spark.createDataFrame(rows, RAW)
    got = sorted(r.seq for r in HV.harvest_prompts(raw, per_source_limit=2).collect())
    assert got == [2, 4]


def test_keep_first_across_sources(spark):
    rows = [("s2", 2, 1, "The same prompt text!", None), ("s1", 1, 9, "the  same prompt TEXT!", None)]
    got = [(r.source, r.seq) for r in HV.harvest_prompts(spark.createDataFrame(rows, RAW)).collect()]
    assert got == [("s1", 9)]


@pytest.mark.parametrize("text,score,level,reasons", [
    ("a" * 29, 1, "Simple", "Very short prompt"),
    ("a" * 30, 2, "Medium", "Default"),
    ("a" * 200, 2, "Medium", "Default"),
    ("a" * 201, 3, "Complex", "Substantial prompt length"),
    ("a" * 501, 4, "Advanced", "Long detailed prompt"),
    ("a? b? c? " + "z" * 30, 3, "Complex", "Multiple questions (3)"),
    ("a? b? " + "z" * 30, 2, "Medium", "Default"),
    ("function " + "z" * 192, 4, "Advanced", "Substantial prompt length; Complex code context"),
    ("function " + "z" * 191, 2, "Medium", "Default"),
    ("first then next after finally " + "q" * 480, 5, "Expert", "Long detailed prompt; Multi-step task (5 indicators)"),
])
def test_difficulty_full(spark, text, score, level, reasons):
    df = L.with_lower(spark.createDataFrame([(text,)], "prompt_text string"))
    r = L.label_difficulty(df).first()
    assert (r.difficulty_score, r.difficulty_level, r.difficulty_reasons) == (score, level, reasons)


@pytest.mark.parametrize("text,vocab,label,conf", [
    ("abcd", [("A", ["ab", "cd"], "a"), ("B", ["abcd"], "b")], "A", 0.4),     # more hits win
    ("xy zw", [("A", ["xy"], "a"), ("B", ["zw"], "b")], "A", 0.2),            # full tie: first
    ("xyz zw", [("A", ["zw"], "a"), ("B", ["xyz"], "b")], "B", 0.2),          # count tie: longer hits
    ("this", [("A", ["hi"], "a")], "A", 0.2),                                 # substring hit
    ("nothing", [("A", ["zz"], "a")], "General/Uncategorized", 0.3),          # no hit
    ("a b c d e f", [("A", list("abcdef"), "a")], "A", 1.0),                  # six hits cap at 1
])
def test_intent(spark, text, vocab, label, conf):
    df = L.with_lower(spark.createDataFrame([(text,)], "prompt_text string"))
    r = L.label_intent(df, vocab).first()
    assert (r.primary_intent, r.intent_confidence) == (label, conf)


@pytest.mark.parametrize("text,lang", [("中文", "zh"), ("ひらがな", "ja"), ("漢字とかな", "zh"), ("한국어", "ko"),
                                       ("مرحبا", "ar"), ("привет", "ru"), ("für", "fr"), ("schön", "de"),
                                       ("mañana", "es"), ("café", "fr"), ("plain", "en")])
def test_language(spark, text, lang):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(L.language_expr("t").alias("l")).first().l == lang


@pytest.mark.parametrize("obj,subj,has", [("EMAIL", "email", False), ("EMAIL", "email thread", False),
                                          ("Email thread", "EMAIL", False), ("EMAIL", "", False),
                                          ("EMAIL", "Budget", True), ("EMAIL", "N/A", False)])
def test_subject_redundancy(spark, obj, subj, has):
    df = spark.createDataFrame([(1, "FIND", obj, subj, "")], "intent_id long, action string, object string, subject string, output string")
    assert G.generation_base(df).first().has_s is has


@pytest.mark.parametrize("ctx,expect_ctx", [("c" * 50, False), ("c" * 51, True)])
def test_audit_prompt_threshold(spark, ctx, expect_ctx):
    df = spark.createDataFrame([("Do it", "", ctx)], "synthetic_prompt string, context_url string, context_text string")
    r = C.build_prompt(df).first()
    assert r.prompt_sent.startswith("Context: ") is expect_ctx


def test_audit_prompt_cut(spark):
    df = spark.createDataFrame([("P" * 900, "", "c" * 3000)], "synthetic_prompt string, context_url string, context_text string")
    r = C.build_prompt(df).first()
    assert r.prompt_length == 2000 and r.prompt_sent.endswith("P")


def test_document_threshold(spark):
    docs = [dict(doc_id="d15", url="u", description="", topics=["ab c"], document_type="x", industry=""),
            dict(doc_id="d12", url="u2", description="bravo charlie delta echo", topics=[], document_type="x", industry="")]
    df = spark.createDataFrame([("GET", "thing", "", "ab c"), ("GET", "thing", "", "bravo charlie delta echo")],
                               "action string, object string, scenario string, synthetic_prompt string")
    got = [r.doc_id for r in C.match_documents(df, docs).collect()]
    assert got == ["d15", None]  # 15 reaches the bar; 4 x 3 = 12 does not


def test_document_tie_first_wins(spark):
    docs = [dict(doc_id="a", url="u", description="", topics=["budget"], document_type="x", industry=""),
            dict(doc_id="b", url="u", description="", topics=["budget"], document_type="x", industry="")]
    df = spark.createDataFrame([("GET", "o", "", "budget")], "action string, object string, scenario string, synthetic_prompt string")
    assert C.match_documents(df, docs).first().doc_id == "a"


POLLS = "cell long, ts timestamp, seq long, text string"


def _polls(spark, rows):
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(c, base + dt.timedelta(seconds=s), i, t) for i, (c, s, t) in enumerate(rows)], POLLS)


def test_quiescence_exact_gap(spark):
    a = "A" * 30
    r = PO.quiescence(_polls(spark, [(1, 0, a), (1, 8, a)]), gap_s=8, timeout_s=120).first()
    assert (r.status, r.latency_s) == ("complete", 0.0)


def test_quiescence_marker_resets(spark):
    a = "A" * 30
    rows = [(1, 0, a), (1, 3, "Thinking"), (1, 6, a), (1, 13, a), (1, 15, a)]
    r = PO.quiescence(_polls(spark, rows), gap_s=8, timeout_s=120).first()
    assert (r.status, r.latency_s, r.response) == ("complete", 6.0, a)


def test_quiescence_short_ignored_and_timeout(spark):
    a, b = "A" * 30, "B" * 30
    r = PO.quiescence(_polls(spark, [(1, 0, "tiny"), (1, 1, a), (1, 2, b)]), gap_s=8, timeout_s=120).first()
    assert (r.status, r.response, r.latency_s) == ("partial", b, 120.0)
    r = PO.quiescence(_polls(spark, [(1, 0, a), (1, 1, "Generating")]), gap_s=8, timeout_s=120).first()
    assert (r.status, r.latency_s) == ("error", 0.0)


def test_stable_polls(spark):
    a = "A" * 30
    rows = [(1, 0, a), (1, 2, a), (1, 4, a), (1, 6, a)]
    r = PO.stable_polls(_polls(spark, rows)).first()
    assert (r.status, r.done_seq) == ("complete", 3)
    r = PO.stable_polls(_polls(spark, rows[:3])).first()
    assert r.status == "timeout"


@pytest.mark.parametrize("content,n", [
    ('[{"prompt":"a"}]', 1),
    ('Sure [{"prompt":"a"},{"prompt":"b"}] ok', 2),
    ('```json\n[{"prompt":"a"}]\n```', 1),
    ('x [{"prompt":"a"}] y ]', 0),          # greedy span fails and there is no fence
    ('[]', 0),
    ('no json', 0),
])
def test_json_recovery(spark, content, n):
    df = spark.createDataFrame([(1, content)], "intent_id long, content string")
    items = df.select(F.size(F.coalesce(CO.parse_items(F.col("content")), F.array())).alias("n")).first().n
    assert items == n


def test_extract_answer(spark):
    body = "Copilot said old You said hi Copilot said  new answer Smart stuff Today"
    df = spark.createDataFrame([(body,)], "b string")
    assert df.select(CO.extract_answer(F.col("b")).alias("a")).first().a == "new answer"


def test_kappa_perfect_and_excluded(spark):
    rows = []
    for s, cat in [(1, 1), (2, 3), (3, 5)]:
        rows += [(s, "x", r, "c", cat) for r in (1, 2, 3)]
    rows += [(4, "x", r, "c", 2) for r in (1, 2)]   # two raters only: excluded
    df = spark.createDataFrame(rows, "prompt_id long, system string, rater long, criterion string, rating int")
    r = E.fleiss_kappa(df).first()
    assert (r.subjects, r.kappa) == (3, 1.0)


def test_kappa_fractional(spark):
    # subjects x 3 raters: (1,1,2), (2,2,2): P1 = 1/3, P2 = 1; P = 2/3;
    # p1 = 2/6, p2 = 4/6, Pe = 5/9; kappa = (2/3 - 5/9) / (4/9) = 0.25
    rows = [(1, "x", 1, "c", 1), (1, "x", 2, "c", 1), (1, "x", 3, "c", 2),
            (2, "x", 1, "c", 2), (2, "x", 2, "c", 2), (2, "x", 3, "c", 2)]
    df = spark.createDataFrame(rows, "prompt_id long, system string, rater long, criterion string, rating int")
    assert E.fleiss_kappa(df).first().kappa == pytest.approx(0.25)


def test_winner_tie_has_no_winner(spark):
    sc = spark.createDataFrame([(1, "a", 3.0), (1, "b", 3.0), (2, "a", 4.0), (2, "b", 3.5), (3, "a", 2.0)],
                               "prompt_id long, system string, score double")
    w = {r.prompt_id: (r.judged, r.winner) for r in E.winners(sc).collect()}
    assert w == {1: (True, None), 2: (True, "a"), 3: (False, None)}


def test_retry_queue(spark):
    rows = [(1, "a", 1, "r", True, 1.0), (1, "a", 2, "r", False, 1.0), (2, "a", 1, "r", True, 1.0),
            (3, "a", 4, "r", True, 1.0)]
    df = spark.createDataFrame(rows, "prompt_id long, system string, attempt long, response string, blocked boolean, latency_s double")
    got = [(r.prompt_id, r.next_attempt) for r in CO.retry_queue(df).collect()]
    assert got == [(2, 2)]


def test_vocab_is_data(spark):
    df = L.with_lower(spark.createDataFrame([("ich will pizza",)], "prompt_text string"))
    r = L.label_intent(df, [("Food", ["pizza"], "f")]).first()
    assert r.primary_intent == "Food" and V.INTENT_FULL[0][0] == "Coding & Development"
