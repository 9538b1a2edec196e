"""Catalogue matching by the inverted index equals the compiled matcher, at any size."""

import random

from quillspark.operators import context as C

SCHEMA = "action string, object string, scenario string, synthetic_prompt string"
WORDS = ["budget", "revenue", "audit", "meeting", "plan", "report", "client", "quarterly", "it", "hr", "statistics", "market", "x", "earnings", "finance"]


def prompts(spark, rng, n):
    rows = [(rng.choice(["SUMMARIZE", "create", "Find", None]), rng.choice(["EMAIL", "report", ""]), rng.choice(["budget planning", "client call", "audit", None]),
             " ".join(rng.choice(WORDS) + rng.choice(["", "s", ","]) for _ in range(rng.randrange(0, 12)))) for _ in range(n)]
    return spark.createDataFrame(rows + rows[:5], SCHEMA)


def catalogue(rng, n, rare=False):
    types = ["annual_report", "government_report", "industry_report", "economic_report", "other", None]
    word = lambda: rng.choice(WORDS) + (str(rng.randrange(4000)) if rare and rng.random() < 0.97 else "")
    return [(0, f"d{i}", f"u{i}", rng.choice([None, "", " ".join(word() for _ in range(6))]),
             rng.choice([None, [], [word(), f"{word()}_{word()}"], [""], ["it"]]), rng.choice(types), rng.choice(["", None, word()])) for i in range(n)]


def picked(df):
    return sorted(((r.action, r.object, r.scenario, r.synthetic_prompt), r.doc_id, r.doc_url, r.doc_score) for r in df.collect())


def key(rows):
    return sorted(rows, key=str)


def test_index_equals_expression(spark, monkeypatch):
    for seed, n in ((1, 1), (2, 12), (3, 120)):
        rng = random.Random(seed)
        df, merged = prompts(spark, rng, 40), C.merge_catalogs(C.catalog_frame(spark, catalogue(rng, n)))
        inline = C.load_catalog(merged)
        assert isinstance(inline, list)
        want = [(tuple(r)[:4], r.doc_id, r.doc_url, r.doc_score) for r in C.match_documents(df, inline).collect()]
        got = [(tuple(r)[:4], r.doc_id, r.doc_url, r.doc_score) for r in C.match_documents(df, merged).collect()]
        assert key(got) == key(want) and len(got) == 45
    monkeypatch.setattr(C, "MAX_INLINE_DOCS", 50)
    assert not isinstance(C.load_catalog(merged), list)


def brute(row, docs):
    """The scoring rule, document by document."""
    action, obj, scenario, prompt = row
    h = " ".join(x for x in (action, obj, scenario, prompt) if x is not None).lower()
    best = None
    for ord_, (_, doc, url, desc, topics, kind, industry) in enumerate(docs):
        score = 0
        for t in topics or []:
            tl = t.lower().replace("_", " ")
            score += C.TOPIC_HIT * (tl in h) + C.TOPIC_WORD * sum(w in h for w in tl.split() if len(w) > 3)
        score += C.INDUSTRY_HIT * bool(industry and industry.lower() in h)
        score += C.DESC_WORD * sum(len(w) > 4 and w in (desc or "").lower() for w in h.split())
        score += sum(p for acts, types, p in C.ACTION_BOOSTS if kind in types and (action or "").upper() in acts)
        score += sum(p for kws, types, p in C.SCENARIO_BOOSTS if kind in types and any(k in (scenario or "").lower() for k in kws))
        if best is None or score > best[0]:
            best = (score, doc, url)
    return (best[1], best[2], best[0]) if best[0] >= C.MIN_SCORE else (None, None, None)


def test_twenty_thousand_entries(spark):
    rng = random.Random(9)
    docs = catalogue(rng, 20_000, rare=True)
    df = prompts(spark, rng, 25)
    merged = C.load_catalog(C.merge_catalogs(C.catalog_frame(spark, docs)))
    out = C.match_documents(df, merged)
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert len(got) == 30
    for r in got:
        assert (r.doc_id, r.doc_url, r.doc_score) == brute(tuple(r)[:4], docs)
