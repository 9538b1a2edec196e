"""Context enrichment: score a reference-document catalogue against each
prompt, attach the best document (or a generated context), count outcomes,
and build the exact text sent to a system.

The catalogue is merged (later group wins on an id clash, first position kept).
A small one (``MAX_INLINE_DOCS``) is compiled into one literal expression per
document, so scoring is a narrow per-row projection: no join, no pairs
materialised, nothing shuffled. A larger one is matched through an inverted
index (``match_indexed``): terms and description words meet the texts by their
first characters, and only documents that some term touches are scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS
from .generate import fill

MAX_INLINE_DOCS = 2000  # larger catalogues are matched by the index

# Our catalogue: (group, id, url, description, topics, document_type, industry)
CATALOG = [
    (0, "f1", "https://example.org/filings/annual-2024.pdf", "Annual report with revenue, budget and quarterly results",
     ["quarterly_review", "budget", "revenue"], "annual_report", "finance"),
    (0, "f2", "https://example.org/filings/q3-earnings.pdf", "Quarterly earnings summary for investors",
     ["quarterly review", "earnings"], "annual_report", "finance"),
    (1, "g1", "https://example.org/gov/audit-guide.pdf", "Audit and compliance guidance for public agencies",
     ["compliance_audit", "regulation"], "government_report", "public_sector"),
    (1, "g2", "https://example.org/gov/minutes.pdf", "Labour statistics and meeting minutes archive",
     ["meeting", "statistics"], "government_report", "government"),
    (2, "i1", "https://example.org/intl/trade-data.pdf", "Global trade data tables and economic outlook",
     ["data", "trade"], "economic_report", "economics"),
    (2, "i2", "https://example.org/intl/outlook.pdf", "Economic outlook with budget planning scenarios",
     ["budget_planning", "outlook"], "economic_report", "economics"),
    (3, "n1", "https://example.org/ind/retail-email.pdf", "Retail industry benchmark for email marketing",
     ["email", "marketing"], "industry_report", "retail"),
    (3, "n2", "https://example.org/ind/vendor-survey.pdf", "Healthcare vendor evaluation survey",
     ["vendor_evaluation", "vendor"], "industry_report", "healthcare"),
    (3, "n3", "https://example.org/ind/client-prep.pdf", "Banking client meeting preparation checklist",
     ["client_meeting", "checklist"], "industry_report", "banking"),
    (3, "n4", "https://example.org/ind/retail-email-copy.pdf", "Retail industry benchmark for email marketing",
     ["email", "marketing"], "industry_report", "retail"),
    (4, "a1", "https://example.org/acad/summarization.pdf", "Research paper on document summarization methods",
     ["document", "summarization"], "academic_paper", "research"),
    (4, "a2", "https://example.org/acad/teams.pdf", "Study of team collaboration in remote work",
     ["team_collaboration", "remote"], "academic_paper", "research"),
    (4, "g2", "https://example.org/acad/meeting-study.pdf", "Study of meeting statistics in large firms",
     ["meeting", "statistics"], "academic_paper", "research"),
]

# FIXED VALUES: score weights and boosts of the document matcher
TOPIC_HIT, TOPIC_WORD, INDUSTRY_HIT, DESC_WORD, MIN_SCORE = 15, 5, 20, 3, 15
ACTION_BOOSTS = [
    (["SUMMARIZE", "ANALYZE", "REVIEW", "EXPLAIN"],
     ["annual_report", "industry_report", "economic_report", "government_report"], 20),
    (["GET", "FIND", "SEARCH", "RESEARCH"], ["academic_paper", "industry_report", "government_report"], 15),
    (["COMPARE", "EVALUATE", "ASSESS"], ["industry_report", "annual_report"], 15),
]
SCENARIO_BOOSTS = [
    (["budget", "financial"], ["annual_report", "economic_report"], 10),
    (["compliance", "audit"], ["government_report", "annual_report"], 10),
    (["client"], ["industry_report", "annual_report"], 10),
]
CONTEXT_REQUIRED = ["SUMMARIZE", "EXPLAIN", "REVIEW", "ANALYZE", "ASSESS", "EVALUATE",
                    "PROOFREAD", "EDIT", "TRANSLATE", "REWRITE", "CRITIQUE", "DIGEST"]
CONTEXT_HELPFUL = ["CREATE", "WRITE", "DRAFT", "PREPARE", "COMPOSE", "GENERATE",
                   "SUGGEST", "RECOMMEND", "ADVISE", "HELP", "GUIDE",
                   "FIND", "GET", "SEARCH", "LOOK", "LOCATE",
                   "COMPARE", "CONTRAST", "DIFFERENTIATE",
                   "PLAN", "ORGANIZE", "SCHEDULE", "PRIORITIZE"]
EXISTING_MIN = 500

# FIXED VALUES: generated context kind by action group (the bodies below are ours)
GENERATED_KINDS = [
    (["SUMMARIZE", "REVIEW", "ANALYZE"], "analysis"),
    (["EXPLAIN", "DESCRIBE"], "explainer"),
    (["CREATE", "WRITE", "DRAFT"], "reference"),
    (["FIND", "GET", "SEARCH"], "data"),
    (["SUGGEST", "RECOMMEND", "ADVISE"], "situation"),
    (["PREPARE", "ORGANIZE", "PLAN"], "planning"),
    (["COMPARE", "EVALUATE", "ASSESS"], "analysis"),
]
GENERATED_DEFAULT = "business"
GENERATED_BODIES = {
    "analysis": "Working notes on {obj} for {scenario}: three findings, two open risks, one owner: {company}.",
    "explainer": "Background on {obj}: what it is, why {company} uses it, and common questions.",
    "reference": "Reference material for {obj}: past examples from {company}, tone guide and must-have points.",
    "data": "Records about {obj} from {company}: 12 entries, last updated this week, two duplicates.",
    "situation": "Situation for {scenario}: {company} has limited time and budget; {obj} needs a decision.",
    "planning": "Planning notes for {obj}: milestones, owners at {company}, dependencies and dates.",
    "business": "Business context for {obj} at {company} during {scenario}.",
}
COMPANIES = ["Northwind", "Contoso Labs", "Globex", "Initech", "Umbrella Works"]
REFERENCE_TEMPLATE = "[{doc_type}, {industry}] {description}\nSource: {url}\n\nTreat this source as background."


def catalog_frame(spark: SparkSession, rows=CATALOG) -> DataFrame:
    return spark.createDataFrame(
        [(g, i, k, u, d, t, dt, ind) for i, (g, k, u, d, t, dt, ind) in enumerate(rows)],
        "grp int, pos int, doc_id string, url string, description string, topics array<string>, "
        "document_type string, industry string")


def merge_catalogs(cat: DataFrame) -> DataFrame:
    """Union of catalogue groups: on an id clash the later group's entry wins
    and keeps the first entry's position (dict-update order)."""
    return (cat.groupBy("doc_id")
               .agg(F.min("pos").alias("ord"),
                    F.max_by(F.struct("url", "description", "topics", "document_type", "industry"), "grp").alias("d"))
               .select("ord", "doc_id", "d.*"))


def load_catalog(merged: DataFrame) -> list[dict] | DataFrame:
    """A small catalogue as rows on the driver, after checking its size; a larger one as it is."""
    if merged.limit(MAX_INLINE_DOCS + 1).count() > MAX_INLINE_DOCS:
        return merged
    return [r.asDict() for r in merged.orderBy("ord").collect()]


def doc_score(h: Column, words: Column, action: Column, scenario: Column, d: dict) -> Column:
    score = F.lit(0)
    for t in d["topics"] or []:
        tl = t.lower().replace("_", " ")
        score = score + F.when(h.contains(tl), F.lit(TOPIC_HIT)).otherwise(F.lit(0))
        for w in tl.split():
            if len(w) > 3:
                score = score + F.when(h.contains(w), F.lit(TOPIC_WORD)).otherwise(F.lit(0))
    ind = (d["industry"] or "").lower()
    if ind:
        score = score + F.when(h.contains(ind), F.lit(INDUSTRY_HIT)).otherwise(F.lit(0))
    desc = (d["description"] or "").lower()
    score = score + F.size(F.filter(words, lambda w: (F.length(w) > 4) & F.lit(desc).contains(w))) * DESC_WORD
    ua, sl = F.upper(action), F.lower(F.coalesce(scenario, F.lit("")))
    for acts, types, pts in ACTION_BOOSTS:
        if d["document_type"] in types:
            score = score + F.when(ua.isin(*acts), F.lit(pts)).otherwise(F.lit(0))
    for kws, types, pts in SCENARIO_BOOSTS:
        if d["document_type"] in types:
            hit = F.lit(False)
            for k in kws:
                hit = hit | sl.contains(k)
            score = score + F.when(hit, F.lit(pts)).otherwise(F.lit(0))
    return score


def match_documents(df: DataFrame, docs: list[dict] | DataFrame, *, action="action", obj="object", scenario="scenario",
                    prompt="synthetic_prompt") -> DataFrame:
    """Best document per row: highest score, first catalogue entry on ties,
    kept only when the score reaches MIN_SCORE. Adds doc_id, doc_url,
    doc_score (null when nothing qualifies)."""
    h = F.lower(F.concat_ws(" ", F.col(action), F.col(obj), F.col(scenario), F.col(prompt)))
    if isinstance(docs, DataFrame):
        return match_indexed(df, docs, h, F.col(action), F.col(scenario))
    df = df.withColumn("_h", h).withColumn("_w", F.filter(F.split(F.col("_h"), WS), lambda w: w != ""))
    cands = [F.struct(doc_score(F.col("_h"), F.col("_w"), F.col(action), F.col(scenario), d).alias("score"),
                      F.lit(-i).alias("neg_ord"), F.lit(d["doc_id"]).alias("doc_id"), F.lit(d["url"]).alias("url"),
                      F.lit(d["description"]).alias("description"), F.lit(d["document_type"]).alias("document_type"),
                      F.lit(d["industry"]).alias("industry"))
             for i, d in enumerate(docs)]
    best = F.array_max(F.array(*cands))
    df = df.withColumn("_best", best).drop("_h", "_w")
    ok = F.col("_best.score") >= MIN_SCORE
    return df.withColumns({
        "doc_id": F.when(ok, F.col("_best.doc_id")),
        "doc_url": F.when(ok, F.col("_best.url")),
        "doc_score": F.when(ok, F.col("_best.score").cast("bigint")),
        "_doc": F.when(ok, F.col("_best")),
    }).drop("_best")


HEAD, WORD_HEAD = 4, 5  # characters by which terms and description words are looked up


def _grams(text: Column, n: int) -> Column:
    """Distinct stretches of ``n`` characters."""
    spots = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(spots, lambda i: F.substring(text, i, F.lit(n))))


def catalog_terms(docs: DataFrame) -> DataFrame:
    """Postings (term, ord, points): topics, their longer words and the industry."""
    topics = F.transform(F.coalesce("topics", F.array().cast("array<string>")), lambda t: F.lower(F.replace(t, F.lit("_"), F.lit(" "))))
    point = lambda term, n: F.struct(term.alias("term"), F.lit(n).alias("points"))
    found = F.concat(F.transform(topics, lambda t: point(t, TOPIC_HIT)),
                     F.flatten(F.transform(topics, lambda t: F.transform(F.filter(F.split(t, WS), lambda w: F.length(w) > 3), lambda w: point(w, TOPIC_WORD)))),
                     F.array(point(F.lower(F.coalesce("industry", F.lit(""))), INDUSTRY_HIT)))
    rows = docs.select("ord", F.explode(found).alias("x")).select("ord", "x.term", "x.points")
    return rows.where("term <> ''").groupBy("term", "ord").agg(F.sum("points").alias("points"))


def match_indexed(df: DataFrame, merged: DataFrame, h: Column, action: Column, scenario: Column) -> DataFrame:
    """``match_documents`` for catalogues of any size.

    A document scores above its untouched score only through a term in the text or a
    word of the text in its description, so the inverted index names every document
    that can. Untouched, documents of one type score alike (their type's boosts and
    what empty topics give), so the best of each type stands for all of them: that is
    the bound on what the index leaves out. The candidates are scored exactly."""
    rows = df.withColumns({"_h": h, "_a": F.upper(action), "_s": F.lower(F.coalesce(scenario, F.lit("")))})
    rows = rows.withColumn("_k", F.md5(F.to_json(F.struct("_h", "_a", "_s"))))
    texts = rows.select("_k", "_h", "_a", "_s").dropDuplicates(["_k"])
    docs = merged.select("*", F.lower(F.coalesce("description", F.lit(""))).alias("_desc"), (TOPIC_HIT * F.size(F.filter(
        F.coalesce("topics", F.array().cast("array<string>")), lambda t: t == ""))).alias("_base"))
    # terms in the texts, by their first characters
    postings = catalog_terms(docs)
    terms = postings.select("term").distinct().withColumn("head", F.left("term", F.lit(HEAD)))
    sizes = sorted(r[0] for r in terms.select(F.length("head")).distinct().collect())  # at most HEAD numbers
    heads = F.flatten(F.array(*[_grams(F.col("_h"), n) for n in sizes])) if sizes else F.array().cast("array<string>")
    met = texts.select("_k", F.explode(heads).alias("head")).join(terms, "head").select("_k", "term")
    by_term = (met.join(texts.select("_k", "_h"), "_k").where(F.contains("_h", "term")).join(postings, "term")
                  .select("_k", "ord", "points"))
    # words of the texts in descriptions
    words = (texts.select("_k", F.explode(F.filter(F.split("_h", WS), lambda w: F.length(w) >= WORD_HEAD)).alias("word"))
                  .groupBy("_k", "word").agg(F.count("*").alias("n")))
    parts = docs.select("ord", F.explode(_grams(F.col("_desc"), WORD_HEAD)).alias("head"))
    hits = (words.select("word").distinct().withColumn("head", F.left("word", F.lit(WORD_HEAD))).join(parts, "head")
                 .join(docs.select("ord", "_desc"), "ord").where(F.contains("_desc", "word")).select("word", "ord"))
    by_word = words.join(hits, "word").select("_k", "ord", (F.col("n") * DESC_WORD).alias("points"))
    # the best untouched document of each type that some boost names, and of all others
    named = sorted({t for _, types, _ in ACTION_BOOSTS + SCENARIO_BOOSTS for t in types})
    kind = F.when(F.col("document_type").isin(named), F.col("document_type")).otherwise("")
    best = [r["ord"] for r in docs.groupBy(kind.alias("kind")).agg(F.max(F.struct("_base", -F.col("ord"))).alias("b"))
            .select((-F.col("b.col2")).alias("ord")).collect()]  # at most one per type named
    rest = texts.select("_k", F.explode(F.array(*[F.lit(o) for o in best]) if best else F.array().cast("array<int>")).alias("ord"), F.lit(0).alias("points"))
    touched = by_term.unionByName(by_word).unionByName(rest).groupBy("_k", "ord").agg(F.sum("points").alias("points"))
    boost = F.lit(0)
    for acts, types, points in ACTION_BOOSTS:
        boost = boost + F.when(F.col("document_type").isin(types) & F.col("_a").isin(acts), points).otherwise(0)
    for kws, types, points in SCENARIO_BOOSTS:
        said = F.lit(False)
        for k in kws:
            said = said | F.col("_s").contains(k)
        boost = boost + F.when(F.col("document_type").isin(types) & said, points).otherwise(0)
    scored = touched.join(docs.select("ord", "_base", "document_type"), "ord").join(texts.select("_k", "_a", "_s"), "_k")
    won = (scored.groupBy("_k").agg(F.max(F.struct((F.col("points") + F.col("_base") + boost).alias("score"), (-F.col("ord")).alias("neg_ord"))).alias("_w"))
                 .where(F.col("_w.score") >= MIN_SCORE).select("_k", F.col("_w.score").alias("score"), (-F.col("_w.neg_ord")).alias("ord")))
    named_best = won.join(merged, "ord").select("_k", F.struct("score", (-F.col("ord")).alias("neg_ord"), "doc_id", "url", "description",
                                                               "document_type", "industry").alias("_doc"))
    return (rows.join(named_best, "_k", "left").drop("_h", "_a", "_s", "_k")
                .withColumns({"doc_id": F.col("_doc.doc_id"), "doc_url": F.col("_doc.url"), "doc_score": F.col("_doc.score").cast("bigint")}))


def _title(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def enrich(df: DataFrame, docs: list[dict] | DataFrame, *, key: str = "synthetic_prompt_id") -> DataFrame:
    """Fallback chain: existing long context kept -> public document ->
    generated context -> none required. Adds context_url,
    context_source_type, context_text, has_context_text."""
    ua = F.upper(F.col("action"))
    m = match_documents(df, docs)
    existing = F.length(F.coalesce(F.col("context_text"), F.lit(""))) > EXISTING_MIN
    wants = ua.isin(*CONTEXT_REQUIRED) | ua.isin(*CONTEXT_HELPFUL)
    ref = fill(F.lit(REFERENCE_TEMPLATE), {
        "description": F.col("_doc.description"), "doc_type": _title(F.col("_doc.document_type")),
        "industry": F.initcap(F.col("_doc.industry")), "url": F.col("_doc.url")})
    kind = None
    for acts, k in GENERATED_KINDS:
        kind = F.when(ua.isin(*acts), F.lit(k)) if kind is None else kind.when(ua.isin(*acts), F.lit(k))
    kind = kind.otherwise(F.lit(GENERATED_DEFAULT))
    bodies = F.create_map(*[x for k, v in GENERATED_BODIES.items() for x in (F.lit(k), F.lit(v))])
    seed = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key), F.left(F.col("synthetic_prompt"), F.lit(50)))), 1, 8), 16, 10).cast("bigint")
    company = F.element_at(F.array(*[F.lit(c) for c in COMPANIES]), (F.pmod(seed, F.lit(len(COMPANIES))) + 1).cast("int"))
    gen = fill(F.element_at(bodies, kind), {"obj": F.lower(F.col("object")), "scenario": F.replace(F.col("scenario"), F.lit("_"), F.lit(" ")),
                                            "company": company})
    src = (F.when(existing, F.lit("existing_synthetic")).when(wants & F.col("_doc").isNotNull(), F.lit("public_document"))
            .when(wants, F.lit("generated_synthetic")).otherwise(F.lit("none_required")))
    m = m.withColumn("context_source_type", src)
    t = F.col("context_source_type")
    return m.withColumns({
        "context_url": F.when(t == "public_document", F.col("_doc.url")).otherwise(F.lit("")),
        "context_text": F.when(t == "public_document", ref).when(t == "generated_synthetic", gen).otherwise(F.col("context_text")),
        "has_context_text": F.when(t.isin("public_document", "generated_synthetic"), F.lit("Yes"))
                             .when(t == "none_required",
                                   F.when(F.coalesce(F.col("has_context_text"), F.lit("")) == "", F.lit("No"))
                                    .otherwise(F.col("has_context_text")))
                             .otherwise(F.col("has_context_text")),
    }).drop("_doc")


def context_stats(enriched: DataFrame) -> DataFrame:
    """Outcome counters plus total, as (metric, value)."""
    by = enriched.groupBy("context_source_type").agg(F.count(F.lit(1)).cast("bigint").alias("value"))
    tot = enriched.agg(F.count(F.lit(1)).cast("bigint").alias("value")).select(F.lit("total_processed").alias("metric"), "value")
    return by.select(F.col("context_source_type").alias("metric"), "value").unionByName(tot)


def build_prompt(df: DataFrame, *, prompt="synthetic_prompt", url="context_url", text="context_text") -> DataFrame:
    """The four assembly variants of the text sent to a system (the same text
    goes to every system): agent, api, audit (with length), copy."""
    p = F.col(prompt)
    u = F.coalesce(F.col(url), F.lit(""))
    t = F.coalesce(F.col(text), F.lit(""))
    nl = "\n"
    # agent: url reference or text; long context first, short one after
    actx = F.when(u != "", F.concat(F.lit("Reference document: "), u)).otherwise(t)
    agent = (F.when(F.length(actx) > 100, F.concat(F.lit(f"Context/Reference Document:{nl}"), F.left(actx, F.lit(4000)),
                                                   F.lit(f"{nl}{nl}---{nl}{nl}User Request:{nl}"), p))
              .when(actx != "", F.concat(p, F.lit(f"{nl}{nl}Reference: "), actx)).otherwise(p))
    api_ctx = F.when(u != "", F.concat(F.lit("Reference document: "), u)).otherwise(F.left(t, F.lit(2000)))
    api = F.when(api_ctx != "", F.concat(api_ctx, F.lit(nl + nl), p)).otherwise(p)
    audit_ctx = (F.when(u != "", F.concat(F.lit("Reference: "), u))
                  .when(F.length(t) > 50, F.left(t, F.lit(1500))).otherwise(F.lit("")))
    audit = F.left(F.when(audit_ctx != "", F.concat(F.lit("Context: "), audit_ctx, F.lit(f"{nl}{nl}---{nl}{nl}"), p)).otherwise(p),
                   F.lit(2000))
    copy_ = (F.when(u != "", F.concat(F.lit("Reference Document: "), u, F.lit(nl + nl), p))
              .when(t != "", F.concat(F.lit(f"Context:{nl}"), F.left(t, F.lit(2000)), F.lit(f"{nl}{nl}---{nl}{nl}User Request:{nl}"), p))
              .otherwise(p))
    return df.withColumns({"prompt_agent": agent, "prompt_typed": F.left(agent, F.lit(2000)), "prompt_api": api,
                           "prompt_sent": audit, "prompt_copy": copy_}) \
             .withColumn("prompt_length", F.length("prompt_sent").cast("bigint"))
