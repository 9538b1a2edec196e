"""Per-row labelling operators (intent, difficulty, products, capabilities,
expected response, language). Every label is a native column expression built
from a vocabulary, so labelling is a narrow projection: no join, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.text import KeywordFlags, any_contains, char_count, col_, count_contains, has, matched_length

LOWER = "_text_lower"


def with_lower(df: DataFrame, text: str = "prompt_text") -> DataFrame:
    """Lower-case the text once; every keyword test reads this column."""
    return df.withColumn(LOWER, F.lower(F.col(text)))


def vocabulary_keywords(*vocabs) -> list[str]:
    """All keywords of the given vocabularies (label lists, flag lists or a
    difficulty spec), in first-seen order."""
    out = []
    for v in vocabs:
        if isinstance(v, dict):
            for _, kws, _ in v["terms"]:
                out += kws
            if v.get("code"):
                out += v["code"][1]
        else:
            for entry in v:
                out += entry[1]
    return list(dict.fromkeys(out))


def with_keyword_flags(df: DataFrame, keywords, lower: str = LOWER) -> tuple[DataFrame, KeywordFlags]:
    kw = KeywordFlags(lower, keywords)
    return kw.add_to(df), kw


# -- intent ------------------------------------------------------------------

def intent_struct(lower, vocabulary) -> Column:
    """Best label by (distinct hits, total hit length), first label on ties.
    Returns struct(n, len, neg_ord, label, sub); n = 0 when nothing matched."""
    cands = []
    for i, (label, kws, sub) in enumerate(vocabulary):
        cands.append(F.struct(count_contains(lower, kws).alias("n"),
                              matched_length(lower, kws).alias("len"),
                              F.lit(-i).alias("neg_ord"),
                              F.lit(label).alias("label"),
                              F.lit(sub).cast("string").alias("sub")))
    return F.array_max(F.array(*cands))


def label_intent(df: DataFrame, vocabulary=V.INTENT_FULL, *, subcategory: bool = True,
                 fallback=("General/Uncategorized", "General", 0.3), kw: KeywordFlags | None = None) -> DataFrame:
    own = kw is None
    if own:  # test each keyword once, then count and measure from the flags
        df, kw = with_keyword_flags(df, vocabulary_keywords(vocabulary))
    df = df.withColumn("_intent", intent_struct(kw, vocabulary))
    if own:
        df = df.drop(kw.out)
    hit = F.col("_intent.n") > 0
    cols = {
        "primary_intent": F.when(hit, F.col("_intent.label")).otherwise(F.lit(fallback[0])),
        "intent_confidence": F.when(hit, F.round(F.least(F.lit(1.0), F.col("_intent.n") / 5.0), 2))
                              .otherwise(F.lit(fallback[2])),
    }
    if subcategory:
        cols["subcategory"] = F.when(hit, F.col("_intent.sub")).otherwise(F.lit(fallback[1]))
    return df.withColumns(cols).drop("_intent")


def label_intent_rules(df: DataFrame, rules=V.INTENT_RULES, default=V.INTENT_RULES_DEFAULT,
                       out: str = "intent") -> DataFrame:
    """First matching rule wins (ordered when-chain)."""
    lower = F.col(LOWER)
    expr = None
    for label, kws in rules:
        expr = (F.when(any_contains(lower, kws), F.lit(label)) if expr is None
                else expr.when(any_contains(lower, kws), F.lit(label)))
    return df.withColumn(out, expr.otherwise(F.lit(default)) if expr is not None else F.lit(default))


# -- difficulty --------------------------------------------------------------

def label_difficulty(df: DataFrame, spec=V.DIFFICULTY_FULL, text: str = "prompt_text",
                     kw: KeywordFlags | None = None) -> DataFrame:
    """Additive score clamped to 1..5, its level and '; '-joined reasons."""
    lower = kw if kw is not None else F.col(LOWER)
    n = F.length(F.col(text))
    L = spec["lengths"]
    length_term = (F.when(n < L["short_lt"], F.lit(-1)).when(n > L["long_gt"], F.lit(2))
                   .when(n > L["mid_gt"], F.lit(1)).otherwise(F.lit(0)))
    length_reason = (F.when(n < L["short_lt"], F.lit(L["short_reason"]))
                     .when(n > L["long_gt"], F.lit(L["long_reason"]))
                     .when(n > L["mid_gt"], F.lit(L["mid_reason"])))
    counts = {f"_d{i}": count_contains(lower, kws) for i, (_, kws, _) in enumerate(spec["terms"])}
    counts["_dq"] = char_count(F.col(text), "?")
    df = df.withColumns(counts)
    score = length_term
    reasons = [length_reason]
    for i, (reason, _, need) in enumerate(spec["terms"]):
        c = F.col(f"_d{i}")
        score = score + (c >= need).cast("int")
        msg = F.lit(reason) if "{n}" not in reason else F.concat(
            F.lit(reason.split("{n}")[0]), c.cast("string"), F.lit(reason.split("{n}")[1]))
        reasons.append(F.when(c >= need, msg))
    q_reason, q_need = spec["questions"]
    q = F.col("_dq")
    score = score + (q >= q_need).cast("int")
    reasons.append(F.when(q >= q_need, F.lit(q_reason) if "{n}" not in q_reason else F.concat(
        F.lit(q_reason.split("{n}")[0]), q.cast("string"), F.lit(q_reason.split("{n}")[1]))))
    if spec.get("code"):
        c_reason, c_words, c_len = spec["code"]
        code = (has(F.col(text), "```") | any_contains(lower, c_words)) & (n > c_len)
        score = score + code.cast("int")
        reasons.append(F.when(code, F.lit(c_reason)))
    score = F.greatest(F.lit(1), F.least(F.lit(5), F.lit(2) + score))
    levels = F.array(*[F.lit(x) for x in V.DIFFICULTY_LEVELS])
    joined = F.array_join(F.array_compact(F.array(*reasons)), "; ")
    return (df.withColumn("difficulty_score", score.cast("bigint"))
              .withColumns({"difficulty_level": F.element_at(levels, F.col("difficulty_score").cast("int")),
                            "difficulty_reasons": F.when(joined == "", F.lit("Default")).otherwise(joined)})
              .drop(*counts.keys()))


def label_difficulty_patterns(df: DataFrame, spec=V.DIFFICULTY_PATTERNS, text: str = "prompt_text") -> DataFrame:
    """Declared pattern sets per level: a level applies when one of its patterns
    matches the lower text and the length lies in its range; highest applies."""
    lower = F.col(LOWER)
    n = F.length(F.col(text))
    expr = None
    for level, score, pats, lo, hi in reversed(spec):
        cond = F.lit(False)
        for p in pats:
            cond = cond | lower.rlike(p)
        if lo is not None:
            cond = cond & (n >= lo)
        if hi is not None:
            cond = cond & (n <= hi)
        expr = (F.when(cond, F.struct(F.lit(level).alias("l"), F.lit(score).alias("s"))) if expr is None
                else expr.when(cond, F.struct(F.lit(level).alias("l"), F.lit(score).alias("s"))))
    expr = expr.otherwise(F.struct(F.lit("Unrated").alias("l"), F.lit(0).alias("s")))
    return (df.withColumn("_p", expr)
              .withColumns({"pattern_level": F.col("_p.l"), "pattern_score": F.col("_p.s").cast("bigint")})
              .drop("_p"))


# -- products, capabilities, expected response ----------------------------------

def label_products(df: DataFrame, vocabulary=V.PRODUCTS_FULL, *, codes: bool = True,
                   kw: KeywordFlags | None = None) -> DataFrame:
    lower = kw if kw is not None else F.col(LOWER)
    # one presence test per product, shared by the name and code lists
    hits = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(code).cast("string").alias("code"))
                     .alias(f"p{i}") for i, (name, kws, code) in enumerate(vocabulary)])
    flags = F.array(*[any_contains(lower, kws) for _, kws, _ in vocabulary])
    df = df.withColumn("_pf", flags)
    found = F.filter(F.arrays_zip(hits.alias("h"), F.col("_pf").alias("f")), lambda x: x["f"])
    df = df.withColumn("_prod", found)
    cols = {"is_microsoft_related": F.size("_prod") > 0,
            "microsoft_products": F.array_join(F.transform("_prod", lambda x: x["h"]["name"]), "|")}
    if codes:
        cols["microsoft_product_codes"] = F.array_join(F.transform("_prod", lambda x: x["h"]["code"]), "|")
    return df.withColumns(cols).drop("_prod", "_pf")


def label_capabilities(df: DataFrame, flags=V.CAPABILITIES_FULL, kw: KeywordFlags | None = None) -> DataFrame:
    lower = kw if kw is not None else F.col(LOWER)
    return df.withColumns({name: any_contains(lower, kws) for name, kws in flags})


def label_expected_response(df: DataFrame, flags=V.EXPECTED_RESPONSE_FLAGS,
                            score: str = "difficulty_score", kw: KeywordFlags | None = None) -> DataFrame:
    lower = kw if kw is not None else F.col(LOWER)
    s = F.col(score)
    cols = {"expected_response_length": F.when(s >= 4, "long").when(s >= 2, "medium").otherwise("short")}
    cols.update({name: any_contains(lower, kws) for name, kws in flags})
    return df.withColumns(cols)


# -- language ---------------------------------------------------------------------

def language_expr(text, rules: str = "cascade") -> Column:
    """Script then accent cascade, first hit wins. ``lite`` stops after the
    scripts. Latin tests read lower-cased text."""
    t = col_(text)
    lo = F.lower(t)
    expr = None
    for label, cls in V.LANGUAGE_CASCADE:
        cond = t.rlike(f"[{cls}]")
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    if rules == "cascade":
        for label, cls in V.LANGUAGE_LATIN:
            expr = expr.when(lo.rlike(f"[{cls}]"), F.lit(label))
    return expr.otherwise(F.lit("en"))
