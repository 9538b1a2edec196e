"""Intent tables -> typed intents, analysis, generation requests and families
of generated test prompts (10 slots per intent), rubric and conformance.

Every generator is a narrow projection: each intent row is expanded in place
by ``explode`` of a literal slot array (no join, no shuffle); templates are
literal arrays picked by ``element_at``. Only sequential ids (one
range-partitioned pass) and text dedup (proposal rounds) shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import templates as TP
from ..functions.text import WS, md5int, sentence_case

INT_RE = r"^[+-]?[0-9]+$"


# -- typed scan ----------------------------------------------------------------

INT_COLS = ["action_rank", "rank_in_action", "feedback_count", "tenant_count"]
FLOAT_COLS = ["active_weeks_p75"]
BOOL_COLS = ["reliable"]
TEXT_COLS = ["action", "object", "subject", "output", "sat_rate", "apology_rate", "no_citation_rate",
             "pct_users", "user_count"]


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}|{WS}$", "")


def parse_percent(c: Column) -> Column:
    """'93.5%' -> 0.935; text without a percent sign -> the number itself."""
    num = F.regexp_replace(c, r"[%,\s]", "").try_cast("double")
    return F.when(c.contains("%"), num / 100).otherwise(num)


def parse_count(c: Column) -> Column:
    """' 1,234 ' -> 1234 (grouped number kept as text at the source)."""
    return F.regexp_replace(c, r"[,\s]", "").try_cast("bigint")


def typed_intents(raw: DataFrame) -> DataFrame:
    """All-string intent rows -> typed columns plus ``_reject`` (null when the
    row is usable). Blank int -> 0, blank float -> 1.0, bool is 'TRUE' in any
    case; a non-blank value that does not parse rejects the row."""
    cols, checks = {}, []
    for c in INT_COLS:
        s = _strip(F.col(c))
        ok = (F.coalesce(s, F.lit("")) == "") | s.rlike(INT_RE)
        cols[c] = F.when(F.coalesce(s, F.lit("")) == "", F.lit(0)).otherwise(s.try_cast("bigint")).cast("bigint")
        checks.append(F.when(~ok, F.lit(f"bad {c}")))
    for c in FLOAT_COLS:
        s = _strip(F.col(c))
        v = s.try_cast("double")
        cols[c] = F.when(F.coalesce(s, F.lit("")) == "", F.lit(1.0)).otherwise(v)
        checks.append(F.when((F.coalesce(s, F.lit("")) != "") & v.isNull(), F.lit(f"bad {c}")))
    for c in BOOL_COLS:
        cols[c] = F.upper(F.coalesce(F.col(c), F.lit("FALSE"))) == "TRUE"
    for c in TEXT_COLS:
        cols[c] = F.coalesce(_strip(F.col(c)), F.lit(""))
    valid = (cols["action"] != "") & (cols["object"] != "") & (cols["action"] != "?") & (cols["object"] != "?")
    reject = F.when(~valid, F.lit("missing action or object")).otherwise(F.coalesce(*checks))
    out = raw.select("intent_id", *[v.alias(k) for k, v in cols.items()], reject.alias("_reject"))
    return out.withColumns({"sat_rate_value": parse_percent(F.col("sat_rate")),
                            "pct_users_value": parse_percent(F.col("pct_users")),
                            "user_count_value": parse_count(F.col("user_count"))})


def clean_value(c: Column) -> Column:
    """Placeholder values (stripped, case-sensitive) become blank."""
    s = F.coalesce(_strip(c), F.lit(""))
    return F.when(s.isin(*TP.PLACEHOLDER_VALUES), F.lit("")).otherwise(s)


# -- analysis --------------------------------------------------------------------

def _lookup_map(groups) -> Column:
    """First-listed category wins for a value that appears twice."""
    seen, kv = set(), []
    for cat, vals in groups:
        for v in vals:
            if v not in seen:
                seen.add(v)
                kv += [F.lit(v), F.lit(cat)]
    return F.create_map(*kv)


def analyze_intents(df: DataFrame) -> DataFrame:
    a, o, s, out = F.col("action"), F.col("object"), F.col("subject"), F.col("output")
    has_subject = (s != "") & (s != "?")
    has_object = (o != "") & (o != "?")
    sig = F.concat_ws(" ", a, F.when(has_subject, F.concat(F.lit("from/about "), s)),
                      F.when(has_object, F.concat(F.lit("the "), o)),
                      F.when(out != "", F.concat(F.lit("as "), out)))
    return df.select(
        "intent_id", "action", "object", "subject", "output",
        F.coalesce(F.element_at(_lookup_map(TP.ACTION_CATEGORIES), F.upper(a)), F.lit("other")).alias("action_category"),
        F.when(~has_object, F.lit("unspecified"))
         .otherwise(F.coalesce(F.element_at(_lookup_map(TP.OBJECT_CATEGORIES), F.upper(o)), F.lit("other")))
         .alias("object_category"),
        has_subject.alias("has_subject"),
        (out != "").alias("has_explicit_output"),
        sig.alias("semantic_signature"),
        ((a != "") & has_object & has_subject).alias("multi_component"),
        F.upper(a).isin(*TP.TRANSFORM_ACTIONS).alias("has_transformation"),
        has_subject.alias("requires_context"),
        (out != "").alias("has_specified_output"),
    )


def action_distribution(analysis: DataFrame, top: int = 15) -> DataFrame:
    """Distinct actions, top actions by count, categories by count (long form)."""
    by_action = analysis.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    distinct = by_action.agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("distinct_actions").alias("metric"), F.lit(None).cast("string").alias("key"),
        F.col("value").cast("bigint").alias("value"))
    top_actions = (by_action.orderBy(F.desc("n"), F.asc("action")).limit(top)
                   .select(F.lit("top_action").alias("metric"), F.col("action").alias("key"),
                           F.col("n").cast("bigint").alias("value")))
    cats = (analysis.groupBy("action_category").agg(F.count(F.lit(1)).cast("bigint").alias("value"))
            .select(F.lit("action_category").alias("metric"), F.col("action_category").alias("key"), "value"))
    return distinct.unionByName(top_actions).unionByName(cats)


# -- generation requests ------------------------------------------------------------

def quality_context(df: DataFrame) -> Column:
    """Usage figures as name=value, left out where blank (rates also at 0%)."""
    def shown(name: str, when: Column | None = None) -> Column:
        pair = F.concat(F.lit(f"{name}="), F.col(name).cast("string"))
        return pair if when is None else F.when(when, pair)

    def rate(name: str) -> Column:
        return shown(name, ~F.col(name).isin("", "0%"))

    return F.array_join(F.array_compact(F.array(
        shown("user_count"), shown("pct_users"), shown("tenant_count"), shown("reliable", F.col("reliable")),
        shown("sat_rate", F.col("sat_rate") != ""), rate("apology_rate"), rate("no_citation_rate"))), "; ")


def flag_lines(flags: dict[str, bool] | None = None) -> Column:
    flags = flags or {}
    lines = [F.when(F.lit(bool(flags.get(name, True))), F.lit(line))
             for name, line in TP.GENERATION_FLAGS if line is not None]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


#: FIXED VALUES: keys of a generated item, as the response parser reads them.
RESPONSE_KEYS = ("prompt", "variant_type", "complexity_level", "expected_response_criteria", "evaluation_dimensions")


def request_text(intents: DataFrame, *, n: int = 10, flags: dict[str, bool] | None = None,
                 max_intents: int | None = None) -> DataFrame:
    """One generation request per intent (first ``max_intents`` by id when set),
    with blank response columns added: lines of what is wanted, of which intent
    (what it lacks is left out), its class, its usage and the rules to obey."""
    df = intents
    if max_intents is not None:
        df = df.orderBy("intent_id").limit(max_intents)
    an = analyze_intents(df).select("intent_id", "action_category", "object_category", "semantic_signature")
    df = df.join(an, "intent_id")
    part = lambda c, before: F.when(~F.coalesce(F.col(c), F.lit("")).isin("", "?"), F.concat(F.lit(before), F.col(c))).otherwise("")
    text = F.concat(
        F.lit(f"write_prompts count={n} keys={','.join(RESPONSE_KEYS)}\nintent: "), F.col("action"), part("object", " / "),
        part("subject", " / "), part("output", " -> "),
        F.lit("\nclass: "), F.col("action_category"), F.lit(" on "), F.col("object_category"), F.lit(", "), F.col("semantic_signature"),
        F.lit("\nseen: "), quality_context(df), F.lit("\nobey:\n"), flag_lines(flags))
    return df.select("intent_id", text.alias("request"),
                     F.lit(None).cast("string").alias("response"), F.lit(None).cast("string").alias("error"))


# -- shared fill helpers ------------------------------------------------------------

def _lit_array(xs) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def _pick(arr: Column, idx: Column) -> Column:
    """0-based cyclic pick: arr[idx mod size]."""
    return F.element_at(arr, (F.pmod(idx, F.size(arr)) + 1).cast("int"))


def fill(t: Column, values: dict[str, Column]) -> Column:
    for k, v in values.items():
        t = F.replace(t, F.lit("{" + k + "}"), v)
    return t


def verb_of(action: Column) -> Column:
    m = F.create_map(*[x for k, (b, _) in TP.VERBS.items() for x in (F.lit(k), F.lit(b))])
    return F.coalesce(F.element_at(m, F.upper(action)), F.lower(action))


def noun_of(action: Column) -> Column:
    m = F.create_map(*[x for k, (_, nn) in TP.VERBS.items() for x in (F.lit(k), F.lit(nn))])
    return F.coalesce(F.element_at(m, F.upper(action)), F.concat(F.lower(action), F.lit(" of")))


def object_phrase(obj: Column, idx: Column) -> Column:
    m = F.create_map(*[x for k, v in TP.OBJECT_PHRASES.items() for x in (F.lit(k), _lit_array(v))])
    arr = F.element_at(m, F.upper(obj))
    return F.coalesce(_pick(arr, idx), F.lower(obj))


def strip_end(c: Column) -> Column:
    return F.regexp_replace(c, r"[.?]+$", "")


def generation_base(intents: DataFrame, *, containment: bool = True) -> DataFrame:
    """Clean components, redundancy tests and the source-intent label. A subject
    is redundant when it equals the object or, with ``containment``, when one
    of the two contains the other."""
    a = F.upper(clean_value(F.col("action")))
    o = clean_value(F.col("object"))
    s = clean_value(F.col("subject"))
    out = clean_value(F.col("output"))
    df = intents.select("intent_id", F.col("action").alias("input_action"), F.col("object").alias("input_object"),
                        F.col("subject").alias("input_subject"), F.col("output").alias("input_output"),
                        a.alias("a"), o.alias("o"), s.alias("s"), out.alias("out"))
    df = df.filter((F.col("a") != "") & (F.col("o") != ""))
    ol, sl = F.lower(F.col("o")), F.lower(F.col("s"))
    redundant = (F.col("s") == "") | (ol == sl)
    if containment:
        redundant = redundant | sl.contains(ol) | ol.contains(sl)
    has_s = (F.col("s") != "") & ~redundant
    has_o = (F.col("out") != "") & (F.upper(F.col("out")) != F.upper(F.col("o")))
    label = F.concat(F.col("a"), F.lit(" + "), F.col("o"),
                     F.when(has_s, F.concat(F.lit(" (Subject: "), F.col("s"), F.lit(")"))).otherwise(F.lit("")),
                     F.when(has_o, F.concat(F.lit(" → "), F.col("out"))).otherwise(F.lit("")))
    return df.withColumns({"has_s": has_s, "has_o": has_o, "source_intent": label})


def sequential_index(df: DataFrame, order: str, out: str = "rank") -> DataFrame:
    """1-based consecutive rank by ``order`` without a single-partition window:
    range-sort, per-partition local numbers, per-partition offsets (one row
    per partition, broadcast by construction), then add. The sorted frame is
    checkpointed so partition ids stay fixed on recompute."""
    s = df.orderBy(order).withColumn("_mid", F.monotonically_increasing_id()).checkpoint()
    s = s.withColumn("_pid", F.shiftright("_mid", 33)).withColumn("_loc", F.col("_mid") - F.shiftleft(F.col("_pid"), 33))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (s.join(F.broadcast(offs.select("_pid", "_off")), "_pid")
             .withColumn(out, (F.col("_off") + F.col("_loc") + 1).cast("bigint"))
             .drop("_pid", "_loc", "_mid", "_off"))


# -- v2: deterministic slot generators ------------------------------------------------

_CTX_LISTS = {"WORK_CONTEXTS": TP.WORK_CONTEXTS, "TIME_CONTEXTS": TP.TIME_CONTEXTS,
              "CONDITIONS": TP.CONDITIONS, "SECOND_STEPS": TP.SECOND_STEPS, "ANGLES": TP.ANGLES,
              "COMPARISONS": TP.COMPARISONS, "SCENARIOS": TP.SCENARIOS, "CREATIVE": TP.CREATIVE}


def v2_text(slot: Column, var: Column) -> Column:
    """Prompt text of slot ``slot`` built with variation ``var`` (columns a, o,
    s, out, has_s, has_o must be present)."""
    templ = F.array(*[_lit_array(t) for t, *_ in TP.V2_SLOTS])
    shifts = _lit_array([sh for _, sh, *_ in TP.V2_SLOTS])
    ctxs = F.array(*[_lit_array(_CTX_LISTS[c] if c else [""]) for _, _, c, *_ in TP.V2_SLOTS])
    subj = _lit_array([x[3] for x in TP.V2_SLOTS])
    outc = _lit_array([x[4] for x in TP.V2_SLOTS])
    i = (slot + 1).cast("int")
    t = _pick(F.element_at(templ, i), var)
    t = fill(t, {"verb": verb_of(F.col("a")), "obj": object_phrase(F.col("o"), var + F.element_at(shifts, i)),
                 "ctx": _pick(F.element_at(ctxs, i), var), "Action": sentence_case(F.col("a"))})
    t = F.when(F.col("has_s"), F.concat(strip_end(t), fill(F.element_at(subj, i), {"subject": F.lower(F.col("s"))}))).otherwise(t)
    t = F.when(F.col("has_o"), F.concat(strip_end(t), fill(F.element_at(outc, i), {"output": F.lower(F.col("out"))}))).otherwise(t)
    return t


def _slots() -> Column:
    return F.array(*[F.struct(F.lit(k).alias("slot"), F.lit(v).alias("variant"), F.lit(c).alias("complexity"))
                     for k, (v, c) in enumerate(TP.SLOT_LAYOUT)])


def gen_v2(intents: DataFrame, *, ids: bool = True) -> DataFrame:
    """10 prompts per valid intent, first candidate (var = slot)."""
    base = generation_base(intents)
    if ids:
        base = sequential_index(base, "intent_id", "intent_rank")
    df = base.withColumn("_s", F.explode(_slots())).select("*", "_s.*").drop("_s")
    df = df.withColumn("synthetic_prompt", v2_text(F.col("slot"), F.col("slot")))
    cols = ["intent_id", "slot", "source_intent", "synthetic_prompt",
            F.col("variant").alias("prompt_variant_type"), F.col("complexity").alias("complexity_level"),
            "input_action", "input_object", "input_subject", "input_output"]
    if ids:
        cols.insert(0, F.format_string("SP_%06d", (F.col("intent_rank") - 1) * 10 + F.col("slot") + 1)
                    .alias("synthetic_prompt_id"))
    return df.select(*cols)


def v2_candidates(intents: DataFrame) -> DataFrame:
    """(seq, cand, text, h): the 4 alternates per (intent, slot); ``seq`` is the
    generation order intent_id * 10 + slot."""
    base = generation_base(intents)
    df = base.withColumn("_s", F.explode(_slots())).select("*", "_s.*").drop("_s")
    df = df.withColumn("cand", F.explode(F.array(*[F.lit(k) for k in range(len(TP.CANDIDATE_OFFSETS))])))
    offs = _lit_array(TP.CANDIDATE_OFFSETS)
    var = F.col("slot") + F.element_at(offs, (F.col("cand") + 1).cast("int"))
    df = df.withColumn("text", v2_text(F.col("slot"), var))
    return df.select((F.col("intent_id") * 10 + F.col("slot")).alias("seq"), "intent_id", "slot",
                     F.col("variant").alias("prompt_variant_type"), F.col("complexity").alias("complexity_level"),
                     "source_intent", "cand", "text", F.md5(F.lower("text")).alias("h"))


def dedup_proposals(cands: DataFrame, *, stats: dict | None = None) -> DataFrame:
    """Exact parallel form of "each row, in seq order, takes its first
    candidate whose hash no earlier row took; if all are taken it keeps the
    last one": deferred acceptance with one common priority (seq).

    Each round every unsettled row proposes its current candidate's hash;
    each hash goes to the lowest proposing seq (hash aggregate + join); the
    others advance. A row that is refused on its last candidate keeps it as a
    duplicate. Holders only ever move to lower seqs, so the result equals the
    serial one. State is checkpointed each round (cluster checkpoint dir). The
    joins are sort-merge by hint: a checkpoint is taken to be as large as the
    compressed scan below it, and one of many times that would be broadcast."""
    n_c = len(TP.CANDIDATE_OFFSETS)
    cands = cands.checkpoint()  # read by every round and by the final pick
    hashes = (cands.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("cand", "h"))).alias("_hs"))
                   .select("seq", F.transform("_hs", lambda x: x["h"]).alias("hs")))
    state = hashes.select("seq", "hs", F.lit(0).alias("p"), F.lit(False).alias("dup")).checkpoint()
    while True:  # holders only move down: ends by itself
        live = state.filter(~F.col("dup")).withColumn("h", F.element_at("hs", (F.col("p") + 1).cast("int")))
        win = live.groupBy("h").agg(F.min("seq").alias("_win"))
        judged = live.join(win.hint("merge"), "h").withColumn("_lost", F.col("seq") != F.col("_win"))
        new = judged.select("seq", "hs",
                            F.when(F.col("_lost") & (F.col("p") < n_c - 1), F.col("p") + 1).otherwise(F.col("p")).alias("p"),
                            (F.col("_lost") & (F.col("p") == n_c - 1)).alias("dup"),
                            F.col("_lost").alias("_moved"))
        new = new.unionByName(state.filter(F.col("dup")).select("seq", "hs", "p", "dup", F.lit(False).alias("_moved")))
        new = new.checkpoint()  # shared folder: nothing is held on executors between rounds
        moved = new.filter(F.col("_moved") & ~F.col("dup")).count()
        state = new.drop("_moved")
        if stats is not None:
            stats.setdefault("moved", []).append(moved)
        if moved == 0:
            break
    chosen = state.select("seq", F.col("p").alias("cand"), "dup")
    return cands.join(chosen.hint("merge"), ["seq", "cand"])


def gen_v2_dedup(intents: DataFrame) -> DataFrame:
    picked = dedup_proposals(v2_candidates(intents))
    return picked.select("seq", "intent_id", "slot", "prompt_variant_type", "complexity_level", "source_intent",
                         F.col("text").alias("synthetic_prompt"), F.col("cand").alias("alternate"),
                         F.col("dup").alias("is_duplicate"))


# -- v1: seeded template pick -------------------------------------------------------

def gen_v1(intents: DataFrame) -> DataFrame:
    base = generation_base(intents)
    df = base.withColumn("_s", F.explode(_slots())).select("*", "_s.*").drop("_s")
    key = F.concat_ws("|", F.col("intent_id").cast("string"), F.col("slot").cast("string"))
    plain = F.create_map(*[x for k, v in TP.V1_TEMPLATES.items() for x in (F.lit(k), _lit_array(v))])
    subj = F.create_map(*[x for k, v in TP.V1_SUBJECT_TEMPLATES.items() for x in (F.lit(k), _lit_array(v))])
    arr = F.when(F.col("has_s") & F.element_at(subj, F.col("variant")).isNotNull(),
                 F.element_at(subj, F.col("variant"))).otherwise(F.element_at(plain, F.col("variant")))
    t = _pick(arr, md5int(F.concat(key, F.lit("|t"))))
    t = fill(t, {"verb": verb_of(F.col("a")), "noun": noun_of(F.col("a")), "obj": F.lower(F.col("o")),
                 "ctx": _pick(_lit_array(TP.WORK_CONTEXTS), md5int(F.concat(key, F.lit("|c")))),
                 "Action": sentence_case(F.col("a")), "subject": F.lower(F.col("s"))})
    suffix = fill(_pick(_lit_array(TP.V1_OUTPUT_SUFFIXES), md5int(F.concat(key, F.lit("|s")))),
                  {"output": F.lower(F.col("out"))})
    add = F.col("has_o") & (F.pmod(md5int(F.concat(key, F.lit("|o"))), F.lit(2)) == 0) & \
        ~F.lower(t).contains(F.lower(F.col("out")))
    t = F.when(add, F.concat(t, suffix)).otherwise(t)
    t = F.trim(F.regexp_replace(t, WS, " "))
    return df.select("intent_id", "slot", F.col("variant").alias("prompt_variant_type"),
                     F.col("complexity").alias("complexity_level"), "source_intent", t.alias("synthetic_prompt"))


# -- v3: scenarios with and without context -----------------------------------------

def context_kind(obj: Column, slot: Column) -> Column:
    u = F.upper(obj)
    expr = None
    for kind, words, below in TP.V3_CONTEXT_RULES:
        cond = F.lit(False)
        for w in words:
            cond = cond | u.contains(w)
        if below is not None:
            cond = cond | (slot < below)
        expr = F.when(cond, F.lit(kind)) if expr is None else expr.when(cond, F.lit(kind))
    return expr.otherwise(F.lit(TP.V3_CONTEXT_DEFAULT))


def seeded(values, *parts: Column) -> Column:
    return _pick(_lit_array(values), md5int(F.concat_ws("|", *[p.cast("string") for p in parts])))


def gen_v3(intents: DataFrame) -> DataFrame:
    base = generation_base(intents, containment=False)
    df = base.withColumn("_s", F.explode(_slots())).select("*", "_s.*").drop("_s")
    needs = F.upper(F.col("a")).isin(*TP.ACTIONS_NEEDING_CONTEXT)
    vals = {k: seeded(v, F.col("intent_id"), F.col("slot"), F.lit(k)) for k, v in TP.V3_VALUES.items()}
    vals.update({"verb": verb_of(F.col("a")), "obj": F.lower(F.col("o")), "Action": sentence_case(F.col("a"))})
    with_ctx = _lit_array([w for _, w, _ in TP.V3_SCENARIOS])
    no_ctx = _lit_array([n for _, _, n in TP.V3_SCENARIOS])
    i = (F.col("slot") + 1).cast("int")
    kind = context_kind(F.col("o"), F.col("slot"))
    bodies = F.create_map(*[x for k, v in TP.CONTEXT_BODIES.items() for x in (F.lit(k), F.lit(v))])
    body = fill(F.element_at(bodies, kind), {**vals, "obj": F.col("o")})
    text = F.when(needs, fill(F.element_at(with_ctx, i), vals)).otherwise(fill(F.element_at(no_ctx, i), vals))
    text = F.when(F.col("has_s"), F.concat(strip_end(text), F.lit(" Focus on "), F.lower(F.col("s")), F.lit("."))).otherwise(text)
    text = F.when(F.col("has_o"), F.concat(strip_end(text), F.lit(" Deliver it as "), F.lower(F.col("out")), F.lit("."))).otherwise(text)
    return df.select("intent_id", "slot", F.element_at(_lit_array([n for n, *_ in TP.V3_SCENARIOS]), i).alias("scenario"),
                     F.col("variant").alias("prompt_variant_type"), F.col("complexity").alias("complexity_level"),
                     "source_intent", text.alias("synthetic_prompt"),
                     F.when(needs, kind).otherwise(F.lit("")).alias("context_kind"),
                     F.when(needs, body).otherwise(F.lit("")).alias("context_text"),
                     needs.alias("has_context_text"), F.col("a").alias("action"), F.col("o").alias("object"))


# -- offline templates -------------------------------------------------------------------

def gen_offline(intents: DataFrame) -> DataFrame:
    """Up to 9 template prompts per intent (subject branch, optional output row)."""
    a = F.lower(F.col("action"))
    o = F.when((F.col("object") != "") & (F.col("object") != "?"), F.lower(F.col("object"))).otherwise(F.lit("the item"))
    s = F.when((F.col("subject") != "") & (F.col("subject") != "?"), F.lower(F.col("subject")))
    out = F.when(F.col("output") != "", F.lower(F.col("output")))
    vals = {"verb": a, "obj": o, "Action": sentence_case(F.col("action")), "subject": s, "output": out}
    items = []
    for variant, t, need in TP.OFFLINE:
        cond = {None: F.lit(True), "subject": s.isNotNull(), "nosubject": s.isNull(), "output": out.isNotNull()}[need]
        items.append(F.when(cond, F.struct(F.lit(variant).alias("variant"), fill(F.lit(t), vals).alias("text"))))
    arr = F.filter(F.array(*items), lambda x: x.isNotNull())
    return (intents.select("intent_id", F.posexplode(arr).alias("pos", "t"))
                   .select("intent_id", F.col("pos").cast("bigint").alias("pos"),
                           F.col("t.variant").alias("variant_type"), F.col("t.text").alias("prompt")))


# -- rubric, conformance, summaries ----------------------------------------------------------

def rubric(prompts: DataFrame) -> DataFrame:
    """Criteria lines (action group, output, variant) and dimensions per prompt.
    Needs columns a (upper action), o, out, has_o, prompt_variant_type."""
    ua = F.upper(F.col("a"))
    vals = {"obj": F.lower(F.col("o")), "action": F.lower(F.col("a"))}
    expr = None
    for _, actions, lines in TP.RUBRIC_GROUPS:
        arr = F.array(*[fill(F.lit(x), vals) for x in lines])
        expr = F.when(ua.isin(*actions), arr) if expr is None else expr.when(ua.isin(*actions), arr)
    crit = expr.otherwise(F.array(*[fill(F.lit(x), vals) for x in TP.RUBRIC_DEFAULT]))
    out_line = F.when(F.col("out") != "", fill(F.lit(TP.RUBRIC_OUTPUT), {"output": F.lower(F.col("out"))}))
    vmap = F.create_map(*[x for k, v in TP.RUBRIC_VARIANT.items() for x in (F.lit(k), F.lit(v))])
    crit = F.array_compact(F.concat(crit, F.array(out_line, F.element_at(vmap, F.col("prompt_variant_type")))))
    dims = F.array_compact(F.concat(_lit_array(TP.BASE_DIMENSIONS), F.array(
        F.when(ua.isin(*TP.CREATIVITY_ACTIONS), F.lit("creativity")),
        F.when(ua.isin(*TP.ACTIONABILITY_ACTIONS), F.lit("actionability")))))
    ctype = F.create_map(*[x for k, v in TP.ACTION_TYPE_CRITERIA.items() for x in (F.lit(k), F.lit(v))])
    clist = F.create_map(*[x for k, v in TP.ACTION_TYPE_LISTS.items() for x in (F.lit(k), _lit_array(v))])
    return prompts.withColumns({
        "expected_response_criteria": F.to_json(crit),
        "evaluation_dimensions": F.to_json(dims),
        "criteria_count": F.size(crit).cast("bigint"),
        "action_type_criterion": F.coalesce(F.element_at(ctype, ua), F.lit(TP.ACTION_TYPE_DEFAULT)),
        "action_type_criteria": F.to_json(F.coalesce(F.element_at(clist, ua), _lit_array(TP.ACTION_TYPE_LIST_DEFAULT))),
    })


def scenario_rubric(v3: DataFrame) -> DataFrame:
    """Criteria and dimensions of each scenario row: the scenario's own, then those of the
    form it has (with or without a context document)."""
    lists = F.create_map(*[x for k, (v, _) in TP.V3_SCENARIO_RUBRIC.items() for x in (F.lit(k), _lit_array(v))])
    extra = F.create_map(*[x for k, (_, d) in TP.V3_SCENARIO_RUBRIC.items() for x in (F.lit(k), F.lit(d))])
    form = F.when(F.col("has_context_text"), F.lit(TP.WITH_CONTEXT_LINE)).otherwise(F.lit(TP.WITHOUT_CONTEXT_LINE))
    crit = F.concat(F.element_at(lists, F.col("scenario")), F.array(form))
    dims = F.concat(_lit_array(TP.BASE_DIMENSIONS), F.array(F.element_at(extra, F.col("scenario"))),
                    F.when(F.col("has_context_text"), F.array(F.lit("grounding"))).otherwise(F.array().cast("array<string>")))
    return v3.withColumns({"expected_response_criteria": F.to_json(crit), "evaluation_dimensions": F.to_json(dims)})


def word_count_col(c: Column) -> Column:
    return F.size(F.filter(F.split(c, WS), lambda w: w != "")).cast("bigint")


def conformance(gen: DataFrame) -> DataFrame:
    """Per intent: prompts in range of their level's word window, and whether
    the variant-group and level mix meets the requested quotas."""
    lo = F.create_map(*[x for k, (a, _) in TP.COMPLEXITY_WORDS.items() for x in (F.lit(k), F.lit(a))])
    hi = F.create_map(*[x for k, (_, b) in TP.COMPLEXITY_WORDS.items() for x in (F.lit(k), F.lit(b))])
    grp = F.create_map(*[x for k, v in TP.MIX_GROUPS.items() for x in (F.lit(k), F.lit(v))])
    wc = word_count_col(F.col("synthetic_prompt"))
    g = gen.select("intent_id", "prompt_variant_type", "complexity_level",
                   wc.between(F.element_at(lo, F.col("complexity_level")), F.element_at(hi, F.col("complexity_level"))).alias("in_range"),
                   F.coalesce(F.element_at(grp, F.col("prompt_variant_type")), F.lit("other")).alias("grp"))
    aggs = [F.count(F.lit(1)).cast("bigint").alias("n_prompts"),
            F.count_if(F.col("in_range")).cast("bigint").alias("n_in_range")]
    aggs += [F.count_if(F.col("grp") == k).cast("bigint").alias(f"n_{k}") for k in TP.MIX_QUOTA]
    aggs += [F.count_if(F.col("complexity_level") == k).cast("bigint").alias(f"n_{k}") for k in TP.LEVEL_QUOTA]
    per = g.groupBy("intent_id").agg(*aggs)
    ok = F.col("n_prompts") == 10
    for k, q in {**TP.MIX_QUOTA, **TP.LEVEL_QUOTA}.items():
        ok = ok & (F.col(f"n_{k}") == q)
    return per.withColumn("mix_ok", ok)


def gen_summary(gen: DataFrame, *, sample_positions=(1, 5, 10), preview: int = 200) -> DataFrame:
    """Variant and complexity distributions, totals, and the quality sample
    rows (fixed positions in id order) with cut text, as one long table."""
    g = gen.groupingSets([["prompt_variant_type"], ["complexity_level"], []], "prompt_variant_type", "complexity_level") \
           .agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.count_distinct("intent_id").cast("bigint").alias("intents"),
                F.grouping_id().alias("gid"))
    dist = g.filter(F.col("gid") != 3).select(
        F.when(F.col("gid") == 1, F.lit("variant")).otherwise(F.lit("complexity")).alias("metric"),
        F.coalesce("prompt_variant_type", "complexity_level").alias("key"), F.col("n").alias("value"),
        F.lit(None).cast("string").alias("text"))
    tot = g.filter(F.col("gid") == 3).select(F.explode(F.array(
        F.struct(F.lit("prompts").alias("metric"), F.col("n").alias("value")),
        F.struct(F.lit("intents").alias("metric"), F.col("intents").alias("value")))).alias("t")) \
        .select(F.col("t.metric").alias("metric"), F.lit(None).cast("string").alias("key"), F.col("t.value").alias("value"),
                F.lit(None).cast("string").alias("text"))
    sample = (gen.filter(F.col("_pos").isin(*sample_positions))
                 .select(F.lit("sample").alias("metric"), F.col("synthetic_prompt_id").alias("key"),
                         F.col("_pos").alias("value"), F.left(F.col("synthetic_prompt"), F.lit(preview)).alias("text")))
    return dist.unionByName(tot).unionByName(sample)


def variety_pick(intents: DataFrame, values, field: str = "project", slots: int = 10) -> DataFrame:
    """For each intent a per-intent pseudo-random order of the value list; slot
    k takes value (k mod n): values repeat only once all were used."""
    vals = intents.select("intent_id", F.posexplode(_lit_array(values)).alias("vpos", "value"))
    w = Window.partitionBy("intent_id").orderBy(F.md5(F.concat_ws("|", F.col("intent_id").cast("string"), F.col("value"))))
    ranked = vals.withColumn("r", (F.row_number().over(w) - 1).cast("bigint"))
    sl = intents.select("intent_id", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    sl = sl.withColumn("r", F.pmod(F.col("slot"), F.lit(len(values))).cast("bigint"))
    return sl.join(ranked, ["intent_id", "r"]).select("intent_id", F.col("slot").cast("bigint").alias("slot"),
                                                       F.lit(field).alias("field"), "value")
