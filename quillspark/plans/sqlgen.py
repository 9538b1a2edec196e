"""DuckDB SQL text for the oracle, generated from the same vocabularies as the
Spark expressions (the oracle is an independent engine, not shared code)."""

from __future__ import annotations

from .. import vocab as V
from ..functions.text import WS, WS_CLASS


def q(s) -> str:
    if s is None:
        return "NULL"
    return "'" + str(s).replace("'", "''") + "'"


def has(lt: str, kw: str) -> str:
    return f"(instr({lt}, {q(kw)}) > 0)"


def any_(lt: str, kws) -> str:
    return "(" + " OR ".join(has(lt, k) for k in kws) + ")" if kws else "FALSE"


def cnt(lt: str, kws) -> str:
    return "(" + " + ".join(f"{has(lt, k)}::INT" for k in kws) + ")"


def mlen(lt: str, kws) -> str:
    return "(" + " + ".join(f"(CASE WHEN {has(lt, k)} THEN {len(k)} ELSE 0 END)" for k in kws) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}|{WS}$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


def norm_key(x: str, n: int = 12) -> str:
    return f"substr(md5({collapse(f'lower({x})')}), 1, {n})"


def H(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 8))::BIGINT"


def char_count(x: str, ch: str) -> str:
    return f"(length({x}) - length(replace({x}, {q(ch)}, '')))"


def intent_struct(lt: str, vocabulary) -> str:
    items = []
    for i, (label, kws, sub) in enumerate(vocabulary):
        items.append("{" + f"'n': {cnt(lt, kws)}, 'len': {mlen(lt, kws)}, 'neg_ord': {-i}, "
                     f"'label': {q(label)}, 'sub': {q(sub)}::VARCHAR" + "}")
    return "list_max([" + ", ".join(items) + "])"


def intent_cols(s: str, subcategory=True, fallback=("General/Uncategorized", "General", 0.3)) -> list[str]:
    out = [f"CASE WHEN {s}.n > 0 THEN {s}.label ELSE {q(fallback[0])} END AS primary_intent",
           f"CASE WHEN {s}.n > 0 THEN round(least(1.0, {s}.n / 5.0), 2) ELSE {fallback[2]} END AS intent_confidence"]
    if subcategory:
        out.append(f"CASE WHEN {s}.n > 0 THEN {s}.sub ELSE {q(fallback[1])} END AS subcategory")
    return out


def intent_rules(lt: str, rules=V.INTENT_RULES, default=V.INTENT_RULES_DEFAULT) -> str:
    return "CASE " + " ".join(f"WHEN {any_(lt, kws)} THEN {q(label)}" for label, kws in rules) + f" ELSE {q(default)} END"


def difficulty_cols(t: str, lt: str, spec=V.DIFFICULTY_FULL) -> list[str]:
    n = f"length({t})"
    L = spec["lengths"]
    score = [f"(CASE WHEN {n} < {L['short_lt']} THEN -1 WHEN {n} > {L['long_gt']} THEN 2 "
             f"WHEN {n} > {L['mid_gt']} THEN 1 ELSE 0 END)"]
    reasons = [f"(CASE WHEN {n} < {L['short_lt']} THEN {q(L['short_reason'])} WHEN {n} > {L['long_gt']} "
               f"THEN {q(L['long_reason'])} WHEN {n} > {L['mid_gt']} THEN {q(L['mid_reason'])} END)"]

    def msg(reason, c):
        if "{n}" not in reason:
            return q(reason)
        a, b = reason.split("{n}")
        return f"({q(a)} || ({c})::VARCHAR || {q(b)})"
    for reason, kws, need in spec["terms"]:
        c = cnt(lt, kws)
        score.append(f"({c} >= {need})::INT")
        reasons.append(f"(CASE WHEN {c} >= {need} THEN {msg(reason, c)} END)")
    qr, qn = spec["questions"]
    qc = char_count(t, "?")
    score.append(f"({qc} >= {qn})::INT")
    reasons.append(f"(CASE WHEN {qc} >= {qn} THEN {msg(qr, qc)} END)")
    if spec.get("code"):
        cr, cw, cl = spec["code"]
        cond = f"(({has(t, '```')} OR {any_(lt, cw)}) AND {n} > {cl})"
        score.append(f"({cond})::INT")
        reasons.append(f"(CASE WHEN {cond} THEN {q(cr)} END)")
    sc = f"greatest(1, least(5, 2 + {' + '.join(score)}))::BIGINT"
    levels = "[" + ", ".join(q(x) for x in V.DIFFICULTY_LEVELS) + "]"
    joined = f"array_to_string(list_filter([{', '.join(reasons)}], lambda x: x IS NOT NULL), '; ')"
    return [f"{sc} AS difficulty_score",
            f"{levels}[{sc}] AS difficulty_level",
            f"CASE WHEN {joined} = '' THEN 'Default' ELSE {joined} END AS difficulty_reasons"]


def products_cols(lt: str, vocabulary=V.PRODUCTS_FULL, codes=True) -> list[str]:
    names = "list_filter([" + ", ".join(f"CASE WHEN {any_(lt, k)} THEN {q(n)} END" for n, k, _ in vocabulary) + "], lambda x: x IS NOT NULL)"
    out = [f"len({names}) > 0 AS is_microsoft_related", f"array_to_string({names}, '|') AS microsoft_products"]
    if codes:
        cl = "list_filter([" + ", ".join(f"CASE WHEN {any_(lt, k)} THEN {q(c)} END" for _, k, c in vocabulary) + "], lambda x: x IS NOT NULL)"
        out.append(f"array_to_string({cl}, '|') AS microsoft_product_codes")
    return out


def flag_cols(lt: str, flags) -> list[str]:
    return [f"{any_(lt, kws)} AS {name}" for name, kws in flags]


def expected_cols(lt: str, score: str = "difficulty_score") -> list[str]:
    return ([f"CASE WHEN {score} >= 4 THEN 'long' WHEN {score} >= 2 THEN 'medium' ELSE 'short' END AS expected_response_length"]
            + flag_cols(lt, V.EXPECTED_RESPONSE_FLAGS))


def language(t: str, rules="cascade") -> str:
    parts = [f"WHEN regexp_matches({t}, '[{cls}]') THEN {q(l)}" for l, cls in V.LANGUAGE_CASCADE]
    if rules == "cascade":
        parts += [f"WHEN regexp_matches(lower({t}), '[{cls}]') THEN {q(l)}" for l, cls in V.LANGUAGE_LATIN]
    return "CASE " + " ".join(parts) + " ELSE 'en' END"


def word_count(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '{WS}'), lambda w: w <> ''))"


RAW_PROMPTS = """SELECT source, doc_id AS seq, CAST(substr(source, 4) AS INT) AS source_ord, text,
  nullif(CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END, '') AS language FROM documents"""
