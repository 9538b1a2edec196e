"""Column-level text helpers. All return native Spark Columns (JVM-side,
codegen-friendly); none of them is a Python UDF."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unicode white space as Python's str.split()/str.strip() see it. Java and
# RE2 ``\s`` are ASCII-only, so the class is spelled out (same in both engines).
WS_CLASS = (r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
WS = WS_CLASS + "+"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove Unicode white space at both ends."""
    return F.regexp_replace(col_(c), f"^{WS}|{WS}$", "")


def collapse_ws(c) -> Column:
    """``' '.join(s.split())``: runs of white space to one space, ends stripped."""
    return F.trim(F.regexp_replace(col_(c), WS, " "))


def norm_key(c, n: int = 12) -> Column:
    """Normalised dedup key: md5 of lower-cased, white-space-collapsed text, first n hex."""
    return F.substring(F.md5(collapse_ws(F.lower(col_(c)))), 1, n)


def md5int(c) -> Column:
    """Deterministic 32-bit hash as bigint: first 8 hex digits of md5."""
    return F.conv(F.substring(F.md5(col_(c)), 1, 8), 16, 10).cast("bigint")


def keyword_pattern(keywords: Sequence[str]) -> str:
    """A pattern that finds, at every place of a text, the longest keyword that starts
    there: the keywords' trie, one branch per next character, longer before shorter."""
    trie: dict = {}
    for k in keywords:
        node = trie
        for ch in k:
            node = node.setdefault(ch, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        inner = {ch: sub for ch, sub in node.items() if ch}
        if not inner:
            return ""
        parts = [(ch, re.escape(ch) + pattern(sub)) for ch, sub in sorted(inner.items())]
        if len(parts) == 1 and "" not in node:
            return parts[0][1]
        return either(parts) + ("?" if "" in node else "")

    def either(parts: list[tuple[str, str]]) -> str:  # by halves, so that few branches are tried
        if len(parts) <= 3:
            return f"(?:{'|'.join(p for _, p in parts)})"
        half = len(parts) // 2
        chars = "".join(re.escape(ch) for ch, _ in parts[:half])
        return f"(?:(?=[{chars}]){either(parts[:half])}|{either(parts[half:])})"

    return f"(?=({pattern(trie)}))"


class KeywordFlags:
    """Presence of every distinct keyword, found in one pass per row into one
    boolean array column; label expressions read array elements instead of
    scanning the text again. The pass collects the longest keyword at every
    place; a keyword is there if one is found that begins with it."""

    def __init__(self, lower_col: str, keywords, out: str = "_kw"):
        self.lower, self.out, self.found = lower_col, out, f"{out}_found"
        self.pos = {k: i + 1 for i, k in enumerate(dict.fromkeys(keywords))}

    def add_to(self, df: DataFrame) -> DataFrame:
        """``df`` with the flags."""
        if not self.pos:
            return df.withColumn(self.out, F.array().cast("array<boolean>"))
        found = F.array_distinct(F.regexp_extract_all(F.col(self.lower), F.lit(keyword_pattern(self.pos)), F.lit(1)))

        def flag(k: str) -> Column:
            longer = [x for x in self.pos if x.startswith(k)]
            if len(longer) == 1:
                return F.array_contains(self.found, k)
            return F.arrays_overlap(self.found, F.array(*[F.lit(x) for x in longer]))

        return df.withColumn(self.found, found).withColumn(self.out, F.array(*[flag(k) for k in self.pos])).drop(self.found)

    def has(self, kw: str) -> Column:
        if kw in self.pos:
            return F.element_at(F.col(self.out), self.pos[kw])
        return F.col(self.lower).contains(kw)

    # compact forms: one small lambda over literal positions instead of one
    # generated branch per keyword (keeps the generated code far below the
    # JVM method limit, so the stage stays whole-stage compiled)
    def _ready(self, kws) -> bool:
        return all(k in self.pos for k in kws)

    def count(self, kws) -> Column:
        flags = F.col(self.out)
        idx = F.array(*[F.lit(self.pos[k]) for k in kws])
        return F.aggregate(idx, F.lit(0), lambda acc, i: acc + F.element_at(flags, i).cast("int"))

    def length(self, kws) -> Column:
        flags = F.col(self.out)
        pairs = F.array(*[F.struct(F.lit(self.pos[k]).alias("i"), F.lit(len(k)).alias("n")) for k in kws])
        return F.aggregate(pairs, F.lit(0), lambda acc, x: acc + F.when(F.element_at(flags, x["i"]), x["n"]).otherwise(0))

    def any(self, kws) -> Column:
        flags = F.col(self.out)
        return F.exists(F.array(*[F.lit(self.pos[k]) for k in kws]), lambda i: F.element_at(flags, i))


def has(lower_text, kw: str) -> Column:
    """Substring test on already lower-cased text (or a keyword-flag lookup)."""
    if isinstance(lower_text, KeywordFlags):
        return lower_text.has(kw)
    return col_(lower_text).contains(kw)


def any_contains(lower_text, keywords: Sequence[str]) -> Column:
    if isinstance(lower_text, KeywordFlags) and keywords and lower_text._ready(keywords):
        return lower_text.any(keywords)
    expr = F.lit(False)
    for kw in keywords:
        expr = expr | has(lower_text, kw)
    return expr


def count_contains(lower_text, keywords: Sequence[str]) -> Column:
    """Number of list entries present (a keyword counts once however often it occurs)."""
    if isinstance(lower_text, KeywordFlags) and keywords and lower_text._ready(keywords):
        return lower_text.count(keywords)
    terms = [has(lower_text, kw).cast("int") for kw in keywords]
    return sum(terms[1:], terms[0]) if terms else F.lit(0)


def matched_length(lower_text, keywords: Sequence[str]) -> Column:
    """Sum of the lengths of the keywords present."""
    if isinstance(lower_text, KeywordFlags) and keywords and lower_text._ready(keywords):
        return lower_text.length(keywords)
    terms = [F.when(has(lower_text, kw), F.lit(len(kw))).otherwise(F.lit(0)) for kw in keywords]
    return sum(terms[1:], terms[0]) if terms else F.lit(0)


def char_count(c, ch: str) -> Column:
    return F.length(col_(c)) - F.length(F.replace(col_(c), F.lit(ch), F.lit("")))


def sentence_case(c) -> Column:
    """Python ``str.capitalize()`` for ordinary text."""
    c = col_(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def blank_to_null(c) -> Column:
    c = col_(c)
    return F.when(strip_ws(c) == "", F.lit(None)).otherwise(c)


def word_count(c) -> Column:
    """Number of white-space separated words."""
    return F.size(F.filter(F.split(col_(c), WS), lambda w: w != ""))
