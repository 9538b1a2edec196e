"""Quality rules: lines are judged first, then the document by what they leave.

Every line with a word is tested by the line rules. Failing lines are taken
out; a document that loses more than ``max_loss`` of its word characters is
rejected, as is one that fails the base rules (too few words, or too many
words inside repeated three-word windows).

Only column expressions are used: one projection, no shuffle, no Python.

Defined results: a null text counts as empty (no words, base rules fail); an
empty or blank text likewise; blank lines are never removed; repeated rows
are judged alike, row by row; all other columns of the input pass through,
and a result name that the input already has replaces the input's column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE_RUN, free_name, let, text_or_empty, words

SYMBOLS = "#*$%&|<>"
FEW = 16  # repeated windows of a text that are looked up one by one


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules; shares are of a line's length."""

    max_symbol_share: float = 0.08
    max_shout_share: float = 0.05
    max_upper_share: float = 0.5
    min_upper_chars: int = 25
    nav_separators: int = 3
    boilerplate_chars: int = 240
    boilerplate: tuple[str, ...] = (
        "all rights reserved", "terms of service", "terms of use", "privacy policy", "cookie policy",
        "accept cookies", "enable javascript", "subscribe to our newsletter", "share this on", "back to top",
        "skip to content", "log in to continue",
    )


@dataclass(frozen=True)
class DocRules:
    min_words: int = 50
    max_repeat_pct: int = 50
    max_loss: float = 0.5


#: At most three words, and nothing that ends a sentence.
SHORT_LINE = "^(?:\\S++\\s*+){1,3}+$"
SENTENCE_END = "[.!?:;\"'…”»)]$"


def _without(col: Column, chars: str) -> Column:
    return F.regexp_replace(col, "[" + "".join("\\" + c for c in chars) + "]+", "")


def _has_word(col: Column) -> Column:
    return col.rlike("[^\\x20\\x09-\\x0D]")


def line_fault(line: Column, rules: LineRules, symbols: Column, shouts: Column, capitals: Column) -> Column:
    """Name of the first rule that a line breaks, or null. Blank lines break none.
    The three flags say whether the whole text has any symbol, ``!!`` or
    capital; without them no line can break that rule, and it isn't tested."""
    def judge(t: Column) -> Column:
        size = F.length(t)
        n_symbols = size - F.length(_without(t, SYMBOLS))
        n_shouts = F.regexp_count(t, F.lit("!!"))
        n_upper = size - F.length(F.regexp_replace(t, "\\p{Lu}+", ""))
        separators = F.regexp_count(t, F.lit("(^|\\s)[|»›·>](\\s|$)"))
        phrases = t.rlike("(?i)(" + "|".join(rules.boilerplate) + ")")
        return (F.when(size == 0, F.lit(None).cast("string"))
                .when(symbols & (n_symbols > rules.max_symbol_share * size), F.lit("punctuation"))
                .when(shouts & (n_shouts > rules.max_shout_share * size), F.lit("punctuation"))
                .when(capitals & (size >= rules.min_upper_chars) & (n_upper > rules.max_upper_share * size),
                      F.lit("capitals"))
                .when(symbols & (separators >= rules.nav_separators), F.lit("navigation"))
                .when(t.rlike(SHORT_LINE) & ~t.rlike(SENTENCE_END), F.lit("navigation"))
                .when((size <= rules.boilerplate_chars) & phrases, F.lit("boilerplate")))
    return let(F.trim(line), judge)


def repeat_words(w: Column) -> Column:
    """Number of words inside three-word windows that a text holds twice or more."""
    def covered(grams: Column) -> Column:
        def width(at: Column) -> Column:
            start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
            step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"))
            return F.aggregate(at, start, step, lambda a: a["n"])

        def by_position(pairs: Column) -> Column:
            same = lambda p, k: F.coalesce(F.get(pairs, k)["h"] == p["h"], F.lit(False))
            hits = F.filter(pairs, lambda p, k: same(p, k - 1) | same(p, k + 1))
            return width(F.sort_array(F.transform(hits, lambda p: p["i"])))

        def by_value(found: Column) -> Column:  # few windows repeat: look each position up
            at = F.filter(F.transform(grams, lambda h, i: F.when(F.array_contains(found, h), i)), lambda i: i.isNotNull())
            pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
            return F.when(F.size(found) <= FEW, width(at)).otherwise(let(pairs, by_position))

        twice = let(F.sort_array(grams), lambda g: F.array_distinct(F.filter(g, lambda h, k: F.coalesce(F.get(g, k + 1) == h, F.lit(False)))))
        return F.when(F.size(F.array_distinct(grams)) < F.size(grams), let(twice, by_value)).otherwise(F.lit(0))

    grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(grams, covered)).cast("long")


def measures(text: Column) -> Column:
    """Struct of a text's counts: words, their code points, symbols, repeated lines, repeated words."""
    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.concat_ws("", w)).cast("long").alias("chars"),
                        repeat_words(w).alias("n_repeat_words"))

    dup_lines = let(F.filter(F.split(text, "\n", -1), _has_word), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return F.struct(
        let(words(text), of_words).alias("w"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        dup_lines.cast("long").alias("n_dup_lines"),
    )


def clean_lines(text: Column, rules: LineRules = LineRules()) -> Column:
    """Struct: the text without its failing lines, how many failed, and by which rules."""
    def split_up(judged: Column) -> Column:
        good = F.transform(F.filter(judged, lambda x: x["fault"].isNull()), lambda x: x["line"])
        faults = F.filter(F.transform(judged, lambda x: x["fault"]), lambda f: f.isNotNull())
        return F.struct(F.when(F.size(faults) == 0, text).otherwise(F.concat_ws("\n", good)).alias("text"),
                        F.size(faults).cast("long").alias("n_failed_lines"),
                        F.array_sort(F.array_distinct(faults)).alias("faults"))

    def judge(flags: Column) -> Column:
        return F.transform(F.split(text, "\n", -1), lambda x: F.struct(
            x.alias("line"), line_fault(x, rules, flags["symbols"], flags["shouts"], flags["capitals"]).alias("fault")))

    flags = F.struct(text.rlike("[#*$%&|<>»›·]").alias("symbols"), F.contains(text, F.lit("!!")).alias("shouts"),
                     text.rlike("\\p{Lu}").alias("capitals"))
    return let(let(flags, judge), split_up)


def apply_rules(df: DataFrame, text_col: str = "text", lines: LineRules = LineRules(),
                doc: DocRules = DocRules()) -> DataFrame:
    """All rows of ``df`` with the counts, ``clean_text``, ``n_failed_lines``,
    ``faults``, ``loss`` (share of word characters in failing lines),
    ``base_failed`` and ``kept``."""
    text = text_or_empty(F.col(text_col))
    m, c = free_name(df, "_counts"), free_name(df, "_cleaned")
    base_col, loss_col = free_name(df, "_base_failed"), free_name(df, "_loss")
    out = df.withColumn(m, let(text, measures)).withColumn(c, let(text, lambda t: clean_lines(t, lines)))
    counts, cleaned = F.col(m), F.col(c)
    n_words, chars = counts["w"]["n_words"], counts["w"]["chars"]
    base = (n_words < doc.min_words) | (100 * counts["w"]["n_repeat_words"] > doc.max_repeat_pct * n_words)
    left = F.length(F.regexp_replace(cleaned["text"], WHITE_RUN, ""))
    loss = F.when((cleaned["n_failed_lines"] > 0) & (chars > 0), 1 - left / chars).otherwise(F.lit(0.0))
    out = out.withColumns({base_col: base, loss_col: loss})
    return out.withColumns({
        "n_words": n_words, "word_chars": chars, "n_symbols": counts["n_symbols"],
        "n_dup_lines": counts["n_dup_lines"], "n_repeat_words": counts["w"]["n_repeat_words"],
        "clean_text": cleaned["text"], "n_failed_lines": cleaned["n_failed_lines"], "faults": cleaned["faults"],
        "loss": F.col(loss_col), "base_failed": F.col(base_col),
        "kept": ~F.col(base_col) & (F.col(loss_col) <= doc.max_loss),
    }).drop(m, c, base_col, loss_col)
