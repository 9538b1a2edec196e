"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_format, decontaminate, langid, lattice_lm, near_dup, periodic_runs, quality_mil, quality_rules, sharding, sp_codec,
               token_rollup, turn_repair, url_filter)
from .common import let, scratch_path, table, words, written
from .pieces import Pieces

#: Folder of the public tokenizers' files.
TOKENIZERS = "/opt/tokenizers"

#: How the byte-level vocabularies split a text (a fixed value).
TOKEN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Rules of the URL query.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: The conversation that the formatting query adds: both turns hold control strings.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op3_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_mil.held_out(F.col("doc_id"), 5)
    labels = table(spark, sf_dir, "labels").where(~out)
    model = quality_mil.fit(docs, labels, "quality")
    scored = quality_mil.score(docs, model)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that leaks into it."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                    table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents: load them; withdraw every exact copy but
    the first; recount the texts that repeat lines without the repetitions. The
    first two are folded into a snapshot; the second is sent twice and counts once."""
    versions = {"bpe50k": f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "multi50k": f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"}
    lines = F.split("text", "\n", -1)
    docs = (table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
            .withColumn("digest", F.md5("text")).withColumn("repeats", F.size(F.array_distinct(lines)) < F.size(lines)))
    ledger = written(token_rollup.count_tokens(docs, versions, TOKEN_PATTERN), "ledger")
    recounted = docs.where("repeats").withColumn("text", F.concat_ws("\n", F.array_distinct(lines)))
    first = ledger.groupBy("digest").agg(F.min("doc_id").alias("first"))
    copies = ledger.join(first, "digest")
    fresh = token_rollup.count_tokens(recounted, versions, TOKEN_PATTERN).join(first, "digest").where("doc_id = first")
    names = list(versions)
    store = token_rollup.Rollup(spark, scratch_path(spark, "rollup"))
    store.commit("load", token_rollup.signed(ledger, names, 1))
    withdrawn = token_rollup.signed(copies.where("doc_id > first"), names, -1)
    store.commit("withdraw", withdrawn)
    store.compact()
    store.commit("recount", token_rollup.signed(copies.where("doc_id = first and repeats"), names, -1)
                 .unionByName(token_rollup.signed(fresh, names, 1)))
    store.commit("withdraw", withdrawn)
    return store.totals()


def op2_sp_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it."""
    pieces = Pieces.load(f"{TOKENIZERS}/piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sp_codec.encode(docs, pieces, check="round_trip").select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "round_trip")


def op5_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = Pieces.load(f"{TOKENIZERS}/piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lattice_lm.score_documents(docs, ~quality_mil.held_out(F.col("doc_id"), 10), pieces)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", F.col("learned_score").alias("score"), "fitted_score", F.col("score").alias("vocabulary_score"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    index = url_filter.build_index(spark, URL_RULES)
    return url_filter.judge_urls(pages, index).select("page_id", "host", "path", "rule", "verdict")


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("mark")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), n_shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(CONTROL_TEXT).alias("text"))
    return chat_format.digests(chat_format.format_conversations(turns.unionByName(extra)))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.apply_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_failed_lines", "loss")


def planted_periods(df: DataFrame) -> DataFrame:
    """``df`` with a tail of period p repeated from word a on, in the texts whose id's crc32 ends in 0."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(crc / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        spot = F.struct((g % n).alias("a"), (1 + F.floor((n - g % n) / (3 + g % 8))).alias("p"))
        word = lambda v: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < v["a"], i).otherwise(v["a"] + (i - v["a"]) % v["p"]).cast("int")))
        return F.when(n > 0, let(spot, lambda v: F.array_join(word(v), " "))).otherwise("")

    return df.withColumn("text", F.when(crc % 10 == 0, let(words(F.coalesce("text", F.lit(""))), repeated)).otherwise(F.col("text")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longer = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = found.withColumn("best", F.aggregate("runs", none, lambda best, r: F.when(longer(best, r), r).otherwise(best)))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                       F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                       F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
                       F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")


def damaged_turns(turns: DataFrame) -> DataFrame:
    """``turns`` with rows dropped, emptied, cut off, repeated or given to the user, by the crc32 of their place."""
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text = F.coalesce("text", F.lit(" "))
    rows = turns.withColumn("fate", F.crc32(place.cast("binary")) % 20).where("fate <> 0").select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = turn_repair.repair(damaged_turns(turns))
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    all_ids = turns.select(F.col("conv_id").alias("id")).distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return all_ids.join(fixed, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce(lines, F.lit("")).cast("binary"), 256).alias("repaired_sha256"))


def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = Pieces.load(f"{TOKENIZERS}/piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.fit(docs.where(~out), pieces)
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_sp_codec, op3_quality_mil, op4_token_counts, op5_lattice_lm, op6_url_filter, op7_near_dup, op8_sharding, op9_chat_format, op10_quality_rules,
                                   op11_periodic_runs, op12_turn_repair, op13_langid)}

_CONVERSATIONS = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{CONTROL_TEXT}' union all select -1, 1, 'assistant', '{CONTROL_TEXT}')
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|'))
      + length('<|im_end|>') + 1)::bigint as formatted_chars,
  regexp_full_match(string_agg(role, ' ' order by turn, role, text),
                    '(system )?user( assistant user)*( assistant)?') as legal
from t group by conv_id"""

_RULES = ", ".join(f"('{r}', '{r.split('/')[0]}', '/{r.split('/', 1)[1]}', '{v}')" for r, v in URL_RULES)

_PAGES = f"""
with rules(rule, h, p, v) as (values {_RULES}),
rest as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
host as (select page_id, r, lower(regexp_extract(r, '^[^/?#]*')) as host from rest),
parts as (select page_id, host, regexp_extract(substr(r, length(host) + 1), '^[^?#]*') as path from host)
select page_id, host, path, arg_max(rule, length(rule)) as rule, coalesce(arg_max(v, length(rule)), 'allow') as verdict
from parts left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
group by page_id, host, path"""

ORACLE: dict[str, str] = {"op6_url_filter": _PAGES, "op9_chat_format": _CONVERSATIONS}
