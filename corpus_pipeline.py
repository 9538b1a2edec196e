"""Corpus pipeline: documents through the operators of quillspark.llm, stage by stage.

A stage returns the columns of documents (``COLUMNS``); what else its input holds is dropped,
since a column that a stage doesn't know might no longer fit the text it has changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, near_dup, quality_mil, quality_rules, sp_codec
from quillspark.llm.common import free_name, scratch_path, table
from quillspark.llm.pieces import Pieces
from quillspark.llm.queries import TOKENIZERS

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go; the others lose their failing lines."""
    judged = quality_rules.apply_rules(docs).where("kept")
    changed = F.col("n_failed_lines") > 0
    return _documents(judged.withColumns({
        "text": F.when(changed, F.col("clean_text")).otherwise(F.col("text")),
        "n_chars": F.when(changed, F.length("clean_text").cast("long")).otherwise(F.col("n_chars"))}))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: learns from the labelled documents of the whole table, judges
    what the rules left; documents with a score below 0.3 go."""
    corpus = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~quality_mil.held_out(F.col("doc_id"), 5))
    model = quality_mil.fit(corpus, labels, "quality")
    return _documents(quality_mil.score(docs, model).where("score >= 0.3"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates: of each group one document stays, that of the smallest id (and least
    digest of the text, where several texts share it); of rows equal in id and text the one
    whose other columns come first. Rows without an id are left alone."""
    mark = free_name(docs, "mark")
    marked = docs.where("doc_id is not null").withColumn(mark, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    kept = near_dup.near_duplicates(docs.select("doc_id", "text")).where("kept").select("doc_id", F.col("mark").alias(mark)).distinct()
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    one = (marked.join(kept, ["doc_id", mark], "left_semi").groupBy("doc_id", mark)
           .agg(F.max("text").alias("text"), F.min(F.struct(*rest)).alias("rest")).select("doc_id", "text", "rest.*"))
    return _documents(one).unionByName(_documents(docs.where("doc_id is null")))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: documents that hold a benchmark item go."""
    leaks = decontaminate.find_leaks(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return _documents(docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of what is left, decoded again to tell whether they give the text back."""
    pieces = Pieces.load(f"{TOKENIZERS}/piece_bpe_32k.model")
    both = sp_codec.encode(_documents(docs), pieces, check="round_trip")
    return both.select(*COLUMNS, "ids", F.size("ids").cast("long").alias("n_ids"), "round_trip")


STAGES = [
    ("quality_rules", rules_stage),
    ("quality_classifier", classifier_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", encoding_stage),
]

#: The classifier and the Viterbi segmentation can't be put in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
