"""Sink round trips, newest-file input and the declared difficulty patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.text import WS_CLASS
from ..operators import evaluate as E
from ..operators import harvest as HV
from ..operators import label as L
from ..sources import fixtures as FX
from ..sources import io as IO
from ..sources.exports import Exports
from ..streaming.jobs import run_dir
from . import generate_plans as GP
from . import harvest_plans as HP
from . import sqlgen as S
from .sqlgen import q


def q_sinks_roundtrip(spark, sf):
    """Labelled harvest -> CSV + JSON manifest + per-level partitions + latest
    and snapshot copies -> the per-level table read back."""
    base = run_dir(spark, "sinks")
    # materialise once in the shared folder; every export reads this table
    HP.harvest_labelled_df(spark, sf).write.parquet(f"{base}/labelled")
    lab = spark.read.parquet(f"{base}/labelled")
    IO.write_csv(lab, f"{base}/csv")
    IO.write_json_with_manifest(lab, f"{base}/json", {"source": "documents", "run_date": HP.RUN_DATE})
    IO.write_partitioned(lab, f"{base}/by_level", "difficulty_level")
    IO.write_subset(lab, F.col("is_microsoft_related"), f"{base}/product_related")
    IO.write_latest_and_snapshot(lab, f"{base}/results", "20260106_000000")
    # summary and rubric tables next to the data (JSON lines)
    HV.harvest_summary(lab).coalesce(1).write.mode("overwrite").json(f"{base}/summary")
    E.weights_frame(spark).coalesce(1).write.mode("overwrite").json(f"{base}/rubric")
    return spark.read.parquet(f"{base}/by_level")


def q_latest_file(spark, sf):
    """Two CSV exports of the intents, a folder of files each; the newest is read and typed.
    The first one's files are dated back, so that times alone tell them apart."""
    base = run_dir(spark, "latest")
    raw = FX.intents_text(spark, sf)
    older = raw.withColumn("action", F.lower("action"))
    IO.write_csv(older, f"{base}/exports/1")
    IO.set_times(spark, f"{base}/exports/1", 1_700_000_000_000)
    IO.write_csv(raw, f"{base}/exports/2")
    newest = IO.newest_folder(spark, f"{base}/exports", "csv", header=True)
    typed = IO.typed_intents(newest.select(F.col("intent_id").cast("bigint").alias("intent_id"),
                                           *[c for c in IO.INTENT_CSV_COLUMNS if c != "intent_id"]))
    return typed.filter(F.col("_reject").isNull()).select(*GP.TYPED_COLS)


def _docs(spark, sf):
    return FX.documents(spark, sf).select("doc_id", "source", "lang", "text")


def q_first_rows(spark, sf):
    """A CSV export of the prompts, read back as strings: its first 100 rows by number."""
    out = Exports(spark, run_dir(spark, "rows"))
    out.write("20260106", _docs(spark, sf), "csv")
    return IO.first_rows(out.latest().withColumn("n", F.col("doc_id").cast("long")), "n", FIRST_ROWS).drop("n")


def q_export_manifests(spark, sf):
    """One run per format; what their manifests say, and the rows read back."""
    out = Exports(spark, run_dir(spark, "formats"))
    for k, fmt in enumerate(("csv", "json", "parquet")):
        out.write(f"2026010{k}", _docs(spark, sf), fmt, source="documents")
    read = None
    for run in out.runs():
        rows = out.read(run).groupBy("source").agg(F.count("*").alias("rows"), F.sum(F.length("text")).cast("long").alias("chars"))
        part = rows.select(F.lit(out.manifest(run)["format"]).alias("format"), "source", "rows", "chars", F.lit(out.manifest(run)["rows"]).alias("manifest_rows"))
        read = part if read is None else read.unionByName(part)
    return read


def q_export_as_of(spark, sf):
    """Two runs of a growing table: what was current after the first, and the latest."""
    out = Exports(spark, run_dir(spark, "versions"))
    d = _docs(spark, sf)
    out.write("20260101_000000", d.where("doc_id % 2 = 0"))
    out.write("20260201_000000", d)
    then = out.read(out.as_of("20260115_120000")).withColumn("version", F.lit("then"))
    return then.unionByName(out.latest().withColumn("version", F.lit("now"))).groupBy("version", "source").agg(
        F.count("*").alias("rows"), F.sum("doc_id").alias("ids"))


def q_export_subset(spark, sf):
    """Product-related rows and long prompts of the labelled harvest, each written on its own
    if there are any, and read back."""
    base = run_dir(spark, "subset")
    HP.harvest_labelled_df(spark, sf).write.parquet(f"{base}/labelled")  # labels are worked out once, then filtered
    lab, out = spark.read.parquet(f"{base}/labelled"), None
    for name, cond in (("product_related", F.col("is_microsoft_related")), ("long", F.col("prompt_length") > LONG_PROMPT)):
        if IO.write_subset(lab, cond, f"{base}/{name}"):
            rows = spark.read.parquet(f"{base}/{name}").select(F.lit(name).alias("subset"), "prompt_id", "source")
            out = rows if out is None else out.unionByName(rows)
    return lab.limit(0).select(F.lit("").alias("subset"), "prompt_id", "source") if out is None else out


def q_export_rubric(spark, sf):
    """Rubric weights with their scale as a table next to the data, read back."""
    out = Exports(spark, run_dir(spark, "rubric"))
    scale = E.weights_frame(spark).select("*", F.lit(E.SCALE[0]).alias("lowest"), F.lit(E.SCALE[1]).alias("highest"))
    out.write("20260106", scale, "json")
    judged = FX.ratings(spark, sf).groupBy("criterion").agg(F.count("*").alias("ratings"))
    held = out.latest().select("criterion", F.col("weight").cast("double").alias("weight"), F.col("lowest").cast("int").alias("lowest"), F.col("highest").cast("int").alias("highest"))
    return held.join(judged, "criterion", "left")


def q_export_summary(spark, sf):
    """The harvest summary as JSON lines, read back."""
    out = Exports(spark, run_dir(spark, "summary"))
    out.write("20260106", HV.harvest_summary(HP.harvest_labelled_df(spark, sf)), "json")
    return out.latest().select("metric", "key", F.col("value").cast("double").alias("value"))


FIRST_ROWS = 100
LONG_PROMPT = 2000


def portable(p: str) -> str:
    """Same meaning in Java regex and RE2: ASCII word boundary at a pattern's
    end, explicit white-space and word classes."""
    return (p.replace(r"\b", "(?:[^0-9A-Za-z_]|$)").replace(r"\s", WS_CLASS).replace(r"\w", "[0-9A-Za-z_]"))


PATTERNS = [(lvl, sc, [portable(p) for p in pats], lo, hi) for lvl, sc, pats, lo, hi in V.DIFFICULTY_PATTERNS]


def q_difficulty_patterns(spark, sf):
    d = L.with_lower(FX.documents(spark, sf).select("doc_id", "text"), "text")
    return L.label_difficulty_patterns(d, PATTERNS, text="text").select("doc_id", "pattern_level", "pattern_score")


def patterns_sql():
    parts = []
    for level, score, pats, lo, hi in reversed(PATTERNS):
        cond = "(" + " OR ".join(f"regexp_matches(lower(text), {q(p)})" for p in pats) + ")"
        if lo is not None:
            cond += f" AND length(text) >= {lo}"
        if hi is not None:
            cond += f" AND length(text) <= {hi}"
        parts.append((cond, level, score))
    lvl = "CASE " + " ".join(f"WHEN {c} THEN {q(l)}" for c, l, _ in parts) + " ELSE 'Unrated' END"
    sc = "CASE " + " ".join(f"WHEN {c} THEN {s}" for c, _, s in parts) + " ELSE 0 END"
    return f"SELECT doc_id, {lvl} AS pattern_level, ({sc})::BIGINT AS pattern_score FROM documents"


QUERIES = {
    "sinks_roundtrip": q_sinks_roundtrip,
    "latest_file": q_latest_file,
    "first_rows": q_first_rows,
    "export_manifests": q_export_manifests,
    "export_as_of": q_export_as_of,
    "export_subset": q_export_subset,
    "export_rubric": q_export_rubric,
    "export_summary": q_export_summary,
    "difficulty_patterns": q_difficulty_patterns,
}

ORACLE = {
    "sinks_roundtrip": HP.ORACLE["harvest_labelled"],
    "latest_file": GP.ORACLE["intents_clean"],
    "first_rows": f"SELECT doc_id::VARCHAR AS doc_id, source, lang, text FROM documents ORDER BY documents.doc_id LIMIT {FIRST_ROWS}",
    "export_manifests": """SELECT format, source, count(*)::BIGINT AS rows, sum(length(text))::BIGINT AS chars, (SELECT count(*) FROM documents)::BIGINT AS manifest_rows
FROM documents, (VALUES ('csv'), ('json'), ('parquet')) v(format) GROUP BY format, source""",
    "export_as_of": """SELECT version, source, count(*)::BIGINT AS rows, sum(doc_id)::BIGINT AS ids
FROM documents, (VALUES ('then'), ('now')) v(version) WHERE version = 'now' OR doc_id % 2 = 0 GROUP BY version, source""",
    "export_subset": f"""WITH lab AS ({HP.ORACLE['harvest_labelled']}) SELECT 'product_related' AS subset, prompt_id, source FROM lab WHERE is_microsoft_related
UNION ALL SELECT 'long', prompt_id, source FROM lab WHERE prompt_length > {LONG_PROMPT}""",
    "export_rubric": f"""WITH rat AS ({FX.RATINGS_SQL}) SELECT w.criterion, w.weight, {E.SCALE[0]}::INT AS lowest, {E.SCALE[1]}::INT AS highest, r.ratings
FROM (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in E.WEIGHTS)}) w(criterion, weight)
LEFT JOIN (SELECT criterion, count(*)::BIGINT AS ratings FROM rat GROUP BY criterion) r USING (criterion)""",
    "export_summary": HP.ORACLE["harvest_summary"],
    "difficulty_patterns": patterns_sql(),
}
