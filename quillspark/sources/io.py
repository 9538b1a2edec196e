"""Sources and sinks: typed CSV intent scan, first-N and newest-file reads,
CSV / JSON exports with a run manifest, partitioned outputs, latest +
snapshot copies and idempotent consolidated overwrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.generate import typed_intents

INTENT_CSV_COLUMNS = ["intent_id", "action", "object", "subject", "output", "action_rank", "rank_in_action",
                      "reliable", "feedback_count", "sat_rate", "apology_rate", "no_citation_rate", "pct_users",
                      "user_count", "tenant_count", "active_weeks_p75"]


def all_string_schema(cols) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in cols])


def read_intents_csv(spark: SparkSession, path: str, cols=INTENT_CSV_COLUMNS) -> DataFrame:
    """Header CSV read as all strings (no inference, no DROPMALFORMED), then
    the typed projection with a reject reason per row."""
    raw = (spark.read.schema(all_string_schema(cols)).option("header", True).option("multiLine", True)
           .option("escape", '"').csv(path))
    return typed_intents(raw.withColumn("intent_id", F.col("intent_id").cast("bigint")))


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """First ``n`` rows by ``order`` (TakeOrderedAndProject: a per-partition
    top-n, then a merge of n rows per partition)."""
    return df.orderBy(order).limit(n)


def newest_file(spark: SparkSession, path: str, fmt: str = "csv", **options) -> DataFrame:
    """Rows of the most recently modified file under ``path`` (of equal times, the
    last name). The choice reads file names and times only; of the data, only
    the chosen file is read. Without files the result is empty."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    newest = files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()["path"]
    return spark.read.format(fmt).options(**options).load(newest if newest is not None else path)


def newest_folder(spark: SparkSession, path: str, fmt: str = "csv", **options) -> DataFrame:
    """Rows of the folder under ``path`` that holds the most recently modified file (of
    equal times, the last name), all its files in parallel. The choice reads file names
    and times only. Without files the result is empty."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
             .select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "modificationTime"))
    newest = files.agg(F.max_by("folder", F.struct("modificationTime", "folder")).alias("folder")).first()["folder"]
    return spark.read.format(fmt).options(**options).load(newest if newest is not None else path)


def set_times(spark: SparkSession, path: str, millis: int) -> None:
    """Date the files of a folder, as a copy that keeps times would."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(folder):
        fs.setTimes(f.getPath(), millis, -1)


def _flat(df: DataFrame) -> DataFrame:
    """Arrays and maps as JSON text for text sinks."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


#: Rows of a CSV file. With line breaks inside fields a file is read by one task, so files are kept small.
FILE_ROWS = 20_000


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite") -> None:
    d = _flat(df.select(*columns) if columns else df)
    d.write.mode(mode).option("header", True).option("quoteAll", True).option("maxRecordsPerFile", FILE_ROWS).csv(path)


def write_json_with_manifest(df: DataFrame, path: str, meta: dict) -> None:
    """Rows as JSON lines, plus a one-row manifest (counts from one aggregate
    and the run metadata) next to them."""
    _flat(df).write.mode("overwrite").json(f"{path}/rows")
    m = df.agg(F.count(F.lit(1)).alias("rows"))
    for k, v in meta.items():
        m = m.withColumn(k, F.lit(v))
    m.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def write_partitioned(df: DataFrame, path: str, col: str, mode: str = "overwrite") -> None:
    """One output per value of ``col`` in a single job; rebalancing on
    the column first keeps the files few, and splits a value that holds most rows."""
    _flat(df).hint("rebalance", F.col(col)).write.mode(mode).partitionBy(col).parquet(path)


def write_subset(df: DataFrame, cond, path: str) -> bool:
    """Write the filtered subset only when it has rows."""
    sub = df.filter(cond)
    if sub.isEmpty():
        return False
    _flat(sub).write.mode("overwrite").parquet(path)
    return True


def write_latest_and_snapshot(df: DataFrame, base: str, run_ts: str) -> None:
    """Overwrite ``latest/`` and append a ``run_ts`` partition of snapshots."""
    d = _flat(df)
    d.write.mode("overwrite").parquet(f"{base}/latest")
    d.withColumn("run_ts", F.lit(run_ts)).write.mode("append").partitionBy("run_ts").parquet(f"{base}/snapshots")


def overwrite_partitions(df: DataFrame, path: str, col: str) -> None:
    """Consolidated save after a unit of progress: only the partitions present
    in ``df`` are replaced (dynamic overwrite), so a retried unit is idempotent."""
    (_flat(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(col).parquet(path))
