"""Versioned exports: every run of an export is kept, the latest or any earlier one is read back.

A run is one unit of a commit log: its rows (CSV, JSON lines or Parquet, many
files) lie in a folder of their own, and its mark says the format, the rows and
files written, the run's name and what the caller adds. A run that broke off
is not there; a run that is repeated under its name is not written again. The
latest run and the one that was current at a given name are found by the
marks alone, never by file times. Names sort by time (a run time stamp).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .commit_log import CommitLog
from .io import FILE_ROWS, _flat, all_string_schema

FORMATS = {"csv": {"header": True, "quoteAll": True, "escape": '"', "multiLine": True, "maxRecordsPerFile": FILE_ROWS}, "json": {}, "parquet": {}}


class Exports:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.log = spark, CommitLog(spark, folder)

    def write(self, run: str, df: DataFrame, fmt: str = "parquet", columns: list[str] | None = None, **meta) -> dict | None:
        """Export a run; its manifest, or null if the run is there already."""
        if fmt not in FORMATS:
            raise ValueError(f"not a format: {fmt!r}")
        if run in self.log.units():
            return None
        attempt = self.log.new_try()
        rows = df.select(*columns) if columns else df
        (_flat(rows) if fmt != "parquet" else rows).write.format(fmt).options(**{k: v for k, v in FORMATS[fmt].items() if k != "multiLine"}).save(self.log.path(attempt))
        # what was written is counted from what lies there, not from a second run of the plan
        kind = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
        held = self._load(attempt, fmt, kind.names)
        files = held.select(F.input_file_name().alias("f")).agg(F.count("*").alias("rows"), F.count_distinct("f").alias("files")).first()
        self.log.commit(run, attempt, format=fmt, columns=kind.names, rows=files["rows"], files=files["files"], **meta)
        return self.manifest(run)

    def _load(self, attempt: str, fmt: str, columns: list[str]) -> DataFrame:
        reader = self.spark.read.format(fmt).options(**FORMATS[fmt])
        if fmt != "parquet":  # text formats are read back as strings
            reader = reader.schema(all_string_schema(columns))
        return reader.load(self.log.path(attempt))

    def runs(self) -> list[str]:
        return self.log.units()

    def manifest(self, run: str) -> dict:
        return {"run": run, **self.log.info(run)}

    def manifests(self) -> DataFrame:
        """(run, format, rows, files) of all runs."""
        found = [self.manifest(r) for r in self.runs()]
        return self.spark.createDataFrame([(m["run"], m["format"], m["rows"], m["files"]) for m in found], "run string, format string, rows long, files long")

    def read(self, run: str) -> DataFrame:
        m = self.manifest(run)
        return self._load(m["try"], m["format"], m["columns"])

    def as_of(self, at: str) -> str | None:
        """The latest run not after ``at``."""
        return max([r for r in self.runs() if r <= at], default=None)

    def latest(self) -> DataFrame | None:
        runs = self.runs()
        return self.read(runs[-1]) if runs else None
