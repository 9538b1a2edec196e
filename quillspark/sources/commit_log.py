"""Commit log over a shared folder: results that are written once, whoever is late.

Every try of a unit of work writes to a folder of its own (``tries/<name>``);
the unit counts from the moment its mark (``marks/<unit>``) is in place, whose
content names the winning try. Marks appear whole, by a rename that does not
replace, so that of two writers one wins, and a try that broke off is never
read. Each mark is a small file: units are batches, rounds or exports, not rows.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class CommitLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def units(self) -> list[str]:
        """Committed units, by name."""
        fs, at = self._fs(), self._path("marks")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def info(self, unit: str) -> dict:
        """What the mark of a committed unit says."""
        source = self._fs().open(self._path(f"marks/{unit}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def new_try(self) -> str:
        """Name of a fresh try; its folder is ``path(name)``."""
        return uuid.uuid4().hex

    def path(self, attempt: str) -> str:
        return f"{self.folder}/tries/{attempt}"

    def commit(self, unit: str, attempt: str, **said) -> bool:
        """Make ``attempt`` the unit's outcome; false if the unit has one."""
        if not unit or not all(c.isalnum() or c in "-_." for c in unit):
            raise ValueError(f"not a unit's name: {unit!r}")
        fs, draft = self._fs(), self._path(f"drafts/{uuid.uuid4().hex}")
        fs.mkdirs(self._path("marks"))
        out = fs.create(draft)
        out.write(json.dumps({"try": attempt, **said}).encode())
        out.close()
        none = self.spark._sc._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            self._hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, self._path(f"marks/{unit}"), none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            fs.delete(draft, False)
            return False
        return True

    def write(self, unit: str, df: DataFrame, **said) -> bool:
        """Write ``df`` as the unit's outcome unless it has one."""
        if unit in self.units():
            return False
        attempt = self.new_try()
        df.write.parquet(self.path(attempt))
        return self.commit(unit, attempt, **said)

    def read(self, unit: str) -> DataFrame:
        return self.spark.read.parquet(self.path(self.info(unit)["try"]))

    def read_all(self, schema: str, units: list[str] | None = None) -> DataFrame:
        """Rows of all committed units (or those named)."""
        paths = [self.path(self.info(u)["try"]) for u in (self.units() if units is None else units)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
