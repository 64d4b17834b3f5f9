"""Shared storage for intermediate tables and resumable stages."""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it; only where
    that is unset on a local master (tests on one machine) a temporary folder is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="traitforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Intermediate tables that this process wrote and has not released.
_WRITTEN: list[str] = []


def written() -> int:
    """How many intermediate tables there are: a mark for :func:`release`."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0, keep_last: bool = False) -> None:
    """Delete the intermediate tables written ``since`` a mark, which no DataFrame still in use may
    read; with ``keep_last`` all but the last one."""
    kept = [_WRITTEN.pop()] if keep_last and len(_WRITTEN) > since else []
    for path in _WRITTEN[since:]:
        fs, p = _file_system(spark, path)
        fs.delete(p, True)
    _WRITTEN[since:] = kept


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


#: Has Spark delete a query's shuffle files when it ends, instead of when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a cut lineage that any
    executor can reread after another one is lost. The shuffle files of the write go with it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


class Stages:
    """Named stages under one folder, each written once as Parquet and reused while it is valid.

    A stage is valid if its ``_SUCCESS`` mark and its columns are there, and if it and the stages
    before it were made with the same settings. Running a stage anew makes those after it invalid.
    """

    def __init__(self, spark: SparkSession, folder: str, force: bool = False):
        self.spark, self.folder, self.force = spark, folder.rstrip("/"), force
        self.stale = force
        self.log: list[tuple[str, str, float]] = []

    def exists(self, name: str) -> bool:
        return exists(self.spark, f"{self.folder}/{name}/_SUCCESS")

    def _settings(self, name: str) -> str | None:
        if not self.exists(f"_settings/{name}"):
            return None
        return self.spark.read.text(f"{self.folder}/_settings/{name}").first()[0]

    def run(self, name: str, make: Callable[[], DataFrame], settings: dict | None = None, columns: list[str] | None = None) -> DataFrame:
        path, wanted = f"{self.folder}/{name}", json.dumps(settings or {}, sort_keys=True, default=str)
        if not self.stale and self.exists(name) and self._settings(name) == wanted:
            found = self.spark.read.parquet(path)
            if columns is None or set(columns) <= set(found.columns):
                self.log.append((name, "reused", 0.0))
                return found
        self.stale = True
        began = time.monotonic()
        made = make()
        made.write.mode("overwrite").parquet(path)
        self.spark.createDataFrame([(wanted,)], "settings string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/_settings/{name}")
        self.log.append((name, "made", time.monotonic() - began))
        return self.spark.read.schema(made.schema).parquet(path)

    def skipped(self, name: str, why: str) -> None:
        """Record that a part of the work was left out, and why."""
        self.log.append((name, f"skipped: {why}", 0.0))

    def report(self) -> DataFrame:
        """(stage, action, seconds) of this run, in order."""
        return self.spark.createDataFrame(self.log, "stage string, action string, seconds double")

    def write_report(self, facts: dict | None = None) -> None:
        """Append the report, with ``facts`` such as counts, to the folder's CSV reports."""
        rows = self.report().withColumn("facts", F.lit(json.dumps(facts or {}, sort_keys=True, default=str)))
        rows.coalesce(1).write.mode("append").option("header", True).csv(f"{self.folder}/reports")


class RunTable:
    """Tables of many runs in one folder, partitioned by ``keys`` (such as cut-off and run).

    Each write replaces the partitions that it holds and no others. A manifest says which runs are
    done, with which settings; it is written after their tables, so what a killed sweep left half
    done is not read, and is written again. All runs are read in one scan, which is pruned by key.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: tuple[str, ...]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys
        self._entries = ", ".join(f"{k} {'int' if k == 'cut_off' else 'string'}" for k in keys)

    def _manifest(self) -> DataFrame | None:
        path = f"{self.folder}/_manifest"
        return self.spark.read.schema(f"{self._entries}, settings string, status string, written double").parquet(path) if exists(self.spark, path) else None

    def done(self) -> dict[tuple, tuple[str, str]]:
        """(settings, status) of each run that is done, by its keys: one row a run."""
        rows = self._manifest()
        if rows is None:
            return {}
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct("settings", "status"), "written").alias("m"))
        return {tuple(r[k] for k in self.keys): tuple(r.m) for r in last.collect()}

    def write(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.keys).parquet(f"{self.folder}/{name}")

    def record(self, entries: list[tuple]) -> None:
        """Rows (keys, settings, status); ``made`` ones are read from now on."""
        rows = self.spark.createDataFrame([(*e, time.time()) for e in entries], f"{self._entries}, settings string, status string, written double")
        rows.coalesce(1).write.mode("append").parquet(f"{self.folder}/_manifest")

    def read(self, name: str, schema: str) -> DataFrame:
        """The rows of all runs whose last state is ``made``; ``schema`` is that of the other columns."""
        whole = T._parse_datatype_string(f"{schema}, {self._entries}")
        path, made = f"{self.folder}/{name}", [k for k, (_, status) in self.done().items() if status == "made"]
        if not made or not exists(self.spark, path):
            return self.spark.createDataFrame([], whole)
        rows = self.spark.read.schema(whole).parquet(path)
        return rows.join(F.broadcast(self.spark.createDataFrame(made, self._entries)), list(self.keys), "left_semi").select(*whole.names)
