"""Versioned result snapshots: ``<root>/data/<job>/<event>/run_ms=<ms>/attempt=<id>/`` plus a manifest.

The manifest of a job and event gets a row after a snapshot is completely written, so it
marks the snapshot as valid, names its folder and carries its row count; a reader never sees
a half-written run. Every attempt writes a folder of its own and nothing that is stored is
ever overwritten, so a run may read what it adds to, and a run that is tried again after it
was completed does nothing.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

MANIFEST = "job string, event string, run_ms bigint, row_count bigint, format string, attempt string"


class Run(NamedTuple):
    run_ms: int
    row_count: int
    format: str
    attempt: str


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _data(self, job: str, event: str) -> str:
        return f"{self.root}/data/{job}/{event}"

    def _path(self, job: str, event: str, run_ms: int, attempt: str) -> str:
        return f"{self._data(job, event)}/run_ms={run_ms}/attempt={attempt}"

    def _manifest(self, job: str, event: str) -> str:
        return f"{self.root}/manifest/{job}/{event}"

    def write(
        self, rows: DataFrame, job: str, event: str, run_ms: int, fmt: str = "parquet", **options
    ) -> int:
        """Write a snapshot in parallel files and return its row count.

        The count is observed while writing, so the plan runs once. A run that is complete
        already keeps its rows, and its count is returned.
        """
        done = self._run(job, event, run_ms)
        if done is not None:
            return done.row_count
        attempt = uuid.uuid4().hex
        seen = Observation()
        counted = rows.observe(seen, F.count(F.lit(1)).alias("row_count"))
        counted.write.format(fmt).options(**options).save(self._path(job, event, run_ms, attempt))
        count = seen.get["row_count"]
        entry = self.spark.createDataFrame([Row(job, event, run_ms, count, fmt, attempt)], MANIFEST)
        entry.coalesce(1).write.mode("append").parquet(self._manifest(job, event))
        return count

    def runs(self) -> DataFrame:
        """All complete snapshots, one row per run."""
        return self._complete(self._entries(f"{self.root}/manifest"))

    @staticmethod
    def _complete(entries: DataFrame) -> DataFrame:
        """Of attempts that raced each other one counts, the same for every reader."""
        rest = F.min(F.struct("attempt", "row_count", "format")).alias("first")
        return entries.groupBy("job", "event", "run_ms").agg(rest).select("job", "event", "run_ms", "first.row_count", "first.format", "first.attempt")

    def _entries(self, path: str) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def latest_run(self, job: str, event: str) -> Run | None:
        """The newest complete snapshot of a job and event: one row of its manifest."""
        return self._first(self._entries(self._manifest(job, event)))

    def _run(self, job: str, event: str, run_ms: int) -> Run | None:
        return self._first(self._entries(self._manifest(job, event)).where(F.col("run_ms") == run_ms))

    @staticmethod
    def _first(entries: DataFrame) -> Run | None:
        found = entries.orderBy(F.desc("run_ms"), "attempt").limit(1).collect()
        return Run(found[0].run_ms, found[0].row_count, found[0].format, found[0].attempt) if found else None

    def latest(self, job: str, event: str, schema=None) -> DataFrame:
        """Rows of the newest snapshot; ``FileNotFoundError`` if there is none."""
        run = self.latest_run(job, event)
        if run is None:
            raise FileNotFoundError(f"no snapshot of {job} for {event}")
        reader = self.spark.read.format(run.format)
        if schema is not None:
            reader = reader.schema(schema)
        return reader.load(self._path(job, event, run.run_ms, run.attempt))

    def parts(self, job: str, event: str, schema: str) -> DataFrame:
        """Rows of all complete runs together: a table that grows by one part per run.

        The folder is read as a whole and rows of attempts that the manifest does not name
        are left out by a join, so the list of runs never comes to the driver.
        """
        entries = self._entries(self._manifest(job, event))
        if entries.isEmpty():
            return self.spark.createDataFrame([], schema)
        valid = self._complete(entries).select(F.col("attempt").alias("_attempt"))
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(self._data(job, event))
        attempt = F.regexp_extract(F.col("_metadata.file_path"), "/attempt=([0-9a-f]+)/", 1)
        return rows.withColumn("_attempt", attempt).join(valid, "_attempt", "left_semi").drop("_attempt")
