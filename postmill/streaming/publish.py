"""Landed micro-batches as stored files: ``EVENT/yyyy/MM/dd/HH/tweet-<ms>-<rows>.json.gz``.

The collector lands every micro-batch at once, in files as small as the batch. Publishing
gathers all batches since the last run, so files fill up over many batches, and gives them
the names that listings, counts, pages and timelines read.

A run is divided into at most about ``2 * PARTS`` parts, by the size of the landed files: an
hour of an event that is large enough is a part by itself, whose lines need no shuffle; the
others are dealt to parts by hash. So a run needs no room for a shuffle of all lines, and
with ``keep_landed=False`` landed files go part by part, as soon as they are published.

Each part first writes its files to a folder that readers skip, then a plan of all moves, and
moves the files last. A run that failed is tried again with the same ``run_ms`` and the same
parts: before its plan a part starts over, after it the moves that are missing are made. So
every line is published once. One run at a time.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from postmill.functions.times import HOUR_PATH_FORMAT, file_name
from postmill.operators.volume import relative_name
from postmill.session import shuffles_dropped
from postmill.sinks.snapshots import SnapshotStore
from postmill.sources.tables import read_lines, stored_files
from postmill.streaming.collect import GZIP, HOUR_PARTITIONS, ROWS_PER_FILE

PLAN = "source string, target string, rows bigint"
BATCHES = "last_batch bigint"
RUN = f"first_batch bigint, {BATCHES}"
HOURS = ", ".join(f"{c} string" for c in HOUR_PARTITIONS)
DIVIDED = f"part string, deals bigint, bytes bigint, source string, {HOURS}"
JOB = "published"
# Landed bytes of a part: these, or the run's divided by PARTS if that is more.
PART_BYTES = 64 << 20
PARTS = 32
# Landed bytes of a task of an hour that is a part by itself, and the least where cores would be
# idle; each task leaves one file unfilled.
TASK_BYTES, LEAST_TASK_BYTES = 16 << 20, 8 << 20
# Renames under way at once; each waits for the file system.
MOVERS = 32


def publish_landed(
    spark: SparkSession, landing: str, root: str, run_ms: int, rows_per_file: int = ROWS_PER_FILE, keep_landed: bool = True
) -> int:
    """Publish the batches that landed since the last run; returns the number of files.

    Without ``keep_landed`` the landed files that are published are removed.
    """
    store, run = SnapshotStore(spark, f"{root.rstrip('/')}/_publish"), f"run-{run_ms}"
    _files(spark, root).mkdirs(_path(spark, root))
    if store.latest_run(JOB, run) is None:
        first, last = _new_batches(spark, store, landing)
        if last is None:
            return 0
        store.write(spark.createDataFrame([(first, last)], RUN), JOB, run, run_ms)
    batches = store.latest(JOB, run, schema=RUN).first()
    if store.latest_run("parts", run) is None:
        store.write(_divide(spark, landing, batches.first_batch, batches.last_batch), "parts", run, run_ms)
    divided = store.latest("parts", run, schema=DIVIDED)
    hour = F.min(F.struct(*HOUR_PARTITIONS)).alias("hour")
    parts = divided.groupBy("part", "deals").agg(F.sum("bytes").alias("bytes"), hour).orderBy("part").collect()
    large, lines, count = [p.part for p in parts if "/" in p.part], None, 0
    for number, part in enumerate(parts):
        if store.latest_run("plan", f"{run}-{number}") is None:
            staging = f"{root.rstrip('/')}/_staging/{uuid.uuid4().hex}"
            # Listed once, and only while landed files are there.
            if lines is None:
                lines = read_lines(spark, landing).where(F.col("batch").between(batches.first_batch + 1, batches.last_batch))
            held = lines.where(_part(large, part.deals) == part.part)
            alone = part if part.part in large else None
            _gather(held, staging, rows_per_file, alone)
            store.write(_plan(spark, root, staging, alone.part if alone else ""), "plan", f"{run}-{number}", run_ms)
        count += _move(spark, store.latest("plan", f"{run}-{number}", schema=PLAN), root)
        if not keep_landed:
            _remove(spark, divided.where(F.col("part") == part.part), landing)
    # Only now does the next run begin after these batches.
    store.write(store.latest(JOB, run, schema=BATCHES), JOB, "all", run_ms)
    return count


def _new_batches(spark: SparkSession, store: SnapshotStore, landing: str) -> tuple[int, int | None]:
    """(last batch published before, last batch landed); names only, no file is opened."""
    done = -1
    if store.latest_run(JOB, "all") is not None:
        done = store.latest(JOB, "all", schema=BATCHES).first().last_batch
    batch = F.regexp_extract("filename", r"/batch=(\d+)/", 1).try_cast("bigint")
    last = stored_files(spark, landing).where(F.col("filename").endswith(".gz")).agg(F.max(batch).alias("last")).first().last
    return done, last if last is not None and last > done else None


def _part(large: list[str], deals: int) -> Column:
    """The part of an hour of an event: its own, or one of the ``deals`` that the small ones are dealt to."""
    folder = F.concat_ws("/", *HOUR_PARTITIONS)
    return F.when(folder.isin(large), folder).otherwise(F.pmod(F.xxhash64(*HOUR_PARTITIONS), F.lit(deals)).cast("string"))


def _divide(spark: SparkSession, landing: str, first: int, last: int) -> DataFrame:
    """The run's landed folders with their part; at most ``PARTS`` hours, those of parts by themselves, come to the driver."""
    schema = f"path string, modificationTime timestamp, length bigint, content binary, batch bigint, {HOURS}"
    files = spark.read.schema(schema).option("pathGlobFilter", "*.gz").format("binaryFile").load(landing)
    source = F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("source")
    new = files.where((F.col("batch") > first) & (F.col("batch") <= last)).select("length", source, *HOUR_PARTITIONS)
    held = new.groupBy("source", *HOUR_PARTITIONS).agg(F.sum("length").alias("bytes"))
    total = held.agg(F.sum("bytes")).first()[0] or 0
    least = max(PART_BYTES, total // PARTS)
    hours = held.groupBy(*HOUR_PARTITIONS).agg(F.sum("bytes").alias("bytes"))
    large = hours.where((F.col("bytes") >= least) & F.col("event").isNotNull()).select(F.concat_ws("/", *HOUR_PARTITIONS), "bytes").collect()
    deals = max(1, -(-(total - sum(n for _, n in large)) // least))
    part = _part([folder for folder, _ in large], deals)
    return held.select(part.alias("part"), F.lit(deals).cast("bigint").alias("deals"), "bytes", "source", *HOUR_PARTITIONS)


def _gather(lines: DataFrame, staging: str, rows_per_file: int, alone: Row | None = None) -> None:
    """Write a part's lines by event and hour; those of one large hour, ``alone``, as they are read."""
    if alone:
        # Constant columns need no sort before the write.
        dealt = lines.select("value", *[F.lit(alone.hour[c]).alias(c) for c in HOUR_PARTITIONS])
        cores = lines.sparkSession.sparkContext.defaultParallelism
        dealt = dealt.coalesce(max(1, alone.bytes // TASK_BYTES, min(cores, alone.bytes // LEAST_TASK_BYTES)))
    else:
        dealt = lines.select("value", *HOUR_PARTITIONS).hint("rebalance", *HOUR_PARTITIONS)
    with shuffles_dropped(lines.sparkSession):
        dealt.write.partitionBy(*HOUR_PARTITIONS).options(**GZIP).option("maxRecordsPerFile", rows_per_file).text(staging)


def _plan(spark: SparkSession, root: str, staging: str, only: str = "") -> DataFrame:
    """Source, target and rows of every file; write times follow those of the files already there.

    Of stored files those below the folder ``only`` are listed, for files that all go there.
    """
    present = f"{root.rstrip('/')}/{only}"
    _files(spark, root).mkdirs(_path(spark, present))
    path = F.col("_metadata.file_path")
    schema = "value string, event string, year string, month string, day string, hour string"
    files = spark.read.schema(schema).text(staging).groupBy(path.alias("source"), *HOUR_PARTITIONS).agg(F.count(F.lit(1)).alias("rows"))
    hour = F.to_timestamp(F.concat_ws("/", "year", "month", "day", "hour"), HOUR_PATH_FORMAT.rstrip("/"))
    folder = F.concat_ws("/", "event", "year", "month", "day", "hour")
    present = stored_files(spark, present).select(relative_name(F.col("filename"), root).alias("name"))
    present = present.groupBy(F.regexp_extract("name", "^(.*)/[^/]*$", 1).alias("_folder")).agg(F.count(F.lit(1)).alias("_present"))
    place = F.row_number().over(Window.partitionBy(*HOUR_PARTITIONS).orderBy("source")) - 1
    placed = files.select("source", "rows", "event", hour.alias("_hour"), folder.alias("_folder"), place.alias("_place"))
    placed = placed.join(present, "_folder", "left")
    # One millisecond per file keeps write times inside their hour and names apart.
    written = F.timestamp_millis(F.unix_millis("_hour") + F.coalesce("_present", F.lit(0)) + F.col("_place"))
    return placed.select("source", file_name(F.col("event"), written, F.col("rows")).alias("target"), "rows")


def _path(spark: SparkSession, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def _files(spark: SparkSession, root: str):
    return _path(spark, root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _move(spark: SparkSession, moves: DataFrame, root: str) -> int:
    """Rename every staged file that is still there, many at a time.

    A file costs one call to the file system; file names alone come to the driver, a stretch at a time.
    """
    files, count, made = _files(spark, root), 0, set()
    # Looked up once: every step of a dotted name asks the JVM.
    path, rename = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, files.rename

    def move(row) -> None:
        source, cause = path(row.source), None
        try:
            moved = rename(source, path(f"{root.rstrip('/')}/{row.target}"))
        except Py4JJavaError as error:
            moved, cause = False, error
        # A file that is not there any more was moved by the run before.
        if not moved and files.exists(source):
            raise OSError(f"cannot move {row.source} to {row.target}") from cause

    rows = moves.toLocalIterator()
    with ThreadPoolExecutor(MOVERS) as pool:
        while stretch := list(islice(rows, MOVERS * 256)):
            for folder in {row.target.rpartition("/")[0] for row in stretch} - made:
                files.mkdirs(path(f"{root.rstrip('/')}/{folder}"))
                made.add(folder)
            count += sum(1 for _ in pool.map(move, stretch))
    return count


def _remove(spark: SparkSession, divided: DataFrame, landing: str) -> None:
    """Remove a part's landed folders, a stretch of their names at a time."""
    files, rows = _files(spark, landing), divided.select("source").toLocalIterator()
    path, delete = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, files.delete
    with ThreadPoolExecutor(MOVERS) as pool:
        while stretch := list(islice(rows, MOVERS * 256)):
            list(pool.map(lambda row: delete(path(row.source), True), stretch))
