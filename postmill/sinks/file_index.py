"""File-offset index that grows with new files: one part per event and day, offsets counted from the part.

A file that comes late moves the positions of all later files of its event, but only its own
part is written again: where a part begins is the sum of the rows of the parts before it, taken
from the stored sizes when the index is read. A refresh therefore reads the parts from the first
listed day on and writes the days that got files, however long the index is.

Parts are replaced whole and each is right by itself, so a refresh that failed half-way is
completed by the next one. One refresh at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.operators.volume import INDEX_COLUMNS, running_start
from postmill.session import scratch_folder

PARTS = "filename string, timestamp bigint, size bigint, start_index bigint, event string, part string"
KEY = ["event", "part"]


def part_of(filename: Column, event: Column) -> Column:
    """The day folder of a stored file; a prefix of fixed length never decreases along sorted names."""
    return F.translate(F.substring(filename, F.length(event) + 2, F.lit(len("yyyy/MM/dd"))), "/", "-")


def hour_level() -> list[Column]:
    """Buckets along the names of one day: the hour folder, then the write second."""
    in_event = F.length("event") + 1
    return [F.substring(F.col("filename"), F.lit(1), in_event + n) for n in (len("yyyy/MM/dd/HH/"), len("yyyy/MM/dd/HH/tweet-") + 10)]


def _parts(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(PARTS).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PARTS)


def refresh_parts(spark: SparkSession, path: str, listing: DataFrame, levels: list[Column] | None = None) -> int:
    """Add the files of ``listing`` (event, filename, timestamp, size) that the index lacks; returns their number.

    Indexed files keep their sizes and need not be listed again.
    """
    listed = listing.select("event", "filename", "timestamp", "size", part_of(F.col("filename"), F.col("event")).alias("part"))
    with scratch_folder(spark, "file-index") as folder:
        listed.dropDuplicates(["event", "filename"]).write.parquet(f"{folder}/listed")
        listed = spark.read.parquet(f"{folder}/listed")
        first = listed.agg(F.min("part").alias("low")).first().low
        # Days before the first one listed are not even opened.
        index = _parts(spark, path).where(F.col("part") >= F.lit(first))
        added = listed.join(index.select(*KEY, "filename"), [*KEY, "filename"], "left_anti")
        added.write.parquet(f"{folder}/added")
        added = spark.read.schema(listed.schema).parquet(f"{folder}/added")
        count, low = added.agg(F.count(F.lit(1)), F.min("part")).first()
        if not count:
            return 0
        touched = index.where(F.col("part") >= F.lit(low)).join(added.select(*KEY).distinct(), KEY, "left_semi")
        rows = touched.select(*KEY, "filename", "timestamp", "size").unionByName(added)
        placed = running_start(rows, KEY, ["filename"], levels or hour_level(), "size", "start_index")
        placed.select("filename", "timestamp", "size", "start_index", *KEY).write.parquet(f"{folder}/parts")
        whole = spark.read.schema(PARTS).parquet(f"{folder}/parts").repartition(*KEY).sortWithinPartitions(*KEY, "filename")
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEY).parquet(path)
    return count


def read_index(spark: SparkSession, path: str, events: list[str] | None = None) -> DataFrame:
    """The index with offsets from zero per event; only the folders of ``events`` are read."""
    parts = _parts(spark, path)
    if events is not None:
        parts = parts.where(F.col("event").isin(events))
    before = Window.partitionBy("event").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per event and day.
    starts = parts.groupBy(*KEY).agg(F.sum("size").alias("rows"))
    starts = starts.select(*KEY, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    placed = parts.join(starts, KEY).withColumn("start_index", F.col("base") + F.col("start_index"))
    return placed.withColumn("end_index", F.col("start_index") + F.col("size")).select(*INDEX_COLUMNS)
