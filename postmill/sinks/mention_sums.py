"""Mention sums stored by hour, so that a ranking reads the posts of new hours only.

``<path>/sums/hour=<yyyy-MM-dd-HH>/`` holds the sums of an hour folder's posts per account and name;
``<path>/covered`` says which files they stand for and is written after them. An hour that got more
files since is summed again as a whole and replaces itself, so a run that failed or is
repeated counts nothing twice. One run at a time for an event.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators.mentions import mention_sums, ranking_of
from postmill.operators.volume import file_listing
from postmill.schema import POST
from postmill.session import scratch_folder
from postmill.sources.tables import stored_files

SUMS = "user_id bigint, name string, n bigint, retweets bigint, likes bigint, hour string"
COVERED = "files bigint, newest string, hour string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _replace(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour").parquet(path)


def changed_hours(spark: SparkSession, path: str, landing: str, event: str) -> DataFrame:
    """(hour, files, newest): hour folders of an event whose files are not those that were summed."""
    names = file_listing(stored_files(spark, f"{landing.rstrip('/')}/{event}"), landing)
    hour = F.translate(F.substring(F.col("filename"), F.length("event") + 2, F.lit(len("yyyy/MM/dd/HH"))), "/", "-")
    now = names.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("files"), F.max("filename").alias("newest"))
    return now.join(_read(spark, f"{path}/covered", COVERED), ["hour", "files", "newest"], "left_anti")


def refresh_sums(spark: SparkSession, path: str, landing: str, event: str, schema: str = POST) -> int:
    """Sum the hours that are new or changed; returns their number.

    The names of their folders come to the driver, one for each hour.
    """
    with scratch_folder(spark, "mention-sums") as folder:
        changed_hours(spark, path, landing, event).write.parquet(f"{folder}/changed")
        changed = spark.read.schema("hour string, files bigint, newest string").parquet(f"{folder}/changed")
        hours = [r.hour for r in changed.select("hour").collect()]
        if not hours:
            return 0
        base = f"{landing.rstrip('/')}/{event}"
        posts = spark.read.schema(schema).json([f"{base}/{h.replace('-', '/')}" for h in hours])
        hour = F.translate(F.regexp_extract("_metadata.file_path", r"/(\d{4}/\d{2}/\d{2}/\d{2})/[^/]*$", 1), "/", "-")
        sums = mention_sums(posts.withColumn("hour", hour), "hour")
        _replace(sums.select("user_id", "name", "n", "retweets", "likes", "hour").repartition("hour"), f"{path}/sums")
        _replace(changed.select("files", "newest", "hour").repartition(1), f"{path}/covered")
    return len(hours)


def stored_ranking(spark: SparkSession, path: str, first: str | None = None, last: str | None = None, ordered: bool = True) -> DataFrame:
    """Ranking over the stored hours, or those from ``first`` to ``last`` (``yyyy-MM-dd-HH``), whose folders alone are read."""
    sums = _read(spark, f"{path}/sums", SUMS)
    if first is not None:
        sums = sums.where(F.col("hour") >= first)
    if last is not None:
        sums = sums.where(F.col("hour") <= last)
    return ranking_of(sums, ordered)
