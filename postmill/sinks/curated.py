"""Curated posts: the landed JSON as Parquet that search filters can skip through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.times import created_ms
from postmill.operators.predicates import PostQuery

MONTH = "yyyy-MM"


def curate(posts: DataFrame) -> DataFrame:
    """Adds ``created_ms`` and its UTC ``month``; both null if the time does not parse."""
    return posts.withColumn("created_ms", created_ms(F.col("created_at"))).withColumn(
        "month", F.date_format(F.timestamp_millis("created_ms"), MONTH)
    )


def write_curated(posts: DataFrame, path: str, mode: str = "append") -> None:
    """Write posts by month, each file a contiguous stretch of time.

    The range partitioning evens out busy and quiet times, keeps the number of files
    small and lets the files' time statistics skip what a search does not need.
    """
    (
        curate(posts)
        .repartitionByRange("created_ms")
        .sortWithinPartitions("created_ms")
        .write.mode(mode)
        .partitionBy("month")
        .parquet(path)
    )


def month_range(start_ms: int, end_ms: int) -> Column | None:
    """Partition filter that goes with a time range; None if both ends are open.

    It follows from the range on ``created_ms``, so it never changes a result.
    """

    def month(ms: int) -> Column:
        return F.date_format(F.timestamp_millis(F.lit(ms)), MONTH)

    condition = F.col("month") >= month(start_ms) if start_ms else None
    if end_ms:
        upper = F.col("month") <= month(end_ms)
        condition = upper if condition is None else condition & upper
    return condition


def search_curated(posts: DataFrame, query: PostQuery, **columns) -> DataFrame:
    """``query`` over curated posts: months pruned, time and language pushed to the scan."""
    months = month_range(query.start_ms, query.end_ms)
    if months is not None:
        posts = posts.where(months)
    return query.apply(posts, ms=F.col("created_ms"), **columns)
