"""Pages of a result and their metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.operators.volume import page_positions
from postmill.session import scratch_path

DEFAULT_COUNT = 100


def page_results(rows: DataFrame, order: list[Column | str], page: int = 1, count: int = DEFAULT_COUNT) -> DataFrame:
    """One page of ``rows`` in a total ``order``.

    A top-k over partitions, which one task merges: meant for pages near the front. Results
    that are paged through deeply are stored with ``with_positions`` and read with
    ``page_by_position``.
    """
    start, _ = page_positions(page, count)
    return rows.orderBy(*order).offset(start).limit(count)


def page_by_position(ranked: DataFrame, page: int = 1, count: int = DEFAULT_COUNT) -> DataFrame:
    """One page of a stored result with a ``position`` column: a pushed range filter,
    equally cheap for any page."""
    start, end = page_positions(page, count)
    return ranked.where((F.col("position") >= start) & (F.col("position") < end))


def page_meta(rows: DataFrame, event: str, page: int = 1, count: int = DEFAULT_COUNT) -> DataFrame:
    """One row: page size, total, number of pages, page number, rows on the page, status."""
    total = rows.agg(F.count(F.lit(1)).alias("total_count"))
    return meta_columns(total, F.lit(event), page, count)


def meta_columns(totals: DataFrame, event: Column, page: int, count: int) -> DataFrame:
    """Page metadata for each row with a ``total_count``."""
    start, _ = page_positions(page, count)
    total = F.col("total_count")
    return totals.select(
        event.alias("event_name"),
        F.lit(page).cast("bigint").alias("page"),
        F.lit(count).cast("bigint").alias("count"),
        "total_count",
        F.ceil(total / count).alias("num_pages"),
        F.greatest(F.lit(0), F.least(F.lit(count), total - start)).cast("bigint").alias("tweet_count"),
        page_status(total, start).alias("status"),
    )


def page_status(total: Column, start: int) -> Column:
    """``not_found`` without an index, ``out_of_range`` past the end, else ``ok``."""
    return F.when(total == -1, "not_found").when(total < start, "out_of_range").otherwise("ok")


def with_positions(rows: DataFrame, order: list[Column | str], path: str | None = None) -> DataFrame:
    """Rows with a 0-based ``position`` along ``order``, ready for deep paging.

    Sorted by range partitions and written out once, since both later steps must see the
    same partitions; then each row's number inside its partition is added to the rows
    of the partitions before it. Only one count per partition is ever brought together.
    ``path`` is the folder for that, which a job that stores the result can remove after it.
    """
    path = path or scratch_path(rows.sparkSession, "ranked")
    rows.orderBy(*order).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")
    ).write.parquet(path)
    ranked = rows.sparkSession.read.parquet(path)
    sizes = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", "_low", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        ranked.join(F.broadcast(starts), "_part")
        .withColumn("position", F.col("_start") + F.col("_at") - F.col("_low"))
        .drop("_part", "_at", "_low", "_start")
    )
