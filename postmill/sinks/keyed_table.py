"""Insert-or-ignore into tables stored in buckets by key.

A batch is dealt to the buckets of the target and joined with them where they lie, so the target
is read but never shuffled, however large it grows. Rows with a null in the key never conflict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postmill.operators.upsert import new_rows


def create_keyed(rows: DataFrame, name: str, keys: list[str], buckets: int, path: str | None = None) -> None:
    """A catalogue table of ``rows`` (one per key) in ``buckets`` buckets, below ``path`` if given."""
    _append(rows, name, keys, buckets, path)


def insert_new(
    spark: SparkSession, name: str, batch: DataFrame, keys: list[str], buckets: int, order: list[str] | None = None, path: str | None = None
) -> None:
    """Append the batch rows whose key the table lacks, one per key, the first in ``order``.

    The append is one commit: a batch that failed leaves nothing, and one that is repeated finds its keys.
    """
    _append(pending(spark, name, batch, keys, order), name, keys, buckets, path)


def pending(spark: SparkSession, name: str, batch: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The rows that ``insert_new`` would append. The batch may be larger than the target: it is not broadcast."""
    return new_rows(spark.table(name).hint("merge"), batch, keys, order)


def _append(rows: DataFrame, name: str, keys: list[str], buckets: int, path: str | None) -> None:
    writer = rows.repartition(buckets, *keys).write.mode("append").bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(name)
