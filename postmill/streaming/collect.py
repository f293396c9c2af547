"""Collecting a post stream: sources and sinks, live rules, hourly landing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from postmill.operators.routing import route_sets
from postmill.schema import TOPICS
from postmill.session import shuffles_dropped

ROWS_PER_FILE = 1000
# Lines are compressed twice on their way, which at the usual level takes most of the time.
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
HOUR_PARTITIONS = ["event", "year", "month", "day", "hour"]


def kafka_source(spark: SparkSession, servers: str, match_key: str, **options) -> DataFrame:
    """Stream of raw posts (``value``) from the topic of a match key.

    Progress lives in the query's checkpoint, not in a consumer group. Needs the Kafka
    connector on the class path.
    """
    stream = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", TOPICS[match_key])
        .options(**options)
        .load()
    )
    return stream.select(F.col("value").cast("string").alias("value"))


def file_source(spark: SparkSession, path: str, files_per_batch: int | None = None, crlf: bool = False) -> DataFrame:
    """Stream of raw lines (``value``) from files arriving in a folder."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if crlf:
        reader = reader.option("lineSep", "\r\n")
    return reader.load(path).where(F.length("value") > 0)


def kafka_sink(lines: DataFrame, servers: str, topic: str, checkpoint: str) -> DataStreamWriter:
    """Writer of raw lines to a topic: no key, the line as value."""
    return (
        lines.select(F.lit(None).cast("string").alias("key"), "value")
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )


def file_sink(lines: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writer of raw lines to text files, each line exactly once."""
    return (
        lines.select("value")
        .writeStream.format("text")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )


def hour_columns(posts: DataFrame, now: Column) -> DataFrame:
    """Adds year, month, day and hour folder columns of a clock column."""
    parts = {"year": "yyyy", "month": "MM", "day": "dd", "hour": "HH"}
    return posts.withColumns({name: F.date_format(now, fmt) for name, fmt in parts.items()})


def write_hourly(routed: DataFrame, path: str, now: Column, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write routed lines as gzip NDJSON by event and hour, replacing what ``path`` holds.

    Lines have one ``event`` or several ``events``. The rebalance gives each event, or each
    set of events that lines share, few, evenly filled tasks and splits a busy one; a line of
    several events is moved once and multiplied after it.
    """
    key = "events" if "events" in routed.columns else "event"
    moved = routed.select(key, "value").hint("rebalance", key)
    if key == "events":
        moved = moved.select(F.explode("events").alias("event"), "value")
    with shuffles_dropped(routed.sparkSession):
        (
            hour_columns(moved, now)
            .write.mode("overwrite")
            .partitionBy(*HOUR_PARTITIONS)
            .options(**GZIP)
            .option("maxRecordsPerFile", rows_per_file)
            .text(path)
        )


def collect_posts(
    lines: DataFrame,
    rules: Callable[[SparkSession], DataFrame] | DataFrame,
    root: str,
    checkpoint: str,
    now: Callable[[], Column] = F.current_timestamp,
    rows_per_file: int = ROWS_PER_FILE,
) -> DataStreamWriter:
    """Writer that routes each micro-batch by the rules of that moment and lands it.

    A batch owns the folder ``batch=<id>``: a batch that is run again after a failure
    overwrites its own output, and the checkpoint moves on only after the write, so every
    post is landed exactly once. A callable ``rules`` is read anew for each batch.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        current = rules(batch.sparkSession) if callable(rules) else rules
        write_hourly(route_sets(batch, current), f"{root}/batch={batch_id:012d}", now(), rows_per_file)

    return lines.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)


def drain(writer: DataStreamWriter) -> StreamingQuery:
    """Run a stream over all that is there now, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
