"""File-offset index, counts per time bucket, totals and page lookups.

The index has one row per stored file: (event, filename, timestamp ms, start_index,
end_index), offsets running over an event's files in name order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.times import bucket_label, file_rows, file_timestamp

INDEX_COLUMNS = ["event", "filename", "timestamp", "start_index", "end_index"]


def relative_name(path: Column, root: str) -> Column:
    """A full file path without the ``root`` folder in front, whatever way both are spelled."""
    plain = F.regexp_replace(path, r"^file:/*", "/")
    folder = re.sub(r"^file:/*", "/", root).rstrip("/") + "/"
    return F.when(plain.startswith(folder), F.substring(plain, F.lit(len(folder) + 1), F.length(plain))).otherwise(path)


def file_listing(files: DataFrame, root: str | None = None) -> DataFrame:
    """(event, filename, timestamp, size) parsed from a column of stored file names.

    Only ``.json.gz`` names with a write time and a row count are kept. ``root`` is cut
    from the front of full paths; the event is the first folder of what remains.
    """
    name = F.col("filename") if root is None else relative_name(F.col("filename"), root)
    parsed = files.select(name.alias("filename")).select(
        F.substring_index("filename", "/", 1).alias("event"),
        "filename",
        file_timestamp(F.col("filename")).alias("timestamp"),
        file_rows(F.col("filename")).alias("size"),
    )
    return parsed.where(F.col("timestamp").isNotNull() & F.col("size").isNotNull())


def running_start(
    rows: DataFrame, key: list[str], order: list[str], levels: list[Column], value: str, name: str
) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the key before this one.

    ``levels`` are bucket expressions, coarse to fine, that never decrease along
    ``order``. Each window runs inside one bucket of the level above over the totals of
    the level below, so a key with most of the rows is spread over its buckets and no
    task sorts it whole.
    """
    buckets = [f"_b{i}" for i in range(len(levels))]
    rows = rows.select("*", *[c.alias(b) for c, b in zip(levels, buckets)])
    starts = None
    totals = rows.groupBy(*key, *buckets).agg(F.sum(value).alias("_sum"))
    tables = [totals]
    for depth in range(len(buckets) - 1, 0, -1):
        tables.insert(0, tables[0].groupBy(*key, *buckets[:depth]).agg(F.sum("_sum").alias("_sum")))
    for depth, table in enumerate(tables):
        above, here = [*key, *buckets[:depth]], buckets[depth]
        window = _before(above, [here])
        step = table.withColumn("_before", F.coalesce(F.sum("_sum").over(window), F.lit(0))).drop("_sum")
        if starts is not None:
            step = step.join(starts, above).withColumn("_before", F.col("_before") + F.col("_outer")).drop("_outer")
        starts = step.withColumnRenamed("_before", "_outer")
    keys = [*key, *buckets]
    inside = F.coalesce(F.sum(value).over(_before(keys, order)), F.lit(0))
    return (
        rows.withColumn(name, inside)
        .join(starts, keys)
        .withColumn(name, F.col(name) + F.col("_outer"))
        .drop("_outer", *buckets)
    )


def _before(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def file_levels() -> list[Column]:
    """Buckets along stored file names: day folder, then name up to the write second.

    A prefix of fixed length never decreases along sorted names, and names of one event
    share the length of everything before the write time.
    """
    in_event = F.length("event") + 1
    return [
        F.substring(F.col("filename"), F.lit(1), in_event + len("yyyy/MM/dd/")),
        F.substring(F.col("filename"), F.lit(1), in_event + len("yyyy/MM/dd/HH/tweet-") + 10),
    ]


def batch_levels() -> list[Column]:
    """Buckets along the names of files landed by batch: ten thousand batches, one batch."""
    return [F.substring("filename", 1, len("batch=") + 8), F.substring("filename", 1, len("batch=") + 12)]


def file_offsets(listing: DataFrame, levels: list[Column] | None = None) -> DataFrame:
    """Offset index of a complete listing, from zero per event."""
    rows = running_start(listing, ["event"], ["filename"], levels or file_levels(), "size", "start_index")
    return _index(rows)


def _index(rows: DataFrame) -> DataFrame:
    return rows.withColumn("end_index", F.col("start_index") + F.col("size")).select(*INDEX_COLUMNS)


def latest_files(index: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` last files per event; Spark trims each task's groups before the shuffle."""
    window = Window.partitionBy("event").orderBy(F.desc("filename"))
    return index.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).drop("_rank")


def index_refresh(index: DataFrame, listing: DataFrame, levels: list[Column] | None = None) -> DataFrame:
    """New index state after looking at the current file listing.

    Files that the index lacks are added wherever their names fall: from an event's lowest
    new name on, offsets are worked out again, going on from the rows before it. Indexed
    files keep their sizes and need not be listed again, so a listing of some folders only
    loses nothing.
    """
    added = listing.join(index.select("event", "filename"), ["event", "filename"], "left_anti")
    added = added.select("event", "filename", "timestamp", "size").distinct()
    low = added.groupBy("event").agg(F.min("filename").alias("_low"))
    # The new files may be few or all; the rows of events without any pass through the join.
    marked = index.select(*INDEX_COLUMNS).join(low, "event", "left")
    before = F.col("_low").isNull() | (F.col("filename") < F.col("_low"))
    kept = marked.where(before)
    bases = kept.where(F.col("_low").isNotNull()).groupBy("event").agg(F.max("end_index").alias("_base"))
    size = (F.col("end_index") - F.col("start_index")).alias("size")
    redone = marked.where(~before).select("event", "filename", "timestamp", size).unionByName(added)
    placed = running_start(redone, ["event"], ["filename"], levels or file_levels(), "size", "start_index")
    placed = placed.join(bases, "event", "left")
    placed = placed.withColumn("start_index", F.col("start_index") + F.coalesce("_base", F.lit(0)))
    return kept.select(*INDEX_COLUMNS).unionByName(_index(placed))


def event_totals(index: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Posts per event: the highest end offset; -1 for listed events without any file."""
    totals = index.groupBy("event").agg(F.max("end_index").alias("total_count"))
    if events is None:
        return totals
    wanted = events.select("event").distinct()
    return wanted.join(totals, "event", "left").withColumn(
        "total_count", F.coalesce("total_count", F.lit(-1))
    )


def bucket_counts(
    index: DataFrame, bucket: str = "hour", event: str | None = None, time: str = "timestamp"
) -> DataFrame:
    """Posts per event and hour, day or month of the files' write time, ascending.

    ``time`` names another column of epoch milliseconds to count by.
    """
    if event is not None:
        index = index.where(F.col("event") == event)
    stamp = F.timestamp_seconds(F.floor(F.col(time) / 1000))
    counts = index.groupBy("event", bucket_label(stamp, bucket).alias("time")).agg(
        F.sum(F.col("end_index") - F.col("start_index")).alias("count")
    )
    return counts.orderBy("event", "time")


def page_files(index: DataFrame, start: int, end: int, event: str | None = None) -> DataFrame:
    """Files holding any of the positions ``start`` to ``end`` - 1, in order.

    The interval test reaches the scan of a stored index as pushed filters.
    """
    if event is not None:
        index = index.where(F.col("event") == event)
    return _overlapping(index, start, end).orderBy("event", "start_index")


def _overlapping(index: DataFrame, start: int, end: int) -> DataFrame:
    overlap = (F.col("start_index") < end) & (F.col("end_index") > start)
    return index.where(overlap & (F.col("end_index") > F.col("start_index")))


def page_positions(page: int, count: int) -> tuple[int, int]:
    """(first, past-the-last) position of a 1-based page."""
    if page < 1 or not 1 <= count <= 1000:
        raise ValueError("page starts at 1, count is 1..1000")
    return (page - 1) * count, page * count


def page_posts(
    posts: DataFrame, index: DataFrame, order: list[str], levels: list[Column], page: int, count: int
) -> DataFrame:
    """The posts of one page of every event, with their global ``position``.

    ``posts`` carries event and filename; ``order`` is the order inside a file and
    ``levels`` are buckets along it. Only files that overlap the page are kept before
    anything is numbered, and the buckets spread a file of any size over many tasks.
    """
    start, end = page_positions(page, count)
    files = _overlapping(index, start, end).select("event", "filename", "start_index")
    near = posts.join(files, ["event", "filename"]).withColumn("_one", F.lit(1))
    placed = running_start(near, ["event", "filename"], order, levels, "_one", "_line")
    position = F.col("start_index") + F.col("_line")
    return (
        placed.withColumn("position", position)
        .where((F.col("position") >= start) & (F.col("position") < end))
        .drop("start_index", "_one", "_line")
    )
