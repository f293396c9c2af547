"""Relational tables: Parquet folders or a database behind JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.operators.volume import page_files, page_positions, relative_name
from postmill.schema import TABLES


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table stored as a Parquet folder."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_named(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the relational tables, with its fixed schema, from ``<root>/<name>``."""
    return read_table(spark, f"{root.rstrip('/')}/{name}", TABLES[name])


def jdbc_options(
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    **options,
) -> dict[str, str]:
    """Reader options; with a numeric partition column and its bounds the read is split."""
    out = {"url": url, "dbtable": table, "fetchsize": "10000", **options}
    if partition_column is not None:
        if bounds is None:
            raise ValueError("a partitioned read needs bounds")
        out |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return out


def read_jdbc(spark: SparkSession, url: str, table: str, **kwargs) -> DataFrame:
    """A database table; needs the database's JDBC driver on the class path."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **kwargs)).load()


def stored_files(spark: SparkSession, folders: str | list[str]) -> DataFrame:
    """``filename`` of every file below one or more folders.

    Only file names are asked for, so the binary reader lists without opening files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
    return files.select(F.col("path").alias("filename"))


def landed_files(spark: SparkSession, root: str, glob: str = "*.gz") -> DataFrame:
    """(event, filename, timestamp ms, size) of files landed by batch, names below ``root``.

    Spark names these files, so the row count is counted instead of read from the name.
    """
    lines = read_lines(spark, root, glob)
    return lines.groupBy(
        "event",
        relative_name(F.col("_metadata.file_path"), root).alias("filename"),
        F.unix_millis("_metadata.file_modification_time").alias("timestamp"),
    ).agg(F.count(F.lit(1)).alias("size"))


def read_lines(spark: SparkSession, root: str, glob: str = "*.gz") -> DataFrame:
    """Landed lines with batch, event and hour columns; the folder columns prune the scan."""
    schema = "value string, batch bigint, event string, year string, month string, day string, hour string"
    return spark.read.schema(schema).option("pathGlobFilter", glob).text(root)


def read_page(spark: SparkSession, root: str, index: DataFrame, event: str, page: int = 1, count: int = 100) -> DataFrame:
    """(position, value) of one page of an event's stored posts.

    Only the files that overlap the page are opened. Each of them holds at least one of
    at most ``count`` positions, so the list of names brought to the driver is bounded.
    """
    start, end = page_positions(page, count)
    files = page_files(index, start, end, event).select("filename", "start_index").collect()
    if not files:
        return spark.createDataFrame([], "position bigint, value string")
    offsets = spark.createDataFrame(files, "filename string, start_index bigint")
    lines = spark.read.text([f"{root.rstrip('/')}/{f.filename}" for f in files]).select(
        "value",
        relative_name(F.col("_metadata.file_path"), root).alias("filename"),
        F.monotonically_increasing_id().alias("_at"),
    )
    # A compressed file is read by one task from its first line on, so ids follow its lines.
    in_file = Window.partitionBy("filename").orderBy("_at")
    placed = lines.withColumn("_line", F.row_number().over(in_file) - 1).join(F.broadcast(offsets), "filename")
    position = F.col("start_index") + F.col("_line")
    return (
        placed.select(position.alias("position"), "value")
        .where((F.col("position") >= start) & (F.col("position") < end))
        .orderBy("position")
    )
