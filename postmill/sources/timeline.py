"""Readers of landed posts: one event's timeline, tolerant and quarantining imports,
and raw feeds framed into lines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.posts import parse_post
from postmill.schema import POST
from postmill.sources.tables import read_lines

CORRUPT = "_corrupt_record"


def read_timeline(
    spark: SparkSession, root: str, event: str, schema: str | None = POST, **options
) -> DataFrame:
    """All posts of an event: every file five levels below its folder.

    ``schema=None`` infers the schema at the price of a second pass.
    """
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(f"{root.rstrip('/')}/{event}/*/*/*/*/*")


def read_collected(spark: SparkSession, root: str, event: str, schema: str = POST) -> DataFrame:
    """Posts of an event as landed by the stream collector; the event's folders only."""
    lines = read_lines(spark, root).where(F.col("event") == event)
    return lines.select(parse_post(F.col("value"), schema).alias("post")).select("post.*")


def read_tolerant(
    spark: SparkSession, paths: str | Sequence[str], schema: str | None = POST
) -> DataFrame:
    """Posts of NDJSON files below ``paths``; bad rows and unknown fields are dropped.

    Every row is parsed whole before it is judged, so which rows remain does not depend on
    the columns that a query asks for.
    """
    found = paths if isinstance(paths, str) else list(paths)
    files = spark.read.option("recursiveFileLookup", "true")
    if schema is None:
        inferred = files.option("mode", "DROPMALFORMED").json(found).schema
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inferred.fields)
    return _flagged(files.text(found), schema).where(~F.col("malformed")).select("post.*")


def register_event_table(
    spark: SparkSession, root: str, normalized_name: str, schema: str | None = POST
) -> str:
    """Make an event's landed files queryable by SQL; an existing view is kept.

    Returns the view's name, the normalized name with ``-`` as ``_``.
    """
    name = normalized_name.replace("-", "_")
    if not spark.catalog.tableExists(name):
        read_tolerant(spark, f"{root.rstrip('/')}/{normalized_name}", schema).createOrReplaceTempView(name)
    return name


def read_quarantined(
    spark: SparkSession, paths: str | Sequence[str], schema: str = POST
) -> tuple[DataFrame, DataFrame]:
    """(good posts, bad lines as ``value``): malformed lines are set apart, not dropped."""
    flagged = read_flagged(spark, paths, schema)
    return flagged.where(~F.col("malformed")).select("post.*"), flagged.where("malformed").select("value")


def read_flagged(spark: SparkSession, paths: str | Sequence[str], schema: str = POST) -> DataFrame:
    """(value, post, malformed) of every line that is not blank, good and bad in one pass."""
    return _flagged(spark.read.text(paths if isinstance(paths, str) else list(paths)), schema)


def _flagged(lines: DataFrame, schema: str) -> DataFrame:
    # With options given Spark parses all fields, whatever is selected later.
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = lines.where(F.trim("value") != "").select(
        "value", F.from_json("value", f"{schema}, {CORRUPT} string", options).alias("post")
    )
    bad = F.col("post").isNull() | F.col(f"post.{CORRUPT}").isNotNull()
    return parsed.select("value", F.col("post").dropFields(CORRUPT).alias("post"), bad.alias("malformed"))


def read_framed(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines (``value``) of a raw feed: framed by CR LF, keep-alive blank lines left out."""
    return framed_lines(spark.read.option("lineSep", "\r\n").text(paths if isinstance(paths, str) else list(paths)))


def framed_lines(lines: DataFrame) -> DataFrame:
    """Drop the empty keep-alive lines; also for a stream of lines."""
    return lines.where(F.length("value") > 0)


def union_partitions(parts: Sequence[DataFrame]) -> DataFrame:
    """The partitions of one feed as one feed."""
    return reduce(DataFrame.unionByName, parts)


