"""Post times, hour folders, stored-file names and bucket labels (session zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text formats of the data.
CREATED_AT_FORMAT = "EEE MMM dd HH:mm:ss '+0000' yyyy"
HOUR_PATH_FORMAT = "yyyy/MM/dd/HH/"
BUCKET_FORMATS = {
    "hour": "yyyy-MM-dd'T'HH:00:00",
    "day": "yyyy-MM-dd'T'00:00:00",
    "month": "yyyy-MM-'00T00:00:00'",
}
FILE_NAME_PATTERN = r"-(\d+)-(\d+)\.json\.gz$"


def created_ms(created_at: Column) -> Column:
    """Epoch milliseconds of a post's ``created_at`` text; null if it does not parse.

    The weekday is skipped: it carries no information and Spark cannot parse it.
    """
    stamp = F.try_to_timestamp(F.substring(created_at, 5, 26), F.lit("MMM dd HH:mm:ss Z yyyy"))
    return F.unix_millis(stamp)


def created_at(stamp: Column) -> Column:
    """The ``created_at`` text of a timestamp."""
    return F.date_format(stamp, CREATED_AT_FORMAT)


def hour_path(stamp: Column) -> Column:
    """Folder of an hour, ``yyyy/MM/dd/HH/``."""
    return F.date_format(stamp, HOUR_PATH_FORMAT)


def bucket_label(stamp: Column, bucket: str = "hour") -> Column:
    """Text label of the hour, day or month of a timestamp (a month's day reads ``00``)."""
    if bucket not in BUCKET_FORMATS:
        raise ValueError(f"bucket must be one of {sorted(BUCKET_FORMATS)}")
    return F.date_format(stamp, BUCKET_FORMATS[bucket])


def file_name(event: Column, written: Column, rows: Column) -> Column:
    """Name of a stored batch: event, hour folder, write time in ms, row count."""
    base = F.concat(F.lit("tweet-"), F.unix_millis(written).cast("string"), F.lit("-"), rows.cast("string"))
    return F.concat(event, F.lit("/"), hour_path(written), base, F.lit(".json.gz"))


def file_timestamp(filename: Column) -> Column:
    """Write time (ms) read from a stored batch's name; null for other names."""
    return F.regexp_extract(filename, FILE_NAME_PATTERN, 1).try_cast("bigint")


def file_rows(filename: Column) -> Column:
    """Row count read from a stored batch's name; null for other names."""
    return F.regexp_extract(filename, FILE_NAME_PATTERN, 2).try_cast("bigint")
