"""Small expressions on the nested post record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.schema import POST


def is_retweet(retweeted_status: Column | None = None) -> Column:
    """A post that carries the post it repeats."""
    status = F.col("retweeted_status") if retweeted_status is None else retweeted_status
    return status.isNotNull()


def parse_post(value: Column, schema: str = POST) -> Column:
    """Struct of a JSON text; null fields for what is absent or malformed."""
    return F.from_json(value, schema)


def render_post(record: Column) -> Column:
    """JSON text of a struct, null fields left out."""
    return F.to_json(record)
