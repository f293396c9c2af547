"""A bounded sample of labelled documents for training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.rows import find_column, quoted


def fold(id_column, parts: int):
    """The fold of a document: CRC-32 of its id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(id_column.cast("string")), F.lit(parts)).cast("int")


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, most: int, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """(text, label) of at most ``most`` documents outside the held-out fold.

    The sample is the rows with the smallest hashed ids, the same in every run. Rows of
    ``labels`` without id or label do not count; of labels that contradict the larger holds.
    At most ``most`` ids are broadcast.
    """
    ids = quoted(find_column(labels, id_col)).cast("long")
    known = labels.select(ids.alias("_id"), quoted(find_column(labels, label)).cast("int").alias("_label"))
    known = known.where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & (fold(F.col("_id"), parts) != held_out))
    known = known.groupBy("_id").agg(F.max("_label").alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(most)
    own = quoted(find_column(docs, id_col)).cast("long")
    text = docs.select(own.alias("_id"), quoted(find_column(docs, text_col)).cast("string").alias("text"))
    return text.join(F.broadcast(known), "_id").select("text", F.col("_label").alias("label"))
