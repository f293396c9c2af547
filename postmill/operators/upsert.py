"""Keyed insert-or-ignore, keyed first row, and existence checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ascending ``order`` (should be a total order).

    A minimum over (order, row) is kept per key inside every map task already, so a key
    with any share of the rows reaches its reducer as one row per task; a row number
    would send the whole group through one sort.
    """
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return best.select(*[F.col(k) if k in keys else F.col(f"_first.{k}").alias(k) for k in rows.columns])


def new_rows(
    target: DataFrame, batch: DataFrame, keys: list[str], order: list[str] | None = None, unique: bool = False
) -> DataFrame:
    """Batch rows to append to ``target``: those whose key it lacks, one per key.

    Of batch rows with the same key the first in ``order`` wins; ``unique=True`` says the
    batch has one row per key. Rows with a null in the key never conflict.
    """
    if not unique:
        order = order or [c for c in batch.columns if c not in keys]
        no_key = F.lit(False)
        for k in keys:
            no_key = no_key | F.col(k).isNull()
        keyed = first_per_key(batch.where(~no_key), keys, order)
        batch = keyed.unionByName(batch.where(no_key))
    return batch.join(target.select(*keys), keys, "left_anti").select(*target.columns)


def insert_or_ignore(
    target: DataFrame, batch: DataFrame, keys: list[str], order: list[str] | None = None, unique: bool = False
) -> DataFrame:
    """State of ``target`` after appending its ``new_rows``."""
    return target.unionByName(new_rows(target, batch, keys, order, unique))


def exists_flags(wanted: DataFrame, table: DataFrame, keys: list[str], name: str = "found") -> DataFrame:
    """``wanted`` with a flag that says whether the table has a row with the key."""
    present = table.select(*keys).distinct().withColumn(name, F.lit(True))
    return wanted.join(present, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))
