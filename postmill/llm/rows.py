"""Columns computed from whole texts in Python, with every input column passed through."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Make = Callable[[], Callable[[pa.RecordBatch], list]]


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def find_column(df: DataFrame, name: str) -> str:
    """The column's own spelling; names are compared as Spark does, without case."""
    for have in df.columns:
        if have.lower() == name.lower():
            return have
    raise ValueError(f"no column {name} among {df.columns}")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def add_columns(docs: DataFrame, inputs: dict[str, str], fields: str, make: Make, keep: bool = True) -> DataFrame:
    """``docs`` with the columns ``fields``; a column that already has such a name is replaced.

    ``make`` runs once per task and returns a function from a batch of the ``inputs`` (column ->
    type) to one Arrow array (or list of values) per field. No rows are added, dropped or moved.
    """
    added = T.StructType.fromDDL(fields)
    taken = {f.name.lower() for f in added.fields}
    kept = [f for f in docs.schema.fields if f.name.lower() not in taken] if keep else []
    names = [find_column(docs, name) for name in inputs]
    columns = [quoted(f.name) for f in kept]
    where = []
    for name, kind in zip(names, inputs.values()):
        own = next((i for i, f in enumerate(kept) if f.name == name and f.dataType.simpleString() == kind), None)
        if own is None:
            columns.append(quoted(name).cast(kind).alias(f"_input{len(columns)}"))
            own = len(columns) - 1
        where.append(own)
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in kept), *added.fields])
    n_kept = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            found = apply(pa.RecordBatch.from_arrays([batch.column(i) for i in where], list(inputs)))
            arrays = [batch.column(i) for i in range(n_kept)] + [x if isinstance(x, pa.Array) else pa.array(x) for x in found]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return docs.select(*columns).mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the first row of each group, from rows sorted by the first ``keys`` columns."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        starts = _starts(rest, keys)
        if len(starts) > 1:
            yield rest.slice(0, starts[-1]), starts[:-1]
            rest = rest.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield rest, _starts(rest, keys)


def _starts(table: pa.Table, keys: int) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for i in range(keys):
        values = table.column(i).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)
