"""Embedding near-dedup: tiles of vectors compared in the order of their principal axes.

Equal vectors are one. The second moments of all unit vectors give the axes. Vectors are
sorted into tiles along the first axis; two tiles meet unless their ranges are too far apart
for the threshold. Inside a pair of tiles products are summed over the leading axes first;
the rest is bounded by the product of the suffix norms, and pairs whose bound is below the
threshold are done with. The others are decided by the cosine in double precision.

A pair of tiles returns per vector the number of its links and one edge to the smallest id of
its local component, so rows grow with vectors and tiles, not with the links of a group. Each
task holds two tiles of about ``tile`` vectors.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and
rows with a null id, link with nothing; vectors of different lengths do not link; rows with
one id are one node of the graph; an empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.components import components, local_roots
from postmill.llm.rows import find_column, quoted
from postmill.session import scratch_path

TILE = 4096
LEADING = (16, 32)
SLACK = 1e-4  # above the rounding of single precision
JITTER = 1e-6  # parts vectors that are equal along the first axis


def unit_matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of length one, lengths of the vectors); shorter vectors end in zeros."""
    size = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    # Scaled first, so that squares of very large or small components stay finite.
    out /= np.maximum(np.abs(out).max(axis=1, keepdims=True, initial=0), np.finfo(float).tiny)
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), np.finfo(float).tiny), size


def principal_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Axes (columns) by falling weight, from the second moments of all unit vectors."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            unit, _ = unit_matrix(batch.column(0), width)
            total += unit.T @ unit
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["at", "value"])

    sums = vectors.select("embedding").mapInArrow(moments, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    total = np.zeros(width * width)
    for row in sums.collect():
        total[row["at"]] = row["value"]
    _, axes = np.linalg.eigh(total.reshape(width, width))
    return axes[:, ::-1].copy()


def linked_pairs(left: np.ndarray, right: np.ndarray, axes: np.ndarray, threshold: float, leading=LEADING) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of ``left``, rows of ``right``) with cosine of at least ``threshold``."""
    width = left.shape[1]
    stages = [d for d in leading if d < width]
    turned = left @ axes, right @ axes

    def suffix(x: np.ndarray, d: int) -> np.ndarray:
        return np.sqrt(np.maximum((x[:, d:] ** 2).sum(axis=1), 0))

    if stages:
        d = stages[0]
        ahead = [np.column_stack([x[:, :d], suffix(x, d)]).astype(np.float32) for x in turned]
    else:
        ahead = [x.astype(np.float32) for x in turned]
    later = [(d, *(suffix(x, d) for x in turned)) for d in stages[1:]]
    step = max(1, (1 << 20) // max(len(right), 1))
    for low in range(0, len(left), step):
        bound = ahead[0][low : low + step] @ ahead[1].T
        rows, columns = np.nonzero(bound >= threshold - SLACK)
        rows += low
        for at in range(0, len(rows), 1 << 16):
            i, j = rows[at : at + (1 << 16)], columns[at : at + (1 << 16)]
            for d, own, other in later:
                part = np.einsum("ij,ij->i", turned[0][i, :d], turned[1][j, :d])
                stay = part + own[i] * other[j] >= threshold - SLACK
                i, j = i[stay], j[stay]
            stay = np.einsum("ij,ij->i", left[i], right[j]) >= threshold
            if stay.any():
                yield i[stay], j[stay]


def _compare(axes, threshold: float):
    def run(key, table):
        turn = axes.value
        table = table.combine_chunks()
        order = np.argsort(table["rep"].to_numpy(), kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        unit, size = unit_matrix(table["embedding"].chunk(0), len(turn))
        first, second = key[0].as_py(), key[1].as_py()
        tile, copies, rep = table["tile"].to_numpy(), table["copies"].to_numpy(), table["rep"].to_numpy()
        mine = np.flatnonzero(tile == first)
        other = mine if first == second else np.flatnonzero(tile == second)
        links = np.zeros(len(rep), np.int64)
        root = np.arange(len(rep))
        for i, j in linked_pairs(unit[mine], unit[other], turn, threshold):
            i, j = mine[i], other[j]
            stay = size[i] == size[j]
            if first == second:
                stay &= i < j
            i, j = i[stay], j[stay]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            root = local_roots(len(rep), np.concatenate([i, np.arange(len(rep))]), np.concatenate([j, root]))
        some = pa.array(np.flatnonzero(links))
        return pa.table({
            "rep": table["rep"].take(some), "mark": table["mark"].take(some),
            "links": pa.array(links).take(some), "root": pa.array(rep[root]).take(some),
        })

    return run


def near_duplicates(
    spark: SparkSession, vectors: DataFrame, threshold: float = 0.9, tile: int = TILE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = vectors.select(quoted(find_column(vectors, id_col)).cast("long").alias("vec_id"), quoted(find_column(vectors, vector_col)).alias("embedding"))
    good = F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.withColumn("good", F.coalesce(good & F.exists("embedding", lambda x: x != 0), F.lit(False)))
    valid = rows.where("good")
    folder = scratch_path(spark, "vectors")
    distinct = valid.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    distinct.withColumn("mark", F.xxhash64("embedding")).write.parquet(folder)
    kind = vectors.schema[find_column(vectors, vector_col)].dataType.simpleString()
    distinct = spark.read.schema(f"embedding {kind}, rep long, copies long, mark long").parquet(folder)
    size = distinct.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    if not size["n"]:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    axes = principal_axes(distinct, size["width"])
    shared = spark.sparkContext.broadcast(axes)
    linked = _tiles(distinct, axes, size["n"], threshold, tile).groupBy("low", "high").applyInArrow(
        _compare(shared, threshold), "rep long, mark long, links long, root long"
    )
    folder = scratch_path(spark, "links")
    linked.write.parquet(folder)
    linked = spark.read.schema("rep long, mark long, links long, root long").parquet(folder)
    nodes = components(spark, linked.select("rep", "root")).select(F.col("node").alias("rep"), "component")
    counts = linked.groupBy("rep", "mark").agg(F.sum("links").alias("links"))
    found = distinct.join(counts, ["rep", "mark"], "left").join(nodes, "rep", "left")
    found = found.select("embedding", "rep", "copies", "links", "component")
    out = rows.join(found.withColumn("good", F.lit(True)), ["embedding", "good"], "left")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def _tiles(distinct: DataFrame, axes: np.ndarray, n: int, threshold: float, tile: int) -> DataFrame:
    """Each vector once for every pair of tiles that its own tile is in (``low`` <= ``high``)."""
    first = axes[:, 0].copy()

    def lead_of(batch: pa.RecordBatch) -> np.ndarray:
        unit, _ = unit_matrix(batch.column(0), len(first))
        return unit @ first + batch.column(3).to_numpy().view(np.uint64) / 2.0**64 * JITTER

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(lead_of(batch))], ["lead"])

    rows = distinct.select("embedding", "rep", "copies", "mark")
    n_tiles = max(1, -(-n // tile))
    at = [i / n_tiles for i in range(1, n_tiles)]
    cuts = np.array(sorted(rows.mapInArrow(lead, "lead double").approxQuantile("lead", at, 0.1 / n_tiles)) if at else [])
    edges = np.concatenate([[-2.0], cuts, [2.0]])
    # Unit vectors with a cosine of t differ by at most sqrt(2 - 2t) along any axis.
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 2 * JITTER + SLACK
    furthest = np.searchsorted(edges[:-1], edges[1:] + reach, "right") - 1
    nearest = np.searchsorted(furthest, np.arange(n_tiles), "left")
    shared = distinct.sparkSession.sparkContext.broadcast((cuts, nearest, furthest))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, nearest, furthest = shared.value
        for batch in batches:
            own = np.searchsorted(cuts, lead_of(batch), "right")
            partners = furthest[own] - nearest[own] + 1
            for low in range(0, len(own), 1024):
                times = partners[low : low + 1024]
                row = np.repeat(np.arange(low, low + len(times)), times)
                other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + nearest[own[row]]
                mine = own[row]
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array(row)) for c in batch.columns),
                     *(pa.array(x.astype(np.int64)) for x in (mine, np.minimum(mine, other), np.maximum(mine, other)))],
                    [*batch.schema.names, "tile", "low", "high"],
                )

    kind = distinct.schema["embedding"].dataType.simpleString()
    return rows.mapInArrow(deal, f"embedding {kind}, rep long, copies long, mark long, tile long, low long, high long")
