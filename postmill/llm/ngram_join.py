"""N-gram Jaccard join with Bayesian pruning of MinHash comparisons.

A text's set is its distinct shingles of ``n`` words; a text of fewer words, but not none, is
one shingle. Texts with equal sets are one class. 128 MinHash values per class give 32 band
keys of four values: a pair at the threshold shares no key once in 20 million. Classes that
share a key are compared byte by byte of their MinHash values; after 16, 32, 64 and 128 values
a pair is dropped when the posterior probability (uniform prior) that it reaches the threshold
is below ``tolerance``. The pairs left over join classes into candidate components, and
inside these every pair's Jaccard similarity is computed exactly.

Large buckets and components are split into tiles; every two tiles of one meet in a task, so
a task holds at most two tiles. Tasks return per class its number of links and one edge to the
smallest id of its local component; no row is made per pair.

Defined results: null and empty texts have no shingles and link with nothing, nor does a row
with a null id; rows with one id are one node of the graph; copies count as links; an empty
table gives an empty result. Other columns are ignored. Texts of any length are taken
whole: a task holds at most two tiles of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.components import components, local_roots
from postmill.llm.rows import find_column, quoted, whole_groups
from postmill.llm.words import U64, Words, mix, prefix_hash, slices, span_hash
from postmill.session import scratch_path

BANDS, ROWS = 32, 4
VALUES = BANDS * ROWS
STAGES = (16, 32, 64, VALUES)
BUCKET_TILE, VERIFY_TILE = 4096, 512
CLASSES = "id long, mark long, mark_b long, n long, bands array<long>, sketch binary"

_numbers = mix(np.arange(1, 2 * VALUES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
_FLIP, _FACTOR = _numbers[:VALUES], _numbers[VALUES:] | U64(1)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, document of each shingle), documents in order."""
    count = words.counts()
    per_doc = np.maximum(count - n + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(count)), per_doc)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc) + words.first[doc]
    end = np.minimum(start + n, words.first[doc + 1])
    return span_hash(prefix_hash(words.hashes()), start, end), doc


def distinct_shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The same without repetitions, in order of (document, hash)."""
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], doc[new]


def class_marks(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two hashes of each document's set, its size) from distinct shingles."""
    size = np.bincount(doc, minlength=n_docs)
    sums = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.append(U64(0), np.cumsum(mix(hashes ^ U64(salt))))
        edge = np.append(0, np.cumsum(size))
        sums.append(mix(total[edge[1:]] - total[edge[:-1]] + size.astype(U64)).view(np.int64))
    return sums[0], sums[1], size


def _signatures(rows: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(1)):
                found, doc = shingles(Words(data, offsets), n)
                one, two, size = class_marks(*distinct_shingles(found, doc, high - low), high - low)
                some = np.flatnonzero(size)
                heads = np.searchsorted(doc, some)
                values = np.empty((len(some), VALUES), U64)
                for i in range(VALUES if len(some) else 0):
                    values[:, i] = np.minimum.reduceat((found ^ _FLIP[i]) * _FACTOR[i], heads)
                values = mix(values)
                keys = np.arange(BANDS, dtype=U64)[None, :] * U64(0xA0761D6478BD642F)
                for row in range(ROWS):
                    keys = mix(keys + values[:, row::ROWS] * U64(0x9E3779B97F4A7C15))
                where = np.append(0, np.cumsum((size > 0) * BANDS))
                sketch = [b""] * (high - low)
                for row, values_of in zip(some, (values >> U64(56)).astype(np.uint8)):
                    sketch[row] = values_of.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), *map(pa.array, (one, two, size)),
                     pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(keys.view(np.int64).ravel())),
                     pa.array(sketch, pa.binary())],
                    ["id", "mark", "mark_b", "n", "bands", "sketch"],
                )

    return rows.select("id", "text").mapInArrow(run, CLASSES)


def least_matches(threshold: float, tolerance: float, stages=STAGES) -> list[tuple[int, int]]:
    """(values compared, fewest matches that keep a pair).

    One byte of a MinHash value matches with probability p = J + (1 - J) / 256. After m of n
    matches the posterior of p under a uniform prior is Beta(m + 1, n - m + 1), whose tail from
    p0 on equals the chance of at most m successes in n + 1 trials of p0.
    """
    p0 = threshold + (1 - threshold) / 256
    out = []
    for n in stages:
        below = 0.0
        for m in range(n + 1):
            below += comb(n + 1, m) * p0**m * (1 - p0) ** (n + 1 - m)
            if below >= tolerance:
                out.append((n, m))
                break
    return out


def similar(left: np.ndarray, right: np.ndarray, needed: list[tuple[int, int]]) -> np.ndarray:
    """Positions of the pairs (rows of ``left`` and ``right``) that no stage drops."""
    at = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    done = 0
    for n, least in needed:
        matches = matches + (left[at, done:n] == right[at, done:n]).sum(axis=1)
        stay = matches >= least
        at, matches, done = at[stay], matches[stay], n
    return at


def bucket_edges(sketch: np.ndarray, first: np.ndarray, second: np.ndarray, needed, few: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join rows ``first[g]..second[g]`` of each group as their surviving pairs do.

    Small groups compare all their pairs. In larger ones each row that is reached is compared
    with those not reached yet, which joins the same rows.
    """
    size = second - first
    edges = []
    for s in np.unique(size[size <= few]):
        if s < 2:
            continue
        heads = first[size == s]
        i, j = np.triu_indices(s, 1)
        step = max(1, (1 << 16) // len(i))
        for low in range(0, len(heads), step):
            a = (heads[low : low + step, None] + i).ravel()
            b = (heads[low : low + step, None] + j).ravel()
            stay = similar(sketch[a], sketch[b], needed)
            edges.append((a[stay], b[stay]))
    for low, high in zip(first[size > few], second[size > few]):
        left = np.arange(low, high)
        queue: list[int] = []
        while len(left):
            if not queue:
                queue, left = [int(left[0])], left[1:]
            pivot = queue.pop()
            if not len(left):
                break
            hit = similar(np.broadcast_to(sketch[pivot], (len(left), sketch.shape[1])), sketch[left], needed)
            reached = left[hit]
            edges.append((np.full(len(reached), pivot), reached))
            queue.extend(reached.tolist())
            left = np.delete(left, hit)
    if not edges:
        return (np.zeros(0, np.int64),) * 2
    return np.concatenate([a for a, _ in edges]), np.concatenate([b for _, b in edges])


def tiled(rows: DataFrame, key: str, size: str, tile: int) -> DataFrame:
    """Rows once for each pair of tiles (``low`` <= ``high``) of their key that they belong to."""
    parts = F.ceil(F.col(size) / tile).cast("int")
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("rep", "mark", F.lit(tile)), parts).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")}).drop("other", size)


def _candidates(rows: DataFrame, needed) -> DataFrame:
    """(rep, root) inside buckets; rows are (key, low, high, rep, sketch), sorted by the first three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, 3):
            rep = table["rep"].to_numpy()
            sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(rep), VALUES)
            a, b = bucket_edges(sketch, starts, np.append(starts[1:], len(rep)), needed)
            root = local_roots(len(rep), a, b)
            some = np.flatnonzero(rep[root] != rep)
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(rep[root][some])], ["rep", "root"])

    return rows.select("key", "low", "high", "rep", "sketch").mapInArrow(run, "rep long, root long")


def overlaps(hashes: np.ndarray, doc: np.ndarray, n_docs: int, step: int = 4096) -> np.ndarray:
    """Number of common shingles of every two documents of a tile pair, from distinct shingles."""
    order = np.argsort(hashes, kind="stable")
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1
    stay = often[column]
    doc, column = doc[stay], (np.cumsum(often) - 1)[column[stay]]
    out = np.zeros((n_docs, n_docs), np.float64)
    width = int(often.sum())
    cuts = np.searchsorted(column, np.arange(0, width + step, step))
    for at, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        block = np.zeros((n_docs, min(step, width - at * step)), np.float32)
        block[doc[a:b], column[a:b] - at * step] = 1
        out += block @ block.T
    return out


def _verified(rows: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """(rep, mark, links, root); rows are (key, low, high, tile, rep, copies, text), sorted by the first three."""
    over, under = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, 3):
            for start, end in zip(starts, np.append(starts[1:], table.num_rows)):
                group = table.slice(start, end - start)
                out = compare(group)
                if out is not None:
                    yield out

    def compare(group: pa.Table):
        total = group.num_rows
        parts = []
        for low, _, data, offsets in slices(group["text"]):
            found, doc = shingles(Words(data, offsets), n)
            parts.append((found, doc + low))
        found, doc = distinct_shingles(*map(np.concatenate, zip(*parts)), total)
        mark, _, size = class_marks(found, doc, total)
        tile, rep, copies = (group[c].to_numpy() for c in ("tile", "rep", "copies"))
        # Rows of one id may hold several texts; one row of the class itself stays.
        own = np.zeros(total, bool)
        own[np.unique(np.stack([rep, mark, mark == group["mark"].to_numpy()]), axis=1, return_index=True)[1]] = True
        own &= mark == group["mark"].to_numpy()
        common = overlaps(found, doc, total)
        i, j = np.nonzero(np.triu(common, 1))
        both = common[i, j].astype(np.int64)
        stay = (both * under >= over * (size[i] + size[j] - both)) & own[i] & own[j]
        if group["low"][0].as_py() != group["high"][0].as_py():
            stay &= tile[i] != tile[j]
        i, j = i[stay], j[stay]
        if not len(i):
            return None
        links = np.bincount(i, copies[j], total) + np.bincount(j, copies[i], total)
        order = np.argsort(rep, kind="stable")
        place = np.empty(total, np.int64)
        place[order] = np.arange(total)
        root = rep[order][local_roots(total, place[i], place[j])][place]
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [pa.array(rep[some]), pa.array(mark[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])],
            ["rep", "mark", "links", "root"],
        )

    columns = ["key", "low", "high", "tile", "rep", "mark", "copies", "text"]
    return rows.select(*columns).mapInArrow(run, "rep long, mark long, links long, root long")


def _stored(spark: SparkSession, rows: DataFrame, purpose: str) -> DataFrame:
    folder = scratch_path(spark, purpose)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def _dealt(rows: DataFrame) -> DataFrame:
    """Pairs of tiles dealt over tasks, the rows of a pair together."""
    return rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "rep")


def jaccard_join(
    spark: SparkSession, docs: DataFrame, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-9, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, class_id, n_links, component_id) of every row.

    ``class_id`` is the smallest id with the same set, ``n_links`` the number of other rows at
    the threshold or above, ``component_id`` the smallest id that links reach.
    """
    text = F.coalesce(quoted(find_column(docs, text_col)).cast("string"), F.lit(""))
    rows = docs.select(quoted(find_column(docs, id_col)).cast("long").alias("id"), text.alias("text"))
    signed = _stored(spark, _signatures(rows, n), "signatures")
    valid = F.col("id").isNotNull() & (F.col("n") > 0)
    needed = least_matches(threshold, tolerance)

    same = ["mark", "mark_b"]
    classes = signed.where(valid).groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    placed = _stored(spark, signed.where(valid).select("id", *same).join(classes, same), "placed")
    chosen = signed.where(valid).withColumnRenamed("id", "rep").join(
        placed.where("id = rep").select("rep", *same, "copies").distinct(), ["rep", *same]
    )
    chosen = _stored(spark, chosen.dropDuplicates(["rep", *same]).select("rep", "mark", "copies", "bands", "sketch"), "classes")

    keys = chosen.select("rep", "mark", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    meeting = keys.join(buckets, "key").join(chosen.select("rep", "mark", "sketch"), ["rep", "mark"])
    edges = _candidates(_dealt(tiled(meeting, "key", "size", BUCKET_TILE)), needed).distinct()
    groups = components(spark, edges).select(F.col("node").alias("rep"), F.col("component").alias("key"))

    members = chosen.select("rep", "mark", "copies").join(groups, "rep")
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    members = tiled(members.join(sizes, "key"), "key", "size", VERIFY_TILE)
    texts = rows.join(members, rows["id"] == members["rep"]).withColumn("print", F.xxhash64("text"))
    texts = texts.dropDuplicates(["rep", "mark", "low", "high", "print"])
    linked = _stored(spark, _verified(_dealt(texts), n, Fraction(str(threshold))), "links")
    counts = linked.groupBy("rep", "mark").agg(F.sum("links").alias("links"))

    # An id with several texts is one node: it joins the classes of them all.
    several = placed.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("id")
    joints = placed.join(several, "id").select("rep", F.col("id").alias("root"))
    nodes = components(spark, linked.select("rep", "root").unionByName(joints))

    found = placed.join(counts, ["rep", "mark"], "left").join(nodes, F.col("rep") == F.col("node"), "left").select(
        F.col("id").alias("doc_id"),
        F.col("rep").alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    alone = signed.where(~valid).select(
        F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    )
    return found.unionByName(alone)
