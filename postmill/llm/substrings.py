"""Substring dedup by relative Lempel-Ziv parsing against every earlier document.

A document's ``n``-word windows are grouped into blocks: neighbouring windows that have the
same smallest hash of ``k`` consecutive words. Blocks therefore begin and end at places that
the text itself determines, and a passage is cut alike in every document that holds it.

1. Every document names the smallest hashes of its windows. A window can only occur
   elsewhere if another document names its hash, so all other blocks are done with.
2. The remaining blocks are the reference: their fingerprints are indexed with the smallest
   id that holds them. A block that an earlier document holds is taken as a whole; greedily
   joined neighbours of that kind are the long factors.
3. At the boundaries of factors, and in passages cut differently, the blocks left over are
   checked window by window, if another document has a block of that name left over too. The
   first holder of a window always has it left over, so nothing is missed. A window that a
   document repeats is one row with all its places, so a run of one word or line costs a row
   for each different window of a period, however long it is.

Every step is a join or a sum by a fingerprint, so a passage that a third of all documents
share costs rows in proportion to its occurrences. Step 1 uses 64-bit hashes as a filter;
steps 2 and 3 decide by two 64-bit hashes of the words. No group is gathered but the spans of one document. The
texts are shuffled once: windows are read and documents cut from the same exchange, as both
keep all columns.

Defined results: a null text has no words; a null id counts as later than every other, and
rows with equal ids are not earlier than each other; rows equal in id and text are judged
alike; an empty table gives an empty result; texts of any length are taken whole. Input columns are passed through, those named
like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.rows import add_columns, find_column, quoted
from postmill.llm.words import U64, Words, prefix_hash, slices, span_hash
from postmill.session import scratch_path

FIELDS = "n_words long, n_removed long, kept string"
SPANS = "array<struct<start:int,size:int>>"
LAST_ID = 2**63 - 1


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(U64).max, U64)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Blocks:
    """Blocks of the documents of a slice: document, first window, windows, smallest hash."""

    def __init__(self, words: Words, n: int, k: int):
        inside = words.whole(n)
        window = np.flatnonzero(inside)
        grams, _ = words.grams(k)
        smallest = sliding_min(grams, n - k + 1)[window] if len(window) else np.zeros(0, U64)
        doc = words.doc_of()[window]
        new = np.ones(len(window), bool)
        new[1:] = (smallest[1:] != smallest[:-1]) | (doc[1:] != doc[:-1])
        heads = np.flatnonzero(new)
        self.doc, self.word, self.name = doc[heads], window[heads], smallest[heads]
        self.size = np.diff(np.append(heads, len(window)))


def _blocks(rows: DataFrame, n: int, k: int) -> DataFrame:
    """All blocks of the rows (id, text_key, text), with a 128-bit fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _, data, offsets in slices(batch.column(2)):
                words = Words(data, offsets)
                blocks = Blocks(words, n, k)
                end = blocks.word + blocks.size + n - 1
                prints = (span_hash(prefix_hash(words.hashes(i), i), blocks.word, end, i).view(np.int64) for i in (0, 1))
                own = pa.array(blocks.doc + low)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(own), batch.column(1).take(own),
                     pa.array((blocks.word - words.first[blocks.doc]).astype(np.int32)), pa.array(blocks.size.astype(np.int32)),
                     pa.array(blocks.name.view(np.int64)), *map(pa.array, prints)],
                    ["id", "text_key", "start", "size", "name", "print_a", "print_b"],
                )

    return rows.mapInArrow(run, "id long, text_key long, start int, size int, name long, print_a long, print_b long")


def _windows(rows: DataFrame, n: int) -> DataFrame:
    """The different windows that the last column asks for, with a 128-bit fingerprint and all their places.

    The columns before it are the text, the id and the key of the text; others are not used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, ids, keys, asked = batch.columns[-4:]
            for low, high, data, offsets in slices(text):
                words = Words(data, offsets)
                part = asked.slice(low, high - low)
                doc = np.repeat(np.arange(high - low), np.diff(part.offsets.to_numpy()))
                start, size = (part.flatten().field(x).to_numpy().astype(np.int64) for x in ("start", "size"))
                row = np.repeat(np.arange(len(start)), size)
                at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + start[row]
                window = at + words.first[doc[row]]
                prints = (span_hash(prefix_hash(words.hashes(i), i), window, window + n, i).view(np.int64) for i in (0, 1))
                own, heads, spans, prints = _places(doc[row], at, *prints)
                own = pa.array(own[heads] + low)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(own), keys.take(own), spans, *(pa.array(p[heads]) for p in prints)],
                    ["id", "text_key", "spans", "window_a", "window_b"],
                )

    return rows.mapInArrow(run, f"id long, text_key long, spans {SPANS}, window_a long, window_b long")


def _places(doc: np.ndarray, at: np.ndarray, *prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, list[np.ndarray]]:
    """Documents and fingerprints in order, the first row of each different one, its runs of neighbouring places."""
    order = np.lexsort((at, *prints, doc))
    doc, at, *prints = (x[order] for x in (doc, at, *prints))
    new = np.ones(len(at), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in (doc, *prints)], axis=0)
    apart = new.copy()
    apart[1:] |= at[1:] != at[:-1] + 1
    runs, heads = np.flatnonzero(apart), np.flatnonzero(new)
    places = (at[runs], np.diff(np.append(runs, len(at))))
    places = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in places], ["start", "size"])
    ends = np.searchsorted(runs, np.append(heads, len(at))).astype(np.int32)
    return doc, heads, pa.ListArray.from_arrays(pa.array(ends), places), prints


def _stored(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows written once to the cluster's shared folder, so that no later step repeats the work."""
    folder = scratch_path(spark, "substrings")
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def repeated_windows(spark: SparkSession, rows: DataFrame, n: int, k: int) -> DataFrame:
    """(id, text_key, spans): runs of windows of ``rows`` that an earlier id holds, several to a row.

    The last columns of ``rows`` are the text, ``_repeat_id`` and ``_repeat_key``.
    """
    ids = ["_repeat_id", "_repeat_key"]
    blocks = _stored(spark, _blocks(rows.select(*ids, quoted(rows.columns[-3])), n, k))
    shared = blocks.groupBy("name").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    blocks = _stored(spark, blocks.join(shared.select("name"), "name"))
    index = blocks.groupBy("print_a", "print_b").agg(F.min("id").alias("holder"), F.min("name").alias("name"))
    contested = index.groupBy("name").agg(F.min("holder").alias("low"), F.max("holder").alias("high")).where("low < high")
    index = index.join(contested.select("name", F.lit(True).alias("contested")), "name", "left").drop("name")
    placed = blocks.join(index, ["print_a", "print_b"]).where("holder < id or contested")
    placed = _stored(spark, placed.select("id", "text_key", "start", "size", (F.col("holder") < F.col("id")).alias("held")))

    asked = placed.where("not held").groupBy(F.col("id").alias(ids[0]), F.col("text_key").alias(ids[1]))
    asked = asked.agg(F.collect_set(F.struct("start", "size")).alias("_repeat_asked"))
    left = _windows(rows.join(asked, ids).select(*map(quoted, rows.columns), "_repeat_asked"), n)
    first = left.groupBy("window_a", "window_b").agg(F.min("id").alias("holder"), F.max("id").alias("last")).where("holder < last")
    single = left.join(first, ["window_a", "window_b"]).where("holder < id").select("id", "text_key", "spans")
    return placed.where("held").select("id", "text_key", F.array(F.struct("start", "size")).alias("spans")).unionByName(single)


def _cut(n: int):
    def make():
        def run(batch: pa.RecordBatch) -> list:
            spans = batch.column(1).to_pylist()
            n_words, n_removed, kept = [], [], []
            for low, _, data, offsets in slices(batch.column(0)):
                raw = data.tobytes()
                for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:]), low):
                    words = raw[a:b].split()
                    total = len(words)
                    if spans[row]:
                        edge = np.zeros(total + 1, np.int64)
                        at = np.array([(s["start"], s["start"] + s["size"] + n - 1) for s in spans[row]])
                        np.add.at(edge, at[:, 0], 1)
                        np.add.at(edge, at[:, 1], -1)
                        stay = np.cumsum(edge[:-1]) == 0
                        words = [w for w, keep in zip(words, stay.tolist()) if keep]
                    n_words.append(total)
                    n_removed.append(total - len(words))
                    kept.append(b" ".join(words))
            return [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]

        return run

    return make


def remove_repeats(
    spark: SparkSession, docs: DataFrame, n: int = 50, k: int = 10, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``, the words left over joined by a space."""
    results = {f.split()[0] for f in FIELDS.split(", ")}
    own = find_column(docs, text_col)
    text = F.coalesce(quoted(own).cast("string"), F.lit(""))
    ids = F.coalesce(quoted(find_column(docs, id_col)).cast("long"), F.lit(LAST_ID)), F.xxhash64(text)
    # Input columns go by number on the way, so that no name of theirs meets one used here.
    kept = [c for c in docs.columns if c.lower() not in results]
    numbered = [quoted(c).alias(f"c{i}") for i, c in enumerate(kept) if c != own]
    rows = docs.select(*numbered, quoted(own).cast("string").alias("_text"), ids[0].alias("_repeat_id"), ids[1].alias("_repeat_key"))
    found = repeated_windows(spark, rows, n, k)
    spans = found.groupBy(F.col("id").alias("_repeat_id"), F.col("text_key").alias("_repeat_key"))
    spans = spans.agg(F.flatten(F.collect_set("spans")).alias("_repeat_spans"))
    joined = rows.join(spans, ["_repeat_id", "_repeat_key"], "left").drop("_repeat_id", "_repeat_key")
    out = add_columns(joined, {"_text": "string", "_repeat_spans": SPANS}, FIELDS, _cut(n))
    back = [F.col("_text" if c == own else f"c{i}").alias(c) for i, c in enumerate(kept)]
    return out.select(*back, "n_words", "n_removed", "kept")
