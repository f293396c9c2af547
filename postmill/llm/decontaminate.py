"""Benchmark decontamination by a prefix-filtered set join.

A window is ``n`` consecutive words of an item; an item of fewer words is one window. Its
words are ordered by how rare they are in all documents, and the rarest one is the window's
necessary prefix: a document without that word cannot hold the window. Documents are probed
with the prefix words only; position and length bounds place the window, and its words are
found by two independent 64-bit hashes and compared word for word.

The index holds the benchmark, not the documents. It is broadcast in blocks of items of at
most ``block_bytes`` of text; one block is the usual case and needs two passes over the
documents (word counts, probing). With more blocks the rows are written to the cluster's
shared folder between blocks, so a task never holds more than one.

Defined results: a null text has no words; a null or repeated id is judged row by row; items
without words are never found; items with equal ids count once; an item with a null id counts
in the hits and their spans but is not listed among the ids; an empty benchmark
or an empty table gives zeros or no rows; texts of any length are taken whole. Input columns are passed through, those named like
a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.llm.rows import add_columns, find_column, quoted
from postmill.llm.words import PUNCTUATION, U64, Words, prefix_hash, slices, span_hash
from postmill.session import scratch_path

BLOCK_BYTES = 4 << 20
FIELDS = "n_words long, n_hit long, hit_spans array<struct<start:long,end:long>>, item_ids array<string>"


def _words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(data, offsets, PUNCTUATION, lower=True)


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[pa.Table]:
    """The items in blocks of bounded size; an item larger than a block stands alone."""
    sized = items.select(
        quoted(find_column(items, id_col)).cast("string").alias("item_id"),
        quoted(find_column(items, text_col)).cast("string").alias("text"),
    ).where("text is not null").distinct()
    size = F.octet_length("text")
    total = sized.agg(F.sum(size).alias("bytes")).first()["bytes"] or 0
    if total <= block_bytes:
        yield sized.toArrow()
        return
    # Larger benchmarks: items are dealt to blocks by their hash, one block at a time comes here.
    blocks = -(-2 * total // block_bytes)
    dealt = sized.withColumn("block", F.pmod(F.xxhash64(F.coalesce("item_id", "text")), F.lit(blocks)))
    for block in range(blocks):
        yield dealt.where(F.col("block") == block).drop("block").toArrow()


class Index:
    """Windows of a block of items, grouped by their length in words."""

    def __init__(self, items: pa.Table, n: int):
        self.ids = items["item_id"].to_pylist()
        found: dict[int, list] = {}
        vocabulary = []
        self.spelled: list[list[bytes]] = []
        for low, _, data, offsets in slices(items["text"]):
            words = _words(data, offsets)
            one, two = words.hashes(0), words.hashes(1)
            vocabulary.append(one)
            sums = prefix_hash(one, 0), prefix_hash(two, 1)
            spelled = words.spelled(np.arange(len(words)))
            for row, count in enumerate(words.counts()):
                self.spelled.append(spelled[words.first[row] : words.first[row + 1]])
                if not count:
                    continue
                length = min(n, int(count))
                start = np.arange(words.first[row], words.first[row + 1] - length + 1)
                end = start + length
                found.setdefault(length, []).append((
                    span_hash(sums[0], start, end, 0),
                    span_hash(sums[1], start, end, 1),
                    np.full(len(start), low + row),
                    start - words.first[row],
                    one[start[:, None] + np.arange(length)],
                ))
        self.vocabulary = np.unique(np.concatenate(vocabulary)) if vocabulary else np.zeros(0, U64)
        self.windows = {length: tuple(map(np.concatenate, zip(*parts))) for length, parts in found.items()}

    def order(self, frequency: np.ndarray) -> None:
        """Choose each window's rarest word and group windows by (that word, its position)."""
        self.probes = []
        for length, (one, two, item, place, words) in sorted(self.windows.items()):
            seen = frequency[np.searchsorted(self.vocabulary, words)]
            offset = np.argmin(seen, axis=1)
            at = np.arange(len(one))
            able = seen[at, offset] > 0
            order = np.lexsort((two, one))
            order = order[able[order]]
            prefix = words[at, offset]
            pairs = np.unique(np.stack([prefix[able], offset[able].astype(U64)]), axis=1)
            self.probes.append((length, pairs[0], pairs[1].astype(np.int64), one[order], two[order], item[order], place[order]))
        del self.windows

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, word after the last, item) of every occurrence of a window."""
        out = []
        one = words.hashes(0)
        last = np.repeat(words.first[1:], words.counts())
        sums = None
        for length, prefix, offset, hash_one, hash_two, item, place in self.probes:
            low, high = np.searchsorted(prefix, one, "left"), np.searchsorted(prefix, one, "right")
            where = np.flatnonzero(high > low)
            if not len(where):
                continue
            # One candidate per (occurrence of a prefix word, position that it can have).
            repeat = (high - low)[where]
            slot = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat) + np.repeat(low[where], repeat)
            word = np.repeat(where, repeat)
            start = word - offset[slot]
            doc_start = np.repeat(words.first[:-1], words.counts())[word]
            fits = (start >= doc_start) & (start + length <= last[word])
            start = np.unique(start[fits])
            if not len(start):
                continue
            sums = sums or (prefix_hash(one, 0), prefix_hash(words.hashes(1), 1))
            mine = span_hash(sums[0], start, start + length, 0), span_hash(sums[1], start, start + length, 1)
            first, after = np.searchsorted(hash_one, mine[0], "left"), np.searchsorted(hash_one, mine[0], "right")
            count = after - first
            pick = np.flatnonzero(count)
            repeat = count[pick]
            entry = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat) + np.repeat(first[pick], repeat)
            of = np.repeat(pick, repeat)
            same = hash_two[entry] == mine[1][of]
            of, entry = of[same], entry[same]
            held = self._held(words, start[of], length, item[entry], place[entry])
            out.append((start[of[held]], start[of[held]] + length, item[entry[held]]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out))

    def _held(self, words: Words, start: np.ndarray, length: int, item: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which windows are word for word those of the items."""
        kinds, where = np.unique(start[:, None] + np.arange(length), return_inverse=True)
        spelled = np.empty(len(kinds), object)
        spelled[:] = words.spelled(kinds)
        mine = spelled[where.reshape(-1, length)].tolist()
        return np.array([w == self.spelled[i][p : p + length] for w, i, p in zip(mine, item.tolist(), place.tolist())], bool)


def word_counts(docs: DataFrame, text_col: str, vocabulary: np.ndarray) -> np.ndarray:
    """How often each word of a (block-sized) vocabulary occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                have = _words(data, offsets).hashes()
                at = np.minimum(np.searchsorted(known, have), len(known) - 1)
                total += np.bincount(at[known[at] == have], minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["word", "n"])

    if not len(vocabulary):
        return np.zeros(0, np.int64)
    text = quoted(find_column(docs, text_col)).cast("string")
    rows = docs.select(text).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary), np.int64)
    for row in rows:
        out[row["word"]] = row["n"]
    return out


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as disjoint spans in order."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    heads = np.flatnonzero(new)
    return start[heads], end[np.append(heads[1:], len(start)) - 1]


def _probe(shared, again: bool):
    def make():
        index: Index = shared.value

        def run(batch: pa.RecordBatch) -> list:
            n_words, spans, items = [], [None] * batch.num_rows, [[]] * batch.num_rows
            for low, _, data, offsets in slices(batch.column(0)):
                words = _words(data, offsets)
                n_words.append(words.counts())
                start, end, item = index.hits(words)
                doc = np.searchsorted(words.first, start, "right") - 1
                for d in np.unique(doc):
                    own = doc == d
                    s, e = merged(start[own] - words.first[d], end[own] - words.first[d])
                    spans[low + d] = list(zip(s.tolist(), e.tolist()))
                    items[low + d] = sorted({index.ids[i] for i in np.unique(item[own])} - {None})
            if again:
                for row, (had, more) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                    if had:
                        both = np.array([(x["start"], x["end"]) for x in had] + (spans[row] or []))
                        spans[row] = list(zip(*(x.tolist() for x in merged(both[:, 0], both[:, 1]))))
                        items[row] = sorted({*items[row], *more})
            n_hit = [sum(e - s for s, e in x) if x else 0 for x in spans]
            struct = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return [
                pa.array(np.concatenate(n_words), pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array([[{"start": s, "end": e} for s, e in x or ()] for x in spans], struct),
                pa.array(items, pa.list_(pa.string())),
            ]

        return run

    return make


def benchmark_hits(
    spark: SparkSession,
    docs: DataFrame,
    items: DataFrame,
    n: int = 13,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, the hit word spans and the ids of the items found."""
    out = None
    for block in item_blocks(items, item_col, item_text_col, block_bytes):
        index = Index(block, n)
        index.order(word_counts(docs, text_col, index.vocabulary))
        probe = _probe(spark.sparkContext.broadcast(index), out is not None)
        if out is None:
            out = add_columns(docs, {text_col: "string"}, FIELDS, probe)
            continue
        folder = scratch_path(spark, "decontaminate")
        kind = {f.name: f.dataType.simpleString() for f in out.schema.fields}
        out.write.parquet(folder)
        inputs = {text_col: "string", "hit_spans": kind["hit_spans"], "item_ids": kind["item_ids"]}
        out = add_columns(spark.read.parquet(folder), inputs, FIELDS, probe)
    return out


def is_contaminated(one_in: int = 20):
    """At least one word in ``one_in`` is hit."""
    return (F.col("n_hit") > 0) & (F.lit(one_in) * F.col("n_hit") >= F.col("n_words"))
