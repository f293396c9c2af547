"""Stupid-backoff scores from n-gram counts of all documents.

A word's score is count(n-gram) / count(its context) for the longest n-gram that another
document holds, times ``alpha`` for every order skipped; a word that no other document holds
gets ``alpha`` once more over the number of all other words plus one. Counts are those of all
documents without the document that is scored.

Documents are dealt to buckets of about ``bucket_bytes`` of text, compressed, and n-grams to
parts by their hash. A bucket sends each part its distinct n-grams with their counts, packed in one row. In a
part all buckets' n-grams are summed into the count table and joined back to the buckets that
asked; a bucket then sums the scores per document. An n-gram can only occur elsewhere if both
its shorter n-grams do, so orders above two are asked for these alone.

Buckets and parts have bounded sizes and their number grows with the text. An n-gram reaches
its part once per bucket however often it occurs, so frequent n-grams are no hot keys.

Defined results: a null or empty text has no words, sum 0 and mean null; a null or repeated id
is scored row by row; an empty table gives an empty result; a text of any length is taken
whole, one longer than a bucket as a bucket of its own. Other columns are ignored. Words
are runs of letters and digits with A-Z in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.rows import find_column, quoted
from postmill.llm.words import PUNCTUATION, U64, Words, mix, prefix_hash, slices, span_hash

BUCKET_BYTES, PART_BYTES = 4 << 20, 8 << 20
SPREAD = U64(0x9E3779B97F4A7C15)


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, compressed: high bytes are mostly zero."""
    planes = np.ascontiguousarray(values.astype(U64).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(U64).ravel()


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, how often each occurs)."""
    ordered = np.sort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    heads = np.flatnonzero(new)
    return ordered[heads], np.diff(np.append(heads, len(keys)))


def _slots(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """A place for each key in a table about four times as long; keys are hashes already."""
    bits = max(len(keys) * 4, 16).bit_length()
    return (mix(keys) >> U64(64 - bits)).astype(np.int64), 1 << bits


def places(distinct: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key among the sorted distinct ones, all of which are there.

    A table answers most keys; those whose slot another key took are searched for.
    """
    slots, size = _slots(distinct)
    table = np.zeros(size, np.int64)
    table[slots] = np.arange(len(distinct))
    shift = U64(64 - (size.bit_length() - 1))
    found = table[(mix(keys) >> shift).astype(np.int64)]
    missed = np.flatnonzero(distinct[found] != keys) if len(keys) else found
    found[missed] = np.searchsorted(distinct, keys[missed])
    return found


def times_of(keys: np.ndarray) -> np.ndarray:
    """How often each key occurs, in the order of the keys.

    Slots that hold one key only are counted in a table, the others by sorting.
    """
    slots, size = _slots(keys)
    table = np.zeros(size, U64)
    table[slots] = keys
    shared = np.zeros(size, bool)
    shared[slots[table[slots] != keys]] = True
    out = np.bincount(slots, minlength=size)[slots]
    rest = np.flatnonzero(shared[slots])
    distinct, times = grouped(keys[rest])
    out[rest] = times[np.searchsorted(distinct, keys[rest])] if len(rest) else 0
    return out


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of keys, so sorted keys fall into parts in order."""
    return ((keys >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


class Bucket:
    """N-grams of the documents of one bucket.

    Position 0 of the arrays of order 0 stands for the empty n-gram, the context of single
    words, which a document holds once per word.
    """

    def __init__(self, texts: pa.Array, order: int):
        self.order = order
        parts = [[] for _ in range(order + 1)]
        docs = [[] for _ in range(order + 1)]
        self.n_words = []
        before = 0
        self.first = []
        for low, _, data, offsets in slices(texts):
            words = Words(data, offsets, PUNCTUATION, lower=True)
            sums = prefix_hash(words.hashes())
            doc = words.doc_of()
            for n in range(1, order + 1):
                # Every position has an entry; those without n words in the document hold none.
                start = np.arange(len(words))
                end = start + n
                inside = end <= np.repeat(words.first[1:], words.counts())
                keys = span_hash(sums, start, np.minimum(end, len(words)))
                keys[~inside] = 0
                parts[n].append(keys)
                docs[n].append(doc + low)
            self.n_words.append(words.counts())
            self.first.append(np.repeat(words.first[:-1], words.counts()) + before)
            before += len(words)
        self.n_words = np.concatenate(self.n_words)
        self.keys = [None] + [np.concatenate(p) for p in parts[1:]]
        self.doc = np.concatenate(docs[1])
        self.first = np.concatenate(self.first)
        self.others: dict[int, np.ndarray] = {}

    def level(self, level: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """(distinct keys to ask for, [(order, positions)]); level 0 holds orders 0 to 2, level 1 order 3, ..."""
        if level == 0:
            orders = [(n, np.flatnonzero(self.keys[n])) for n in range(1, min(self.order, 2) + 1)]
        else:
            n = level + 2
            held = self.held(n - 1) > 0
            both = np.zeros(len(held), bool)
            both[:-1] = held[:-1] & held[1:]
            orders = [(n, np.flatnonzero(both & (self.keys[n] != 0)))]
        keys = np.concatenate([self.keys[n][at] for n, at in orders] + ([np.zeros(1, U64)] if level == 0 else []))
        return keys, orders

    def learn(self, level: int, totals: np.ndarray) -> None:
        """Take in the totals of a level's distinct keys, in their order."""
        keys, orders = self.level(level)
        found = totals.astype(np.int64)[places(grouped(keys)[0], keys)]
        if level == 0:
            self.all_words = int(totals[0])
        before = 0
        for n, at in orders:
            total = found[before : before + len(at)]
            before += len(at)
            # An n-gram that occurs once occurs here only.
            often = np.flatnonzero(total > 1)
            total, at = total[often], at[often]
            self.others[n] = np.zeros(len(self.doc), np.int64)
            self.others[n][at] = total - times_of(self.keys[n][at] + self.doc[at].astype(U64) * SPREAD)

    def held(self, n: int) -> np.ndarray:
        """How often other documents hold the n-gram at each word; nothing asked, nothing held."""
        return self.others.get(n, np.zeros(len(self.doc), np.int64))

    def asked(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(distinct keys, how often each occurs here)."""
        keys, times = grouped(self.level(level)[0])
        if level == 0:
            times[0] = len(self.doc)
        return keys, times

    def scores(self, alpha: float) -> np.ndarray:
        """Summed log scores of the documents."""
        at = np.arange(len(self.doc))
        others_words = self.all_words - self.n_words[self.doc]
        score = np.zeros(len(at))
        open_ = np.ones(len(at), bool)
        depth = np.minimum(at - self.first + 1, self.order)
        for n in range(self.order, 0, -1):
            start = at - n + 1
            usable = open_ & (depth >= n)
            where = np.flatnonzero(usable)
            number = self.held(n)[start[where]]
            hit = where[number > 0]
            context = others_words[hit] if n == 1 else self.held(n - 1)[start[hit]]
            score[hit] = np.log(self.held(n)[start[hit]] / context) + (depth[hit] - n) * np.log(alpha)
            open_[hit] = False
        left = np.flatnonzero(open_)
        score[left] = depth[left] * np.log(alpha) - np.log(others_words[left] + 1.0)
        return np.bincount(self.doc, score, len(self.n_words)).astype(float)


def _totals_of(table: pa.Table) -> dict[int, np.ndarray]:
    """Totals of each level from the rows of a bucket."""
    rows = sorted(zip(table["level"].to_pylist(), table["part"].to_pylist(), table["totals"].to_pylist()))
    out: dict[int, list] = {}
    for level, _, data in rows:
        out.setdefault(level, []).append(unpacked(data))
    return {level: np.concatenate(parts) for level, parts in out.items()}


PACKS = "bucket long, ids array<long>, sizes binary, texts binary"


def _packs(rows: DataFrame) -> DataFrame:
    """Documents (bucket, doc_id, text) of a task's batch as one compressed row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            order = np.argsort(batch.column(0).to_numpy(), kind="stable")
            batch = batch.take(pa.array(order))
            bucket = batch.column(0).to_numpy()
            edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            packs = []
            for low, high in zip(edge[:-1], edge[1:]):
                parts = [(data.tobytes(), np.diff(offsets)) for _, _, data, offsets in slices(batch.column(2).slice(low, high - low))]
                packs.append((squeeze.compress(b"".join(d for d, _ in parts)), np.concatenate([n for _, n in parts]).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[edge[:-1]]), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), batch.column(1)),
                 pa.array([n for _, n in packs], pa.binary()), pa.array([t for t, _ in packs], pa.binary())],
                ["bucket", "ids", "sizes", "texts"],
            )

    return rows.select("bucket", "doc_id", "text").mapInArrow(run, PACKS)


def _texts(docs: pa.Table) -> pa.LargeStringArray:
    sizes = np.concatenate([np.frombuffer(x, np.int64) for x in docs["sizes"].to_pylist()])
    expand = zstandard.ZstdDecompressor()
    data = b"".join(expand.decompress(x) for x in docs["texts"].to_pylist())
    offsets = np.append(0, np.cumsum(sizes))
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data))


def _learned(docs: pa.Table, totals: pa.Table | None, order: int) -> Bucket:
    bucket = Bucket(_texts(docs), order)
    known = _totals_of(totals) if totals is not None else {}
    for level in sorted(known):
        bucket.learn(level, known[level])
    return bucket


ASKED = "part long, bucket long, level int, keys binary, times binary"
TOTALS = "bucket long, part long, level int, totals binary"


def _ask(level: int, order: int, parts: int):
    def rows_of(docs, totals=None):
        keys, times = _learned(docs, totals, order).asked(level)
        part = part_of(keys, parts)
        edge = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
        rows = list(zip(edge, np.append(edge[1:], len(keys))))
        bucket = docs["bucket"][0]
        return pa.table({
            "part": pa.array(part[edge], pa.int64()),
            "bucket": pa.array([bucket.as_py()] * len(rows), pa.int64()),
            "level": pa.array([level] * len(rows), pa.int32()),
            "keys": pa.array([packed(np.diff(keys[a:b], prepend=U64(0))) for a, b in rows], pa.binary()),
            "times": pa.array([packed(times[a:b]) for a, b in rows], pa.binary()),
        })

    def alone(docs):
        return rows_of(docs)

    def after(docs, totals):
        return rows_of(docs, totals)

    return alone if level == 0 else after


def _answer(table):
    keys = [np.cumsum(unpacked(x), dtype=U64) for x in table["keys"].to_pylist()]
    times = np.concatenate([unpacked(x) for x in table["times"].to_pylist()])
    every = np.concatenate(keys)
    place = places(grouped(every)[0], every)
    # Sums of counts stay exact below 2**53.
    totals = np.bincount(place, times.astype(float)).astype(U64)[place]
    edge = np.append(0, np.cumsum([len(x) for x in keys]))
    return pa.table({
        "bucket": table["bucket"], "part": table["part"], "level": table["level"],
        "totals": pa.array([packed(totals[a:b]) for a, b in zip(edge[:-1], edge[1:])], pa.binary()),
    })


def _score(order: int, alpha: float):
    def run(docs, totals):
        if not docs.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64()))})
        bucket = _learned(docs, totals, order)
        return pa.table({"doc_id": docs["ids"].combine_chunks().flatten(), "n_words": pa.array(bucket.n_words, pa.int64()), "log_score": pa.array(bucket.scores(alpha))})

    return run


def stupid_backoff(
    spark: SparkSession, docs: DataFrame, order: int = 3, alpha: float = 0.4, id_col: str = "doc_id", text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of every row."""
    text = F.coalesce(quoted(find_column(docs, text_col)).cast("string"), F.lit(""))
    rows = docs.select(quoted(find_column(docs, id_col)).cast("long").alias("doc_id"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    buckets, parts = -(-size // bucket_bytes) or 1, -(-size // part_bytes) or 1
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)))
    dealt = _packs(rows).groupBy("bucket")
    totals = None
    for level in range(max(order - 1, 1)):
        ask = _ask(level, order, parts)
        asked = dealt.applyInArrow(ask, ASKED) if totals is None else dealt.cogroup(totals.groupBy("bucket")).applyInArrow(ask, ASKED)
        # Levels are asked one after the other, and a part answers each of its rows.
        answers = asked.groupBy("part").applyInArrow(_answer, TOTALS)
        totals = answers if totals is None else totals.unionByName(answers)
    scored = dealt.cogroup(totals.groupBy("bucket")).applyInArrow(_score(order, alpha), "doc_id long, n_words long, log_score double")
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
