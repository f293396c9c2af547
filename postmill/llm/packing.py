"""Packing of tokenised documents into sequences: shortest pack first over the length histogram.

A document becomes full-length pieces and one rest. Only the histogram of piece lengths (at
most ``size`` rows) reaches the driver; there lengths are placed longest first into the pack
with the most room, and packs that look alike are one pattern with a count. Pieces then get
their places back by their rank among the pieces of their length.

Defined results: a null text is an empty document (its end id only); a null or repeated id
is kept as it is, every row is packed by itself; other columns are ignored; an empty table
gives an empty result. Texts of any length are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.llm.words import slices
from postmill.session import scratch_path

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"
SLOTS = "length int, low long, high long, base long, repeat long, at long"

# Units that byte-level pre-tokenisation never joins over: white space and what follows it.
UNITS = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
# Other white space may extend a run of it, so such texts are encoded in one go.
RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")


# Fixed value: how byte-level pre-tokenisation splits a text.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Letters up to here are letters in every version of Unicode.
LATIN_END = "\u024f"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Memo(dict):
    """Ids of units, worked out when first asked for."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, unit: str) -> bytes:
        code = self.encode(unit)
        if len(unit) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[unit] = code
        return code


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes.

    Byte-level tokenisers treat each unit of white space plus word by itself, so units are
    encoded once and remembered, up to ``memo`` of them. Latin units go through the same
    vocabulary in ``tiktoken``, whose calls cost a third; every other text, and every text
    for a tokeniser of another kind, goes through ``tokenizers`` whole or by unit.
    """

    def __init__(self, path: str, memo: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        setup = json.loads(self.tokenizer.to_str())
        splitter, model = setup.get("pre_tokenizer") or {}, setup["model"]
        self.by_unit = (
            setup.get("normalizer") is None
            and splitter.get("type") == "ByteLevel"
            and not splitter.get("add_prefix_space")
            and splitter.get("use_regex", True)
        )
        added = [t["content"] for t in setup.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.latin = self._ranked(model["vocab"], added) if self.by_unit and model.get("type") == "BPE" else None
        self.memo = _Memo(self._unit, memo)

    @staticmethod
    def _ranked(vocab: dict[str, int], added: list[str]):
        import tiktoken

        letters = byte_alphabet()
        ranks = {bytes(letters[c] for c in token): n for token, n in vocab.items() if token not in added}
        return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _unit(self, unit: str) -> bytes:
        return array("I", self.latin(unit)).tobytes() if self.latin and max(unit) <= LATIN_END else self._whole(unit)

    def __call__(self, text: str) -> bytes:
        if not self.by_unit or RARE_SPACE.search(text) or (self.added and self.added.search(text)):
            return self._whole(text)
        return b"".join(map(self.memo.__getitem__, UNITS.findall(text)))


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: full pieces from the start of a document, then its rest."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        for batch in batches:
            ids = batch.column(0)
            for low, high, data, offsets in slices(batch.column(1)):
                raw = data.tobytes()
                rows: list[tuple] = []
                for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                    code = encode(raw[a:b].decode()) + end
                    total = len(code) // 4
                    for start in range(0, total, size):
                        part = code[4 * start : 4 * (start + size)]
                        rows.append((low + row, start, len(part) // 4, zlib.crc32(part), total))
                own, start, length, crc, total = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(own)), pa.array(start, pa.int64()), pa.array(length, pa.int32()),
                     pa.array(crc, pa.int64()), pa.array(total, pa.int64())],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(cut, PIECES)


def pack_histogram(histogram: dict[int, int], size: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, times), ...) and how many packs follow each.

    Longest lengths first; each goes into the pack with the most room left, or into a new
    pack when none has room. Packs of one pattern are handled together, so the work depends
    on the number of lengths only.
    """
    open_packs: dict[int, list[tuple[tuple, int]]] = {size: []}
    for length in sorted((n for n, c in histogram.items() if c > 0), reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, packs in open_packs.items() if packs), default=0)
            if room < length:
                open_packs.setdefault(size - length, []).append((((length, 1),), left))
                break
            pattern, count = open_packs[room].pop()
            used = min(count, left)
            if count > used:
                open_packs[room].append((pattern, count - used))
            last, times = pattern[-1]
            grown = (*pattern[:-1], (last, times + 1)) if last == length else (*pattern, (length, 1))
            open_packs.setdefault(room - length, []).append((grown, used))
            left -= used
    return [pack for room in sorted(open_packs) for pack in open_packs[room]]


def slots(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of a length go: ranks ``low..high``, first sequence, pieces per sequence, offset."""
    taken: dict[int, int] = {}
    out, base = [], 0
    for pattern, count in patterns:
        at = 0
        for length, times in pattern:
            low = taken.get(length, 0)
            taken[length] = low + count * times
            out.append((length, low, low + count * times, base, times, at))
            at += length * times
        base += count
    return out


def ranked(cut: DataFrame, n_pieces: int, rows_per_group: int = 200_000) -> DataFrame:
    """``rank`` from 0 among the pieces of one length; frequent lengths are split over groups."""
    groups = max(32, -(-n_pieces // rows_per_group))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("int"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("length", "part").count()
    sums = sums.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    cut = cut.withColumn("inside", F.row_number().over(inside) - 1)
    return cut.join(sums, ["length", "part"]).withColumn("rank", F.col("before") + F.col("inside"))


def pack(
    spark: SparkSession,
    docs: DataFrame,
    tokenizer: str,
    size: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row per piece with its sequence and its place there."""
    folder = scratch_path(spark, "pieces")
    pieces(docs, tokenizer, size, end_id, id_col, text_col).write.parquet(folder)
    cut = spark.read.schema(PIECES).parquet(folder)
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    places = spark.createDataFrame(slots(pack_histogram(histogram, size)), SLOTS)
    # The patterns depend on the number of lengths, at most ``size``, not on the rows.
    found = ranked(cut, sum(histogram.values())).join(F.broadcast(places), "length").where("rank >= low and rank < high")
    nth = F.col("rank") - F.col("low")
    return found.select(
        "doc_id",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.col("base") + F.floor(nth / F.col("repeat"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("repeat")) * F.col("length")).cast("long").alias("offset"),
    )
