"""Alignment of two tokenizers over a corpus, its pair counts found by external spill counting.

Each text is tokenised twice. Byte offsets where tokens of both sides end cut it into groups,
and all tokens of the two sides that share a group are linked. How many documents hold an id
pair linked is counted in three passes over compressed runs:

1. Tasks sort their (pair, document) records side-major (first by the A id), deal them to
   parts by the A id's low digits, and spill each part as a run compressed with zstandard. Runs
   are rows of a table in the shared folder; a task holds ``spill`` records at a time.
2. The runs of a part are merged with a heap over their next A id; pairs are counted as they
   come out. A part is split into lanes of some input splits each, so that an A id which all
   documents hold is counted by many tasks, each sending one count per pair. As all pairs of an A
   id come together in the order of the parts, its maximum is read off in passing.
3. The counts of a part (bounded by the two vocabularies) meet its runs again, lane by lane, and
   what each document gains from each run is summed up per document.

Defined results: texts that are null or empty, or whose tokens do not spell the text (such as
those with U+2581, which stands for a space on side B), have no tokens and zeros everywhere.
Every row counts as a document of its own, also where ids are null or repeated; ties for an A id's
highest count are all best; other columns are ignored; an empty table gives an empty result.
Texts of any length are taken whole: memory grows with the longest text and with its longest
stretch on which the sides never meet.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.packing import LATIN_END, RARE_SPACE, Encoder, byte_alphabet
from postmill.llm.words import slices
from postmill.session import scratch_path

DOCS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
RECORDS = DOCS + ", part int, lane long, pairs binary, members binary"
SIDE = np.uint64(32)

# A unit starts at a space after a word: neither side has tokens across that place. Other white
# space stays inside units, since side B puts a space before everything it is asked to encode.
UNITS = re.compile(r"[ \t\n\r]*[^ \t\n\r]+(?:[\t\n\r][ \t\n\r]*[^ \t\n\r]+)*(?:[ \t\n\r]+\Z)?|[ \t\n\r]+")


class ByteSide:
    """Ids of a byte-level tokenizer, strings of its special tokens taken as plain text."""

    def __init__(self, path: str):
        self.encoder = Encoder(path)
        self.encoder.added = None
        self.encoder.tokenizer.encode_special_tokens = True
        letters = byte_alphabet()
        vocab = self.encoder.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.by_unit = self.encoder.by_unit

    def __call__(self, text: str) -> np.ndarray:
        quick = self.encoder.latin and not RARE_SPACE.search(text) and max(text) <= LATIN_END
        return np.array(self.encoder.latin(text) if quick else self.encoder.tokenizer.encode(text, add_special_tokens=False).ids)


class PieceSide:
    """Ids of a piece tokenizer, which puts a space before the text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        self.by_unit = not any(re.search(rb"[^ ] ", piece) for piece in self.bytes)

    def __call__(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text[1:]))


class Units:
    """What the units of texts come to on both sides, remembered until there are ``limit`` of them.

    New units are encoded joined together, as no token reaches over a unit's end.
    """

    def __init__(self, a: ByteSide, b: PieceSide, limit: int = 500_000):
        self.sides, self.limit = (a, b), limit
        self.whole = not (a.by_unit and b.by_unit)
        self.sizes = [np.array([len(x) for x in side.bytes]) for side in self.sides]
        self.names = [
            np.array([[f"{i}," for i in range(len(side.bytes))], [f"{i}{end}" for i in range(len(side.bytes))]], object)
            for side, end in zip(self.sides, "|;")
        ]
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.text: list[str] = []
        self.numbers = np.zeros((0, 4), np.int64)
        self.first = np.zeros(1, np.int64)
        self.pairs, self.links = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units of the texts with a space before each, and where each text's begin.

        A text without units is empty or one that either side spells otherwise.
        """
        if len(self.at) > self.limit:
            self.clear()
        names = []
        for text in texts:
            text = " " + text if text else ""
            names.append([text] if text and (self.whole or RARE_SPACE.search(text)) else UNITS.findall(text))
        self._add(list({name for mine in names for name in mine if name not in self.at}))
        find = self.at.__getitem__
        found = [list(map(find, mine)) for mine in names]
        found = [[] if -1 in mine else mine for mine in found]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((u for mine in found for u in mine), np.int64, int(sizes.sum())), np.append(0, np.cumsum(sizes))

    def _add(self, names: list[str], together: int = 1 << 16) -> None:
        alone, joined = [], {True: [[]], False: [[]]}
        held = {True: 0, False: 0}
        for name in names:
            if "▁" in name:
                self.at[name] = -1
            elif self.whole or name[-1].isspace() or RARE_SPACE.search(name):
                alone.append([name])
            else:
                kind = max(name) <= LATIN_END
                joined[kind][-1].append(name)
                held[kind] += len(name)
                if held[kind] > together:
                    joined[kind].append([])
                    held[kind] = 0
        new = [x for group in (*joined[True], *joined[False], *alone) if group for x in self._encoded(group)]
        if new:
            numbers, sizes, pairs, links = zip(*new)
            self.numbers = np.concatenate([self.numbers, *numbers])
            self.first = np.append(self.first, self.first[-1] + np.cumsum(np.concatenate(sizes)))
            self.pairs, self.links = np.concatenate([self.pairs, *pairs]), np.concatenate([self.links, *links])

    def _encoded(self, names: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        text = "".join(names)
        raw, ids = text.encode(), [side(text) for side in self.sides]
        if any(b"".join(map(side.bytes.__getitem__, mine.tolist())) != raw for side, mine in zip(self.sides, ids)):
            if len(names) > 1:
                return [x for name in names for x in self._encoded([name])]
            self.at[text] = -1
            return []
        ends = np.cumsum([len(name.encode()) for name in names])
        self.at.update(zip(names, range(len(self.text), len(self.text) + len(names))))
        return [self._aligned(*ids, ends)]

    def _aligned(self, a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, and counted pairs, of units that end at the byte offsets ``ends``."""
        end_a, end_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        stop_a = end_b[np.searchsorted(end_b, end_a)] == end_a
        stop_b = end_a[np.searchsorted(end_a, end_b)] == end_b
        group_a, group_b = np.cumsum(stop_a) - stop_a, np.cumsum(stop_b) - stop_b
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        unit = np.searchsorted(ends, end_a[stop_a])
        cut = np.searchsorted(unit, np.arange(len(ends) + 1))

        def per_unit(values: np.ndarray) -> np.ndarray:
            return np.add.reduceat(values, cut[:-1])

        numbers = np.stack([per_unit(in_a), per_unit(in_b), np.diff(cut), per_unit(in_a * in_b)], axis=1)
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + first_b[group_a]] = self.names[0][stop_a.astype(int), a]
        out[np.arange(len(b)) + (first_a + in_a)[group_b]] = self.names[1][stop_b.astype(int), b]
        words, where = out.tolist(), np.append(0, np.cumsum(numbers[:, 0] + numbers[:, 1])).tolist()
        self.text += ["".join(words[low:high]) for low, high in zip(where, where[1:])]

        times = np.where(in_a * in_b <= 4096, in_b, 0)[group_a]
        at = np.repeat(first_b[group_a] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
        pairs = [np.repeat(a, times).astype(np.uint64) << SIDE | b[at].astype(np.uint64)]
        owner, links = [np.repeat(unit[group_a], times)], [np.ones(len(at), np.int64)]
        for g in np.flatnonzero(in_a * in_b > 4096):
            x, n = np.unique(a[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
            y, m = np.unique(b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
            pairs.append((x.astype(np.uint64)[:, None] << SIDE | y.astype(np.uint64)).ravel())
            links.append((n[:, None] * m).ravel())
            owner.append(np.full(len(x) * len(y), unit[g]))
        owner, pairs, links = np.concatenate(owner), np.concatenate(pairs), np.concatenate(links)
        order = np.lexsort((pairs, owner))
        owner, pairs, links = owner[order], pairs[order], links[order]
        start = np.flatnonzero(np.append(True, (pairs[1:] != pairs[:-1]) | (owner[1:] != owner[:-1])))
        return numbers, np.bincount(owner[start], minlength=len(ends)), pairs[start], np.add.reduceat(links, start)

    def records(self, units: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, position of the text, links) for each pair of each text."""
        n, size = len(first) - 1, len(self.text) + 1
        held, repeats = np.unique(np.repeat(np.arange(n), np.diff(first)) * size + units, return_counts=True)
        doc, unit = held // size, held % size
        count = self.first[unit + 1] - self.first[unit]
        at = np.repeat(self.first[unit] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        doc, links = np.repeat(doc, count), self.links[at] * np.repeat(repeats, count)
        order = np.lexsort((doc, self.pairs[at]))
        pairs, doc, links = self.pairs[at][order], doc[order], links[order]
        start = np.flatnonzero(np.append(True, (pairs[1:] != pairs[:-1]) | (doc[1:] != doc[:-1])))
        return pairs[start], doc[start], np.add.reduceat(links, start)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length as one compressed block."""
    head = np.array([len(arrays[0])], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(x.tobytes() for x in arrays))


def expand(block: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, at, out = int(np.frombuffer(raw, "<u8", 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


def steps(values: np.ndarray, kind: str) -> np.ndarray:
    """Differences, undone by a running sum."""
    return np.diff(values, prepend=values.dtype.type(0)).astype(kind)


def spill(pairs: np.ndarray, rows: np.ndarray, links: np.ndarray, parts: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(part, its pairs with their numbers of rows, the rows with their links) in side-major order."""
    a = pairs >> SIDE
    order = np.lexsort((rows, pairs, a % np.uint64(parts)))
    pairs, rows, links = pairs[order], rows[order], links[order]
    part = (pairs >> SIDE) % np.uint64(parts)
    for p in np.unique(part):
        low, high = np.searchsorted(part, [p, p + np.uint64(1)])
        mine = pairs[low:high]
        start = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
        counts = np.diff(np.append(start, len(mine)))
        members = squeeze(steps(rows[low:high], "<i8"), links[low:high].astype("<i8"))
        yield int(p), squeeze(steps(mine[start], "<u8"), counts.astype("<i8")), members


def merge(runs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Counts of the pairs of one A id at a time, from (sorted pairs, counts) merged by a heap."""
    edges = []
    for pairs, _ in runs:
        a = pairs >> SIDE
        edges.append([*np.flatnonzero(np.append(True, a[1:] != a[:-1])).tolist(), len(pairs)])
    heap = [(int(pairs[0] >> SIDE), i, 0) for i, (pairs, _) in enumerate(runs) if len(pairs)]
    heapq.heapify(heap)
    while heap:
        a, found, sums = heap[0][0], [], []
        while heap and heap[0][0] == a:
            _, i, k = heap[0]
            low, high = edges[i][k], edges[i][k + 1]
            found.append(runs[i][0][low:high])
            sums.append(runs[i][1][low:high])
            if k + 2 < len(edges[i]):
                heapq.heapreplace(heap, (int(runs[i][0][high] >> SIDE), i, k + 1))
            else:
                heapq.heappop(heap)
        if len(found) == 1:
            yield found[0], sums[0]
            continue
        pairs, counts = np.concatenate(found), np.concatenate(sums)
        order = np.argsort(pairs, kind="stable")
        pairs, counts = pairs[order], counts[order]
        start = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        yield pairs[start], np.add.reduceat(counts, start)


def _tokenised(docs: DataFrame, path_a: str, path_b: str, parts: int, splits: int, limit: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(RECORDS)
        units = Units(ByteSide(path_a), PieceSide(path_b))
        split = TaskContext.get().partitionId()
        row, waiting, held = split << 40, [], 0

        def flush() -> list[tuple]:
            pairs, rows, links = (np.concatenate(x) for x in zip(*waiting))
            return [(*[None] * 7, p, split // splits, k, m) for p, k, m in spill(pairs, rows, links, parts)]

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for low, high, data, offsets in slices(batch.column(1)):
                raw = data.tobytes()
                found, first = units.of([raw[x:y].decode() for x, y in zip(offsets[:-1], offsets[1:])])
                sums = np.vstack([np.zeros(4, np.int64), np.cumsum(units.numbers[found], axis=0)])
                numbers = (sums[first[1:]] - sums[first[:-1]]).tolist()
                names, out = found.tolist(), []
                for d, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    text = "".join([units.text[u] for u in names[x:y]])[:-1].encode()
                    sha = hashlib.sha256(text).hexdigest() if y > x else ""
                    out.append((row + d, ids[low + d], *numbers[d], sha, None, None, None, None))
                pairs, doc, links = units.records(found, first)
                if len(pairs):
                    waiting.append((pairs, doc + row, links))
                    held += len(pairs)
                row += high - low
                if held >= limit:
                    out += flush()
                    waiting, held = [], 0
                yield _batch(out, schema)
        if waiting:
            yield _batch(flush(), schema)

    return docs.mapInArrow(run, RECORDS)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _counted(table: pa.Table) -> pa.Table:
    """Runs of one part and lane -> (part, pair, number of documents)."""
    runs = []
    for block in table.column("pairs"):
        pairs, counts = expand(block.as_py(), "<u8", "<i8")
        runs.append((np.cumsum(pairs, dtype=np.uint64), counts))
    merged = list(zip(*merge(runs)))
    pairs, counts = (np.concatenate(x) for x in merged)
    part = np.full(len(pairs), table.column("part")[0].as_py(), np.int32)
    return pa.table({"part": part, "pair": pairs.view(np.int64), "n": counts})


def _ranked(table: pa.Table) -> pa.Table:
    """(part, pair, n) of one part -> its sorted pairs, counts and marks of the highest per A id."""
    pairs = table.column("pair").to_numpy().view(np.uint64)
    order = np.argsort(pairs)
    pairs, counts = pairs[order], table.column("n").to_numpy()[order]
    a = pairs >> SIDE
    start = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    top = np.repeat(np.maximum.reduceat(counts, start), np.diff(np.append(start, len(a))))
    block = squeeze(steps(pairs, "<u8"), counts.astype("<i8"), (counts == top).astype("<i8"))
    return pa.table({"part": table.column("part")[:1], "counts": pa.array([block], pa.binary())})


def _gained(runs: pa.Table, counts: pa.Table) -> pa.Table:
    """What each document gains from the runs of one part and lane."""
    rows, best, total = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if runs.num_rows and counts.num_rows:
        known, n, top = expand(counts.column("counts")[0].as_py(), "<u8", "<i8", "<i8")
        known = np.cumsum(known, dtype=np.uint64)
        for keys, members in zip(runs.column("pairs"), runs.column("members")):
            pairs, size = expand(keys.as_py(), "<u8", "<i8")
            at = np.repeat(np.searchsorted(known, np.cumsum(pairs, dtype=np.uint64)), size)
            row, links = expand(members.as_py(), "<i8", "<i8")
            mine, where = np.unique(np.cumsum(row), return_inverse=True)
            rows.append(mine)
            for out, gain in ((best, links * top[at]), (total, links * n[at])):
                sums = np.zeros(len(mine), np.int64)
                np.add.at(sums, where, gain)
                out.append(sums)
    return pa.table({"row": np.concatenate(rows), "best": np.concatenate(best), "total": np.concatenate(total)})


def align(
    spark: SparkSession,
    docs: DataFrame,
    path_a: str,
    path_b: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    parts: int = 16,
    splits: int = 16,
    run_records: int = 2_000_000,
) -> DataFrame:
    """A row per document: tokens on both sides, groups, links, links to best partners, summed counts.

    ``path_a`` is a byte-level tokenizer of ``tokenizers``, ``path_b`` a model of ``sentencepiece``.
    ``parts`` radix parts by A id, lanes of ``splits`` input splits, and runs of about ``run_records`` bound
    what one task holds; they do not change the result.
    """
    folder = scratch_path(spark, "alignment")
    texts = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    _tokenised(texts, path_a, path_b, parts, splits, run_records).write.parquet(f"{folder}/records")
    records = spark.read.schema(RECORDS).parquet(f"{folder}/records")
    runs = records.where("part is not null")
    partial = runs.select("part", "lane", "pairs").groupBy("part", "lane").applyInArrow(_counted, "part int, pair long, n long")
    sums = partial.groupBy("part", "pair").agg(F.sum("n").alias("n"))
    sums.groupBy("part").applyInArrow(_ranked, "part int, counts binary").write.parquet(f"{folder}/counts")
    counts = spark.read.schema("part int, counts binary").parquet(f"{folder}/counts")
    # One copy of a part's counts for each lane; their size depends on the vocabularies alone.
    present = spark.read.schema("part int, lane long").parquet(f"{folder}/records").where("part is not null").distinct()
    known = present.join(counts, "part").select("part", "lane", "counts")
    gained = runs.groupBy("part", "lane").cogroup(known.groupBy("part", "lane")).applyInArrow(_gained, "row long, best long, total long")
    gained = gained.groupBy("row").agg(F.sum("best").alias("best"), F.sum("total").alias("total"))
    found = records.where("part is null").join(gained, "row", "left")
    return found.select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("best", F.lit(0)).alias("n_best"),
        F.coalesce("total", F.lit(0)).alias("count_sum"),
        "groups_sha256",
    )
