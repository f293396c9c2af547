"""Quality classifier: boosted trees over statistics of whole texts.

The model is trained on a bounded sample (``most`` labelled rows, default 20 000) outside the
held-out fold; only the sample's statistics reach the driver. Every document is scored where
it is read, without a shuffle.

Defined results: null and empty texts have all statistics 0 and get that row's score; without
labels every score is 0.5; rows with a null id are in no fold (``held_out`` false) and never
train; repeated rows are scored alike, texts of any length whole; an empty table gives an
empty result. Input columns are passed through, those named like a
result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.boosting import Trees, train
from postmill.llm.labelled import fold, training_rows
from postmill.llm.rows import add_columns, find_column, quoted
from postmill.llm.words import SPACES, U64, Words, slices

MOST_ROWS = 20_000
PARTS, HELD_OUT = 3, 1

# Classes of bytes whose shares are statistics.
GROUPS = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t",
    "line": b"\n\r",
    "stop": b".,;:?'\"()-",
    "bang": b"!",
    "bar": b"|",
    "mark": b"#$%&*",
    "other": b"/\\@<>[]{}=+_~^`",
}
_CLASS = np.full(256, len(GROUPS), np.uint8)
for _i, _letters in enumerate(GROUPS.values()):
    _CLASS[list(_letters)] = _i
NAMES = [
    "log_bytes", "log_words", *GROUPS, "wide", "word_mean", "word_deviation", "word_longest", "distinct_words",
    "top_word", "distinct_pairs", "distinct_triples", "log_lines", "distinct_lines", "line_words", "upper_words", "ended_words",
    "bytes_per_distinct_word", "short_words",
]


def _distinct(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: how many different keys, and how often the most frequent one occurs."""
    both = key + doc.astype(U64) * U64(0x9E3779B97F4A7C15)
    order = np.argsort(both)
    both, doc = both[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = both[1:] != both[:-1]
    heads = np.flatnonzero(new)
    top = np.zeros(n)
    np.maximum.at(top, doc[heads], np.diff(np.append(heads, len(doc))))
    return np.bincount(doc[heads], minlength=n).astype(float), top


def statistics(column: pa.Array) -> np.ndarray:
    """A row of ``NAMES`` for every text."""
    out = [_statistics(data, offsets) for _, _, data, offsets in slices(column)]
    return np.concatenate(out) if out else np.zeros((0, len(NAMES)))


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets)
    whole = np.maximum(size, 1)
    doc_of_byte = np.repeat(np.arange(n), size)
    width = len(GROUPS) + 1
    classes = np.bincount(doc_of_byte * width + _CLASS[data], minlength=n * width).reshape(n, width)
    words = Words(data, offsets, SPACES)
    count = words.counts()
    some = np.maximum(count, 1)
    doc = words.doc_of()
    length = (words.end - words.start).astype(float)
    mean = np.bincount(doc, length, n) / some
    square = np.bincount(doc, length**2, n) / some
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    distinct, top = _distinct(doc, words.hashes(), n)
    grams = []
    for k in (2, 3):
        key, inside = words.grams(k)
        own = doc[: len(key)][inside]
        grams.append(_distinct(own, key[inside], n)[0] / np.maximum(np.bincount(own, minlength=n), 1))
    breaks = np.zeros(256, bool)
    breaks[[10, 13]] = True
    lines = Words(data, offsets, breaks)
    n_lines = np.maximum(lines.counts(), 1)
    line_kinds, _ = _distinct(lines.doc_of(), lines.hashes(), n)
    first, last = data[words.start], data[words.end - 1]
    caps = (_CLASS[first] == 1) & (length > 1) & (_CLASS[data[np.minimum(words.start + 1, len(data) - 1)]] == 1) if len(words) else np.zeros(0, bool)
    ended = (last >= 33) & (last < 127) & ~np.isin(_CLASS[last], (0, 1, 2)) if len(words) else np.zeros(0, bool)
    columns = [
        np.log1p(size), np.log1p(count), *(classes / whole[:, None]).T, mean, np.sqrt(np.maximum(square - mean**2, 0)), longest,
        distinct / some, top / some, *grams, np.log1p(lines.counts()), line_kinds / n_lines, count / n_lines,
        np.bincount(doc, caps, n) / some, np.bincount(doc, ended, n) / some, size / np.maximum(distinct, 1),
        np.bincount(doc, length <= 3, n) / some,
    ]
    return np.stack(columns, axis=1).astype(float)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, parts: int = PARTS, held_out: int = HELD_OUT, **settings) -> Trees:
    """Trees trained on at most ``most`` labelled documents outside the held-out fold."""

    def make():
        return lambda batch: [pa.array(list(statistics(batch.column(0))), pa.list_(pa.float64()))]

    rows = training_rows(docs, labels, "quality", parts, held_out, most)
    table = add_columns(rows, {"text": "string"}, "x array<double>", make).select("x", "label").toArrow()
    x = np.array(table["x"].to_pylist(), float).reshape(-1, len(NAMES))
    # Rows arrive in any order; sums of floats must not depend on it.
    y = table["label"].to_numpy().astype(float)
    order = np.lexsort((y, *x.T))
    return train(x[order], y[order], **settings)


def score(
    spark: SparkSession, docs: DataFrame, model: Trees, threshold: float = 0.5, parts: int = PARTS, held_out: int = HELD_OUT, id_col: str = "doc_id"
) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (probability of good quality) and ``predicted``."""
    shared = spark.sparkContext.broadcast(model)

    def make():
        trees = shared.value
        return lambda batch: [trees.probability(statistics(batch.column(0)))]

    mine = F.coalesce(fold(quoted(find_column(docs, id_col)), parts) == held_out, F.lit(False))
    scored = add_columns(docs.drop("held_out", "predicted"), {"text": "string"}, "score double", make)
    return scored.withColumns({"held_out": mine, "predicted": (F.col("score") >= threshold).cast("int")})
