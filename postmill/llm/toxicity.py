"""Toxicity: a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lowers case, strips accents, maps look-alike letters of other scripts to Latin ones
and digits and signs to the letters they stand for, and makes everything else one space.
The lexicon holds whole words and beginnings of words with the log odds by which they mark
toxic documents; phrases that mark harmless ones are exceptions and void the entries inside
them. A document's summed weight, its weight per word and its heaviest entry are turned into
a probability by small boosted trees.

Lexicon and trees are learned from a bounded sample (``most`` labelled rows, default 20 000)
outside the held-out fold: two thirds of its distinct texts give the lexicon, the rest the
trees. The lexicon is bounded too (``entries``, default 5000). Documents are scored where
they are read.

Defined results: null and empty texts match nothing and get that row's score; without labels
every score is 0.5; rows with a null id are in no fold (``held_out`` false) and never train;
repeated rows are scored alike, texts of any length whole; an empty table gives an empty
result. Input columns are passed through, those named like a result
are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.boosting import Trees, train
from postmill.llm.labelled import fold as fold_of
from postmill.llm.labelled import training_rows
from postmill.llm.rows import add_columns, find_column, quoted
from postmill.session import scratch_path

MOST_ROWS, ENTRIES = 20_000, 5000
PARTS, HELD_OUT = 4, 2

# Letters that look like Latin ones, digits and signs that replace letters.
LOOK_ALIKES = dict(zip(
    "авеёзіјкмнорсԁтухһѕԛԝьαβεηικνορτυχγω",
    "abeezijkmhopcdtyxhsqwbabenikvoptuxyw",
))
DIGITS = dict(zip("013457", "oieast"))
SIGNS = {"@": "a", "$": "s", "!": "i", "€": "e"}
SIGN_INSIDE = re.compile(r"[@$!€](?=\w)")
PREFIXES = (4, 5, 6)


class _Table(dict):
    """Folded form of a character, found at first sight."""

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", chr(code)).lower():
            if unicodedata.category(c) in ("Mn", "Me", "Cf"):
                continue
            c = LOOK_ALIKES.get(c, DIGITS.get(c, c))
            out += c if c.isalnum() else " "
        self[code] = out
        return out


_TABLE = _Table()


def fold(text: str) -> str:
    """Folded words, each with one space before and after it."""
    if SIGN_INSIDE.search(text):
        text = SIGN_INSIDE.sub(lambda m: SIGNS[m[0]], text)
    return " " + " ".join(text.translate(_TABLE).split()) + " "


def patterns(folded: str) -> set[str]:
    """Words (with the space after) and beginnings of words, each with the space before."""
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in PREFIXES if len(word) > n)
    return out


@dataclass
class Lexicon:
    """Entries with weights, and phrases inside which entries do not count."""

    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        if not len(found):
            return None
        found.make_automaton()
        return found


def matches(automaton, folded: str) -> dict[int, float]:
    """Weight of the heaviest entry at each word start, without words inside an exception."""
    best: dict[int, float] = {}
    void: list[tuple[int, int]] = []
    for last, (length, weight) in automaton.iter(folded) if automaton else ():
        start = last - length + 1
        if weight is None:
            void.append((start, last))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    if void:
        void.sort()
        starts, reach = [a for a, _ in void], list(accumulate((b for _, b in void), max))
        ahead = {s: bisect_right(starts, s) for s in best}
        best = {s: w for s, w in best.items() if not ahead[s] or reach[ahead[s] - 1] <= s}
    return best


def features(automaton, folded: str) -> tuple[float, float, float, float]:
    """(summed weight, weight per word, heaviest entry, share of words that match)."""
    found = matches(automaton, folded)
    n = max(folded.count(" ") - 1, 1)
    total = sum(found.values())
    return float(np.log1p(total)), total / n, max(found.values(), default=0.0), len(found) / n


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    for value in batch.column(0):
        yield value.as_py() or ""


def _counted(rows: DataFrame, of, most: int = 500_000) -> DataFrame:
    """(pattern, number of documents, of these labelled 1); summed in each task first, ``most`` patterns at a time."""
    shared = rows.sparkSession.sparkContext.broadcast(of)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value
        both = Counter(), Counter()

        def sums() -> pa.RecordBatch:
            keys = list(both[0].keys() | both[1].keys())
            one = [both[1][k] for k in keys]
            total = [both[0][k] + n for k, n in zip(keys, one)]
            for counter in both:
                counter.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(total, pa.int64()), pa.array(one, pa.int64())], ["pattern", "n", "n_one"]
            )

        for batch in batches:
            for text, label in zip(_texts(batch), batch.column(1).to_pylist()):
                both[label].update(find(fold(text)))
                if len(both[0]) + len(both[1]) > most:
                    yield sums()
        yield sums()

    parts = rows.mapInArrow(count, "pattern string, n long, n_one long")
    return parts.groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("n_one").alias("n_one"))


class Contexts:
    """Phrases of a matched word with the word before or after it."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.found = lexicon, None

    def __getstate__(self):
        return {"lexicon": self.lexicon, "found": None}

    def __call__(self, folded: str) -> set[str]:
        self.found = self.found or self.lexicon.automaton()
        out = set()
        for start in matches(self.found, folded):
            end = folded.index(" ", start + 1)
            before = folded.rfind(" ", 0, start)
            after = folded.find(" ", end + 1)
            if before >= 0:
                out.add(folded[before : end + 1])
            if after >= 0:
                out.add(folded[start : after + 1])
        return out


def learn_lexicon(rows: DataFrame, entries: int = ENTRIES, least: int = 6, least_weight: float = 2.5) -> Lexicon:
    """Entries that mark label 1 in ``rows`` (text, label), and exception phrases.

    A pattern is an entry if at least ``least`` documents labelled 1 hold it and its weight, the
    logarithm of how many times likelier documents labelled 1 are to hold it, is ``least_weight`` or
    more; of these the ``entries`` heaviest stay. Every pattern is weighed, in Spark. Exceptions are
    phrases of an entry and a neighbour that at least ``least`` documents labelled 0 hold and at most
    a quarter of whose documents are labelled 1; the ``entries`` most frequent stay.
    """
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_one, n_zero = sizes.get(1, 0), sizes.get(0, 0)
    odds = F.log((F.col("n_one") + 0.5) / (n_one + 1)) - F.log((F.col("n") - F.col("n_one") + 0.5) / (n_zero + 1))
    weighed = _counted(rows, patterns).where(F.col("n_one") >= least).withColumn("weight", odds)
    heavy = weighed.where(F.col("weight") >= least_weight).orderBy(F.desc("weight"), "pattern").limit(entries)
    lexicon = Lexicon({r["pattern"]: r["weight"] for r in heavy.collect()})
    if not lexicon.weights:
        return lexicon
    around = _counted(rows, Contexts(lexicon)).where(F.col("n") - F.col("n_one") >= least)
    around = around.where("n_one * 4 <= n").orderBy(F.desc("n"), "pattern").limit(entries)
    lexicon.exceptions = {r["pattern"] for r in around.collect()}
    return lexicon


def _measure(lexicon, model: Trees | None):
    shared = lexicon, model

    def make():
        lexicon, model = shared
        lexicon = lexicon.value if hasattr(lexicon, "value") else lexicon
        automaton = lexicon.automaton()

        def run(batch: pa.RecordBatch) -> list:
            x = np.array([features(automaton, fold(t)) for t in _texts(batch)]).reshape(-1, 4)
            return [pa.array(list(x), pa.list_(pa.float64()))] if model is None else [model.probability(x)]

        return run

    return make


def fit(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, parts: int = PARTS, held_out: int = HELD_OUT
) -> tuple[Lexicon, Trees]:
    """Lexicon and calibration from at most ``most`` labelled documents outside the held-out fold."""
    folder = scratch_path(spark, "toxicity")
    training_rows(docs, labels, "toxic", parts, held_out, most).write.parquet(folder)
    rows = spark.read.parquet(folder)
    rows = rows.select("text", "label").dropDuplicates(["text"]).withColumn("third", F.pmod(F.xxhash64("text"), F.lit(3)))
    lexicon = learn_lexicon(rows.where("third > 0").drop("third"))
    shared = spark.sparkContext.broadcast(lexicon)
    rest = rows.where("third = 0").select("text", "label")
    table = add_columns(rest, {"text": "string"}, "x array<double>", _measure(shared, None)).select("x", "label").toArrow()
    x = np.array(table["x"].to_pylist(), float).reshape(-1, 4)
    y = table["label"].to_numpy().astype(float)
    order = np.lexsort((y, *x.T))
    return lexicon, train(x[order], y[order], trees=30, depth=3, least=5)


def score(
    spark: SparkSession, docs: DataFrame, lexicon: Lexicon, model: Trees, threshold: float = 0.3,
    parts: int = PARTS, held_out: int = HELD_OUT, id_col: str = "doc_id",
) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (probability of being toxic) and ``predicted``."""
    mine = F.coalesce(fold_of(quoted(find_column(docs, id_col)), parts) == held_out, F.lit(False))
    scored = add_columns(docs.drop("held_out", "predicted"), {"text": "string"}, "score double", _measure(spark.sparkContext.broadcast(lexicon), model))
    return scored.withColumns({"held_out": mine, "predicted": (F.col("score") >= threshold).cast("int")})
