"""Grouping of spelling variants: words one edit apart, found by an index of variable-length grams.

Words are counted over whole texts. Grams of two to ``LONGEST`` letters that are frequent among
the words are pruned from the dictionary in favour of longer ones: a word (with marks around it)
is cut at every place into the gram from there on, lengthened while it is frequent; grams inside an earlier
gram are dropped. An edit changes only grams that end at most ``LONGEST`` letters after it, and at most
``bound`` of a word's grams at once, counted for each word. So of the grams that two near words share the
first one, in a fixed order with the rarest first, is among the first ``bound + 1`` of either word: only
these lists are merged. A list is kept by gram, side and length: what lies between the gram and
the word's start (or end) must be equal too when the edit lies on the other side, and lengths
differ by one at most. Pairs that meet are verified by edit distance.

At most one letter of a word in ``one_in`` is deleted first, chosen by a checksum of the document's id and the
word (typing errors whose right form is known); ``one_in=None`` leaves texts as they are.

The dictionary has less than ``3 * frequent`` entries whatever the number of words, since a frequent gram
covers more than that share of all places; it is the only thing sent to every task. Counts are
folded before shuffles; lists are joined, so that Spark's skew handling splits long ones. All joins merge:
by file size Spark would take words, and the lists made of them, for small and broadcast them. A chain of forms
has at most as many steps as the largest count has bits, and is followed by doubling.

Defined results: null and empty texts have no words; a null id is an empty text in the checksum;
repeated rows count as often as they occur; ties go to the smallest word in code-point order; other columns are
ignored; an empty table gives an empty result. Texts and words of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.rows import find_column, quoted
from postmill.session import scratch_path

SHORTEST, LONGEST = 2, 4
BEFORE, AFTER = "\x02" * (LONGEST - 1), "\x03" * (LONGEST - 1)
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_counts(
    docs: DataFrame,
    one_in: int | None = 97,
    least_length: int = 5,
    least_count: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(word, n) of the words of whole texts."""
    text = quoted(find_column(docs, text_col)).cast("string")
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    runs = docs.select(
        F.coalesce(quoted(find_column(docs, id_col)).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lowered, F.lit(f"({LETTERS})"), 0)).alias("word"),
    )
    if one_in:
        mark = F.crc32(F.concat_ws(":", "id", "word"))
        at = (mark % F.char_length("word")).cast("int")
        shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
        runs = runs.withColumn("word", F.when(mark % one_in == 0, shorter).otherwise(F.col("word")))
    counts = runs.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least_count)


def frequent_grams(words: DataFrame, frequent: int) -> dict[str, int]:
    """Counts of the grams that cover more than one place in ``frequent``."""
    marked = F.concat(F.lit(BEFORE), "word", F.lit(AFTER))
    places = words.agg(F.sum(F.char_length("word") + len(BEFORE))).first()[0] or 0
    lengths = F.explode(F.array(*[F.lit(q) for q in range(SHORTEST, LONGEST + 1)]))
    cut = words.select(marked.alias("marked"), lengths.alias("q"))
    starts = F.sequence(F.lit(1), F.char_length("marked") - F.col("q") + 1)
    grams = cut.select("marked", "q", F.explode(starts).alias("at")).select(F.substring("marked", F.col("at"), F.col("q")).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return {r["gram"]: r["n"] for r in counts.where(F.col("n") > places / frequent).collect()}


def decompose(marked: str, frequent: dict[str, int]) -> list[tuple[int, int]]:
    """(start, end) of the grams of a word that already has its marks."""
    size, furthest, out = len(marked), 0, []
    for start in range(size - SHORTEST + 1):
        end = start + SHORTEST
        while end < size and end - start < LONGEST and marked[start:end] in frequent:
            end += 1
        if end > furthest:
            out.append((start, end))
            furthest = end
    return out


def bound(grams: list[tuple[int, int]], letters: int) -> int:
    """Most grams that one edit among ``letters`` letters can change; always less than there are."""
    change = [0] * (letters + 2)
    for _, end in grams:
        # Edits at end - LONGEST ... end - 1, counted from the first letter.
        low, high = end - LONGEST - len(BEFORE), end - 1 - len(BEFORE)
        if high >= 0 and low <= letters:
            change[max(low, 0)] += 1
            change[min(high, letters) + 1] -= 1
    most = now = 0
    for step in change:
        now += step
        most = max(most, now)
    return most


def list_keys(word: str, frequent: dict[str, int]) -> list[tuple[str, int, str]]:
    """(side, length, letters) of the lists in which a word is kept."""
    marked = BEFORE + word + AFTER
    grams = decompose(marked, frequent)
    ranked = sorted(grams, key=lambda g: (frequent.get(marked[g[0] : g[1]], 0), marked[g[0] : g[1]], g[0]))
    out = []
    for start, end in ranked[: bound(grams, len(word)) + 1]:
        out.append((f"{end - start}<", len(word), marked[:end]))
        out.append((f"{end - start}>", len(word), marked[start:]))
    return out


def _lists(words: DataFrame, frequent: dict[str, int], shift: int) -> DataFrame:
    """(key, word): the lists of each word, or those of words one letter shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owner = [], []
            for i, word in enumerate(batch.column(0).to_pylist()):
                for side, length, letters in list_keys(word, frequent):
                    keys.append(xxhash.xxh64_intdigest(f"{length - shift}{side}{letters}") - (1 << 63))
                    owner.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(0).take(pa.array(owner, pa.int32()))], ["key", "word"])

    return words.select("word").mapInArrow(run, "key long, word string")


def near_words(words: DataFrame, frequent: dict[str, int]) -> DataFrame:
    """(a, b): pairs of words one inserted, deleted or replaced letter apart, each once."""
    kept = _lists(words, frequent, 0)
    longer = _lists(words, frequent, 1).select("key", F.col("word").alias("a")).hint("merge").join(kept.select("key", F.col("word").alias("b")), "key")
    other = _lists(words, frequent, 0).select("key", F.col("word").alias("b"))
    equal = kept.select("key", F.col("word").alias("a")).hint("merge").join(other, "key").where("a < b")
    met = longer.select("a", "b").unionByName(equal.select("a", "b"))
    return met.where(F.levenshtein("a", "b", 1) == 1).distinct()


def group_variants(
    spark: SparkSession,
    docs: DataFrame,
    one_in: int | None = 97,
    least_length: int = 5,
    least_count: int = 3,
    factor: int = 2,
    frequent: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row per word: word, form, root, n, n_near, form_n.

    A word's form is its most counted near word, if that has ``factor`` times its count; the root
    is where the forms end. ``least_length`` is 3 at least, so that no edit can change all grams.
    """
    if least_length < 3 or factor < 2:
        raise ValueError("words have at least 3 letters, and forms at least twice the count")
    folder = scratch_path(spark, "variants")
    word_counts(docs, one_in, least_length, least_count, id_col, text_col).write.parquet(f"{folder}/words")
    words = spark.read.schema("word string, n long").parquet(f"{folder}/words")
    near_words(words, frequent_grams(words, frequent)).write.parquet(f"{folder}/near")
    near = spark.read.schema("a string, b string").parquet(f"{folder}/near")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.hint("merge").join(words.select(F.col("word").alias("b"), "n"), "b")
    best = counted.groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("b").alias("form"))).alias("best")
    )
    strong = -F.col("best.less") >= factor * F.col("n")
    found = words.hint("merge").join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(strong, F.col("best.form")).alias("form"),
        F.when(strong, -F.col("best.less")).alias("form_n"),
    )
    found.write.parquet(f"{folder}/forms")
    found = spark.read.schema("word string, n long, n_near long, form string, form_n long").parquet(f"{folder}/forms")
    ends = found.where("form is not null").select("word", F.col("form").alias("root"))
    most = found.agg(F.max("n")).first()[0] or 0
    for step in range(max(most, 1).bit_length().bit_length()):
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends.hint("merge").join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")).write.parquet(f"{folder}/ends-{step}")
        ends = spark.read.schema("word string, root string").parquet(f"{folder}/ends-{step}")
    return found.hint("merge").join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
