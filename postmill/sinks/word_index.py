"""Stored posts with an index of their letter groups, so that word searches open few files.

A batch of posts is stored in blocks, one file and folder each. Beside them stand the distinct groups
of three and of five letters of each block's texts, as hashes in order: (group, block). A word can
only occur in a block that holds all its groups, which is read off the index by a pushed
range of hashes; the blocks that are left prune the scan of the posts while it runs.

A batch is there for searches once its name is listed, after posts and groups are complete;
writing it again replaces it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators.predicates import ANYWORDS, NOTWORDS, Expression, PostQuery
from postmill.sinks.curated import curate, search_curated

LENGTHS = (3, 5)
# A word with the space after it and, ahead of the next word, as many letters as a group can reach
# into it; very long words go in stretches.
PIECES = rf"(?s)(?=(\S{{0,24}}+\s{{0,4}}+.{{0,{max(LENGTHS) - 1}}}))\S{{0,24}}+\s{{0,4}}+"
GROUPS = "group bigint, block string"
BATCHES = "batch string"


def letter_groups(piece: Column, n: int) -> Column:
    """Hashes of the overlapping groups of ``n`` letters of a short piece, which is cut at each letter."""
    starts = F.when(F.length(piece) >= n, F.sequence(F.lit(1), F.length(piece) - F.lit(n - 1)))
    return F.coalesce(F.transform(starts, lambda i: F.xxhash64(F.substr(piece, i, F.lit(n)))), F.array().cast("array<bigint>"))


def text_pieces(lowered: Column) -> Column:
    """Distinct short pieces that together hold the same letter groups as the text; none for a null text.

    Words recur far more often than texts do, so that a block has few pieces to take groups from.
    """
    found = F.regexp_extract_all(lowered, F.lit(PIECES), F.lit(1))
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def write_batch(posts: DataFrame, path: str, batch: str, blocks: int | None = None) -> None:
    """Store posts in contiguous stretches of time and index their short and long texts.

    ``blocks`` stretches, by default as many as a shuffle makes.
    """
    spark = posts.sparkSession
    stretches = ([blocks] if blocks else []) + ["created_ms"]
    block = F.concat(F.lit(f"b{batch}-"), F.lpad(F.spark_partition_id().cast("string"), 7, "0"))
    placed = curate(posts).repartitionByRange(*stretches).withColumn("block", block).sortWithinPartitions("created_ms")
    placed.write.mode("overwrite").partitionBy("month", "block").parquet(f"{path}/posts/batch=b{batch}")
    stored = spark.read.schema(placed.schema).parquet(f"{path}/posts/batch=b{batch}")
    texts = [F.lower("text"), F.lower("extended_tweet.full_text")]
    pieces = stored.select(F.explode(F.concat(*[text_pieces(t) for t in texts])).alias("piece"), "block").distinct()
    groups = F.concat(*[letter_groups(F.col("piece"), n) for n in LENGTHS])
    held = pieces.select(F.explode(groups).alias("group"), "block").distinct()
    held = held.repartitionByRange("group", "block").sortWithinPartitions("group", "block")
    held.write.mode("overwrite").parquet(f"{path}/groups/batch=b{batch}")
    listed = spark.createDataFrame([(f"b{batch}",)], BATCHES)
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/batches/of={batch}")


def _listed(spark: SparkSession, path: str, table: str, schema) -> DataFrame:
    """Rows of the batches that are complete; their number is that of write jobs."""
    names = [r.batch for r in spark.read.schema(BATCHES).parquet(f"{path}/batches").collect()]
    rows = spark.read.schema(schema) if schema else spark.read
    return rows.option("basePath", f"{path}/{table}").parquet(*[f"{path}/{table}/batch={n}" for n in names])


def read_posts(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All posts of complete batches."""
    return _listed(spark, path, "posts", schema)


def word_groups(word: str) -> list[str]:
    """The groups that a text with the word holds: the longest that fit; none for short words."""
    n = max((n for n in LENGTHS if n <= len(word)), default=0)
    return sorted({word[i : i + n] for i in range(len(word) - n + 1)}) if n else []


class NeededGroups:
    """What a query's words ask of a block: ``condition`` over flags ``groups``, None if every block may match."""

    def __init__(self, query: PostQuery):
        self.groups: dict[str, str] = {}
        parts = [(p.is_or, self._mixed([(e.is_or, self._expression(e)) for e in p.expressions])) for p in query.predicates]
        self.condition = self._mixed(parts) if parts else None

    def _word(self, word: str) -> Column | None:
        flags = [F.col(self.groups.setdefault(g, f"has_{len(self.groups)}")) for g in word_groups(word)]
        return reduce(lambda a, b: a & b, flags) if flags else None

    def _expression(self, expression: Expression) -> Column | None:
        if expression.kind == NOTWORDS:
            return None
        words = [self._word(w) for w in expression.words]
        if expression.kind == ANYWORDS:
            return None if any(w is None for w in words) else reduce(lambda a, b: a | b, words)
        return self._mixed([(False, w) for w in words])

    @staticmethod
    def _mixed(parts: list[tuple[bool, Column | None]]) -> Column | None:
        """Alternatives of conjunctions; what asks nothing (None) leaves a conjunction and frees an alternative."""
        runs: list[list[Column]] = []
        for is_or, part in parts:
            if is_or or not runs:
                runs.append([])
            if part is not None:
                runs[-1].append(part)
        if not all(runs):
            return None
        return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, run) for run in runs])


def candidate_blocks(groups: DataFrame, query: PostQuery) -> DataFrame | None:
    """(block) of the blocks that can hold a match; None if all can."""
    needed = NeededGroups(query)
    if needed.condition is None:
        return None
    hashes = {name: F.xxhash64(F.lit(group)) for group, name in needed.groups.items()}
    rows = groups.where(F.col("group").isin(list(hashes.values())))
    flags = [F.max(F.col("group") == value).alias(name) for name, value in hashes.items()]
    return rows.groupBy("block").agg(*flags).where(needed.condition).select("block")


def search_indexed(spark: SparkSession, path: str, query: PostQuery, schema: str | None = None) -> DataFrame:
    """``query`` over the stored posts, the same rows as a scan of all of them.

    The blocks that can match are one short row for each file and are broadcast.
    """
    posts = read_posts(spark, path, schema)
    blocks = candidate_blocks(_listed(spark, path, "groups", GROUPS), query)
    if blocks is not None:
        posts = posts.join(F.broadcast(blocks), "block", "left_semi")
    return search_curated(posts, query)
