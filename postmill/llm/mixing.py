"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions alone.

Each source gets a share of all words by its weight, at most ``most`` times its own words. Inside a
source, documents of nearly one size (an eighth of an octave) form a class; from the largest class to
the smallest each takes a whole number of copies, and the words that rounding leaves open pass on to
the next. Of a class's copies every document first has the same number of certain whole copies; the
rest is a sample of fixed size, in which inclusion probabilities are tilted by size so that the
expected words meet the class's share. The sample is the first ones in Pareto order: random odds
divided by inclusion odds.

Hot sources: only sums per (source, class) and per bucket of the order (4096 to a class) are
aggregated; documents are ranked inside one bucket only. Rows alike in id, source and text are
one unit with a count, folded before the shuffle and dealt out again in chunks.

Defined results: a null text is empty; texts without words take part with size 0 and no words taken.
Null ids, sources and repeated rows are kept; a null source is a source of its own, last in order, and
an empty one the first. Equal documents (id and text) share one random number, so some of them may get
a copy more than others, whichever they are. Other columns are ignored. An empty table gives an
empty result. Random numbers come from a hash of seed, id and text: reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.llm.rows import find_column, quoted
from postmill.operators.paging import with_positions
from postmill.session import scratch_path

BUCKETS = 4096
CHUNK = 10_000


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def size_class(size: str) -> Column:
    """Classes of an eighth of an octave, by integer arithmetic; up to 15 every size has its own."""
    bits = f"length(bin({size}))"
    return F.expr(f"IF({size} < 16, {size}, 8 * {bits} + shiftright({size}, {bits} - 4) - 8)").cast("long")


def documents_as_units(
    docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, keep_text: bool = False
) -> DataFrame:
    """(doc_id, source, draw, size) of every row; ``draw`` is a random whole number below 2**52."""
    own_id, text = quoted(find_column(docs, id_col)).cast("long"), quoted(find_column(docs, text_col)).cast("string")
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(own_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))
    return docs.select(
        own_id.alias("doc_id"),
        quoted(find_column(docs, source_col)).cast("string").alias("source"),
        F.conv(F.substring(mark, 1, 13), 16, 10).cast("long").alias("draw"),
        word_count(text).alias("size"),
        *([text.alias("text")] if keep_text else []),
    )


def source_targets(sources: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: weights repeat along the sources in order.

    The level to which every source below its limit is filled is raised until no source is above
    its limit; each round brings one row of sums to the driver.
    """
    if not weights or min(weights) <= 0 or most < 1:
        raise ValueError("weights are above 0, and sources may be taken at least once")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = with_positions(sources, [F.col("source").isNull(), "source"])
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("position") % len(weights) + 1).cast("int")))
    limit = F.col("source_size") * most
    level, before = 0.0, -1
    while True:
        full = limit <= level * F.col("weight")
        row = ranked.agg(
            F.count(F.when(full, 1)).alias("n"),
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, limit).otherwise(0)).alias("held"),
            F.sum(F.when(~full, F.col("weight"))).alias("free"),
        ).first()
        if row["n"] == before or not row["free"]:
            break
        level, before = float(row["all"] - row["held"]) / row["free"], row["n"] if level else -1
    target = F.least(limit.cast("double"), level * F.col("weight")) if row["free"] else limit.cast("double")
    return ranked.select("source", "source_size", target.alias("target"))


def class_shares(classes: DataFrame, most: int) -> DataFrame:
    """Copies of each (source, class): certain ones, size of the sample, and its tilt by size.

    ``classes`` has a row per source with its classes from the largest on, at most some hundred.
    """
    start = F.struct(F.lit(0.0).alias("open"), F.expr("CAST(array() AS array<struct<class:long,whole:long,take:long,tilt:double>>)").alias("done"))

    def step(state: Column, c: Column) -> Column:
        n, words = c["n"].cast("double"), c["words"].cast("double")
        wanted = F.col("target") / F.col("source_size") * words + state["open"]
        mean = words / n
        copies = F.greatest(F.lit(0).cast("long"), F.least(most * c["n"], F.floor(wanted / mean + 0.5)))
        whole = F.floor(copies / c["n"])
        take = copies - whole * c["n"]
        share = take / n
        spread = F.greatest(c["high"] - mean, mean - c["low"])
        varied = c["squares"].cast("double") - words * mean
        room = 0.9 * F.least(share, 1 - share) / spread
        tilt = F.when(
            (spread > 0) & (varied > 0), F.greatest(-room, F.least(room, (wanted - copies * mean) / varied))
        ).otherwise(F.lit(0.0))
        return F.struct(
            (wanted - copies * mean - tilt * varied).alias("open"),
            F.concat(
                state["done"],
                F.array(F.struct(c["class"].alias("class"), whole.alias("whole"), take.alias("take"), tilt.alias("tilt"))),
            ).alias("done"),
        )

    shares = classes.withColumn("share", F.explode(F.aggregate("classes", start, step)["done"]))
    return shares.select("source", "share.class", "share.whole", "share.take", "share.tilt")


def allot(
    spark: SparkSession,
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    most: int = 3,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Units of equal rows (doc_id, source, draw, size) with their number ``n`` of rows,
    ``source_size`` and ``target`` of the source, ``whole`` copies for each row and ``extra`` more for some."""
    folder = scratch_path(spark, "mixing")
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source"))
    units = documents_as_units(docs, seed, id_col, text_col, source_col)
    units = units.groupBy("doc_id", "source", "draw", "size").agg(F.count(F.lit(1)).alias("n"))
    units.withColumns({"key": key, "class": size_class("size")}).write.parquet(f"{folder}/units")
    units = spark.read.parquet(f"{folder}/units")
    words, big = F.col("n") * F.col("size"), F.col("size").cast("decimal(18,0)")
    sums = units.groupBy("key", "source", "class").agg(
        F.sum("n").alias("n"),
        F.sum(words).alias("words"),
        F.sum((F.col("n") * (big * big)).cast("decimal(38,0)")).alias("squares"),
        F.min("size").alias("low"),
        F.max("size").alias("high"),
    )
    sums.write.parquet(f"{folder}/classes")
    sums = spark.read.parquet(f"{folder}/classes")
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    targets.withColumn("key", key).drop("source").write.parquet(f"{folder}/targets")
    targets = spark.read.parquet(f"{folder}/targets")
    lists = sums.where("class > 0").groupBy("key").agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("class", "n", "words", "squares", "low", "high")))).alias("classes")
    )
    shares = class_shares(lists.join(targets, "key").withColumnRenamed("key", "source"), most).withColumnRenamed("source", "key")
    shares = sums.join(shares, ["key", "class"], "left").join(targets, "key")
    shares.select(
        "key", "class", "n", "words", "source_size", "target", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("whole", "take", "tilt")]
    ).write.parquet(f"{folder}/shares")
    shares = spark.read.parquet(f"{folder}/shares").withColumnsRenamed({"n": "class_n", "words": "class_words"})
    return _sampled(spark, units, shares, folder)


def _sampled(spark: SparkSession, units: DataFrame, shares: DataFrame, folder: str) -> DataFrame:
    """Pareto order inside each class; ``shares`` has a row per class, copied to 64 lanes so that a hot class is no hot key."""
    lane = F.pmod("draw", F.lit(64))
    spread = shares.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))))
    units = units.withColumn("lane", lane).join(spread, ["key", "class", "lane"])
    odds = lambda p: p / (1 - p)
    share = F.col("take") / F.col("class_n")
    chance = share + F.col("tilt") * (F.col("size") - F.col("class_words") / F.col("class_n"))
    random = odds((F.col("draw") + 0.5) / float(1 << 52))
    order = F.when(F.col("take") > 0, random / odds(chance)).otherwise(F.lit(0.0))
    even = F.when(F.col("take") > 0, F.col("order") * odds(share)).otherwise(F.lit(0.0))
    bucket = F.least(F.lit(BUCKETS - 1), F.floor(even / (1 + even) * BUCKETS))
    units = units.withColumn("order", order).withColumn("bucket", bucket).drop("lane")
    units.write.parquet(f"{folder}/ordered")
    units = spark.read.parquet(f"{folder}/ordered")
    earlier = Window.partitionBy("key", "class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = units.groupBy("key", "class", "bucket").agg(F.sum("n").alias("bucket_n"))
    buckets = buckets.withColumn("before", F.coalesce(F.sum("bucket_n").over(earlier), F.lit(0))).drop("bucket_n")
    inside = Window.partitionBy("key", "class", "bucket").orderBy("order", "draw", "doc_id", "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    ranked = units.join(buckets, ["key", "class", "bucket"])
    rank = F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    ranked = ranked.withColumn("extra", F.greatest(F.lit(0).cast("long"), F.least(F.col("n"), F.col("take") - rank)))
    names = ["doc_id", "source", "draw", "size", "n", "source_size", "target", "whole", "extra"]
    ranked.select(*names).write.parquet(f"{folder}/allotted")
    return spark.read.parquet(f"{folder}/allotted")


def rows_taken(allotted: DataFrame) -> DataFrame:
    """A row per input row: doc_id, source, size, source_size, target, copies, taken (words)."""
    few = allotted.where(f"n <= {CHUNK}").withColumn("low", F.lit(0).cast("long"))
    many = allotted.where(f"n > {CHUNK}")
    many = many.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))))
    many = many.repartition("doc_id", "draw", "low")
    at = F.explode(F.sequence("low", F.least(F.col("low") + CHUNK, F.col("n")) - 1))
    rows = few.unionByName(many).withColumn("at", at)
    copies = F.col("whole") + F.when(F.col("at") < F.col("extra"), 1).otherwise(0)
    rows = rows.withColumn("copies", copies.cast("long"))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_texts(
    docs: DataFrame,
    allotted: DataFrame,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: (doc_id, source, text), a row for every copy of a document."""
    texts = documents_as_units(docs, seed, id_col, text_col, source_col, keep_text=True)
    unit = allotted.select(*[F.col(c).alias(f"unit_{c}") for c in ("doc_id", "source", "draw", "size", "n", "whole", "extra")])
    same = F.col("draw") == F.col("unit_draw")
    for c in ("doc_id", "source", "size"):
        same &= F.col(c).eqNullSafe(F.col(f"unit_{c}"))
    found = texts.join(unit, same)
    # Of equal rows some get one more: any of their texts stands for all.
    some = found.where("unit_extra > 0 and unit_extra < unit_n")
    some = some.groupBy("doc_id", "source", "draw", "size", "unit_extra").agg(F.any_value("text").alias("text"))
    repeat = lambda rows, times: rows.where(times > 0).select(
        "doc_id", "source", "text", F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("copy")
    )
    each = F.col("unit_whole") + F.when(F.col("unit_extra") == F.col("unit_n"), 1).otherwise(0)
    return repeat(found, each.cast("long")).unionByName(repeat(some, F.col("unit_extra"))).drop("copy")
