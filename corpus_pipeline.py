"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, folder of tables) and returns a DataFrame; it is written as
Parquet and reread before the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import decontaminate, ngram_join, packing, quality, substrings
from postmill.llm.queries import read, vocabulary
from postmill.operators.paging import with_positions
from postmill.session import scratch_folder, scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones of ``docs``, does not reject."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(spark, docs, model).where("predicted = 1").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document, that with the smallest id.

    Rows are judged by id and text: other texts under one id are documents of their own, of which
    that with the smallest text hash counts as earlier. Of rows equal in id and text one stays, the
    smallest in its other columns. Rows without words link with nothing and stay; so do rows
    without id, which the join does not compare.
    """
    text = F.coalesce("text", F.lit(""))
    key = ["doc_id", "hash_a", "hash_b"]
    keyed = docs.where("doc_id is not null").select(*COLUMNS).withColumns({"hash_a": F.xxhash64(text), "hash_b": F.xxhash64(F.lit(1), text)})
    # The join names its classes by position in (id, text hash); texts stay out of the ranking.
    path = scratch_path(spark, "near-duplicates")
    with scratch_folder(spark, "ranked") as folder:
        with_positions(keyed.select(*key).distinct(), key, folder).write.parquet(path)
    ranked = spark.read.schema("doc_id long, hash_a long, hash_b long, position long").parquet(path)
    joined = ngram_join.jaccard_join(spark, keyed.join(ranked, key).select("position", "text"), id_col="position")
    kept = joined.where("doc_id = component_id").select(F.col("doc_id").alias("position")).distinct()
    stay = keyed.join(ranked.join(kept, "position").drop("position"), key)
    rows = stay.groupBy(*key).agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row")).select("doc_id", "row.*")
    return rows.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the windows of 50 words that an earlier one holds.

    Texts without such windows stay as they are; the others keep their other words with a
    space between, and a document of which no word is left goes.
    """
    cut = substrings.remove_repeats(spark, docs)
    changed = F.col("n_removed") > 0
    cut = cut.where(~changed | (F.col("n_removed") < F.col("n_words")))
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    return cut.withColumns({"n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")), "text": text}).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in 20 lies in a benchmark window of 13 words."""
    found = decontaminate.benchmark_hits(spark, docs, read(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.is_contaminated()).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(spark, docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

# The classifier and the tokeniser cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with their results in the cluster's shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
