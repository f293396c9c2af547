import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SMALL, words_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage and what comes out."""
    out, docs = [], spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage"))
        stage(spark, docs, SMALL).write.mode("overwrite").parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs.collect(), after))
        docs = after
    return out


def test_names_and_columns(stages):
    assert [n for n, *_ in stages] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "packing"]
    for _, _, after in stages[:-1]:
        assert after.columns == COLUMNS
        assert after.where("n_chars <> length(text)").count() == 0


def test_quality_drops_bad_and_keeps_good(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[0][2].collect()}
    judged = [(q, i in kept) for i, q in labels.items()]
    # This smallest table has 58 rows to learn from; test_classifiers holds the larger one to more.
    assert sum((q == 1) == k for q, k in judged) >= 0.9 * len(judged)


def test_one_of_each_group_stays(stages):
    before, kept = stages[1][1], {r.doc_id for r in stages[1][2].collect()}
    sets = {}
    for r in before:
        w = words_of(r.text)
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}
    near = lambda a, b: sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    ids = sorted(sets)
    label = {i: i for i in ids}
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if near(a, b)]
    for _ in ids:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert pairs and kept == {i for i in ids if label[i] == i}


def test_repeats_go_and_other_texts_stay(stages):
    before = {r.doc_id: r.text for r in stages[2][1]}
    seen = set()
    for r in stages[2][2].orderBy("doc_id").collect():
        old, new = words_of(before[r.doc_id]), words_of(r.text)
        windows = [tuple(old[i : i + 50]) for i in range(len(old) - 49)]
        assert (r.text == before[r.doc_id]) == (len(old) == len(new)) == (not any(w in seen for w in windows))
        seen.update(windows)


def test_contaminated_documents_go(spark, stages):
    gone = {r.doc_id for r in stages[3][1]} - {r.doc_id for r in stages[3][2].collect()}
    assert gone and len(gone) < 0.2 * len(stages[3][1])


def test_packing_holds_every_document(stages):
    totals = stages[4][2].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r.doc_id for r in totals} == {r.doc_id for r in stages[4][1]} and all(r.n == r.t for r in totals)


def test_run_is_the_stages(spark, stages):
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert sorted(map(key, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(key, stages[-1][2].collect()))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_texts_under_one_id_are_documents_of_their_own(spark):
    """The same rows stay however the table is partitioned."""
    words = [f"w{i}" for i in range(60)]
    near, far = " ".join(["x", *words[1:]]), " ".join(reversed(words))
    rows = [
        (5, " ".join(words), "en", "a", 1), (5, far, "en", "a", 2), (5, "a third text here", "en", "a", 3), (5, "a third text here", "de", "a", 3),
        (7, near, "en", "a", 4), (7, "seven words that nobody else has written", "en", "a", 5), (8, None, "en", "a", 6), (8, "", "en", "a", 6), (8, "", "en", "b", 6),
    ]
    kept = set()
    for parts in (1, 2, 3, 5, 9):
        docs = spark.createDataFrame(rows, SCHEMA).repartition(parts, "text", "lang", "n_chars")
        kept.add(tuple(sorted((tuple(r) for r in corpus_pipeline.near_duplicate_stage(spark, docs, SMALL).collect()), key=str)))
    (stay,) = kept
    assert sorted((r[0], r[1]) for r in stay if r[1]) == sorted(
        [(5, " ".join(words)), (5, far), (5, "a third text here"), (7, "seven words that nobody else has written")]
    )
    assert [r[2] for r in stay if r[1] == "a third text here"] == ["de"] and sum(r[0] == 8 for r in stay) == 1


def test_odd_rows_pass_every_stage(spark):
    rows = [(None, "no id", "en", "s", 5), (None, None, None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, "twice " * 60, "en", "s", 360), (5, "twice " * 60, "en", "s", 360)]
    docs = spark.createDataFrame(rows, SCHEMA)
    wide = docs.selectExpr("*", "1 AS position", "'x' AS hash_a", "2 AS n_words", "3 AS row", "'y' AS score")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        for frame, want in ((docs, 5), (wide, 5), (docs.limit(0), 0)):
            n = stage(spark, frame, SMALL).count()
            assert n == want or (n == 6 and stage is not corpus_pipeline.near_duplicate_stage)
    first, last = corpus_pipeline.STAGES[0][1], corpus_pipeline.STAGES[-1][1]
    assert first(spark, wide, SMALL).columns == COLUMNS and first(spark, docs.limit(0), SMALL).count() == 0
    assert last(spark, wide, SMALL).count() == 6 and last(spark, docs.limit(0), SMALL).count() == 0
