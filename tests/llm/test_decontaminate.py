import re

import pytest

import __spark_entry__ as entry
from postmill.llm.decontaminate import benchmark_hits, is_contaminated
from postmill.llm.queries import read
from tests.llm.conftest import SMALL

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute(rows, items, n):
    out = []
    for doc_id, text in rows:
        w = words(text)
        hit, ids = set(), set()
        for item_id, item in items:
            v = words(item)
            if item_id is None or not v:
                continue
            size = min(n, len(v))
            wanted = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)}
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in wanted:
                    hit.update(range(i, i + size))
                    ids.add(str(item_id))
        out.append((doc_id, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


def found(frame):
    rows = []
    for r in frame.collect():
        assert r.n_hit == sum(s.end - s.start for s in r.hit_spans)
        assert all(a.end < b.start for a, b in zip(r.hit_spans, r.hit_spans[1:]))
        rows.append((r.doc_id, r.n_words, r.n_hit, r.item_ids))
    return sorted(rows, key=str)


ITEMS = [
    (10, "The quick brown Fox, jumps over the lazy dog."), (2, "quick brown fox jumps over"), (3, "fox"), (4, ""), (5, None), (None, "brown fox jumps"),
    (7, "la la la la la la"), (2, "another text of the same item"), (8, "Été où 12ab ñu straße x"),
]
ROWS = [
    (1, "a quick BROWN fox-jumps over it"), (2, "the quick brown cat"), (3, None), (4, ""), (None, "no id but fox"), (6, "la " * 40),
    (7, "été OÙ 12AB ñu STRASSE"), (7, "Été où 12ab ñu straße x été"), (8, "fox " + "word " * 30_000 + "the quick brown fox jumps over the lazy dog"),
    (9, "another text of the same item"), (9, "another text of the same item"),
]


@pytest.mark.parametrize("n", [1, 3, 5, 13])
@pytest.mark.parametrize("block_bytes", [4 << 20, 40])
def test_same_as_brute_force(spark, docs, n, block_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert found(benchmark_hits(spark, docs(*ROWS), items, n, block_bytes=block_bytes)) == brute(ROWS, ITEMS, n)


def test_empty_tables_and_clashing_columns(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = items.limit(0)
    assert benchmark_hits(spark, docs(), items).count() == 0
    assert found(benchmark_hits(spark, docs((1, "fox")), none)) == [(1, 1, 0, [])]
    frame = benchmark_hits(spark, docs((1, "fox", 5, "x", 2), schema="doc_id long, text string, n_hit int, item_ids string, label int"), items)
    assert frame.columns == ["doc_id", "text", "label", "n_words", "n_hit", "hit_spans", "item_ids"]
    assert found(frame) == [(1, 1, 1, ["3"])]


def test_one_word_in_twenty(spark, docs):
    items = spark.createDataFrame([(1, "fox")], "item_id long, text string")
    rows = [(19, "fox" + " w" * 18), (20, "fox" + " w" * 19), (21, "fox" + " w" * 20), (0, "")]
    judged = benchmark_hits(spark, docs(*rows), items).select("doc_id", is_contaminated().alias("c")).collect()
    assert {r.doc_id: r.c for r in judged} == {19: True, 20: True, 21: False, 0: False}


def test_query_finds_what_brute_force_finds(spark, documents):
    items = [tuple(r) for r in read(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    want = brute([(r.doc_id, r.text) for r in documents.collect()], items, 13)
    got = entry.queries()["op5_decontaminate"](spark, SMALL).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got) == sorted((i, n, h, len(x)) for i, n, h, x in want)


@pytest.mark.parametrize("block_bytes", [4 << 20, 10])
def test_items_without_id_are_hits(spark, docs, block_bytes):
    items = spark.createDataFrame([(None, "purple cats sing"), (None, "a second nameless one"), (1, "red fox"), (2, None)], "item_id long, text string")
    rows = [(1, "the purple cats sing of a red fox"), (2, "purple cats sing"), (3, "a second nameless one"), (4, "nothing")]
    out = benchmark_hits(spark, docs(*rows), items, 13, block_bytes=block_bytes).withColumn("bad", is_contaminated())
    got = {r.doc_id: (r.n_hit, r.item_ids, r.bad) for r in out.collect()}
    assert got == {1: (5, ["1"], True), 2: (3, [], True), 3: (4, [], True), 4: (0, [], False)}
