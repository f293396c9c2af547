import re
from collections import Counter

import duckdb
import pytest

from postmill.llm import mixing
from postmill.llm.mixing import allot, mixed_texts, rows_taken
from postmill.llm.oracles import MIXING
from postmill.llm.queries import QUERIES
from tests.llm.conftest import SMALL, words_of

SCHEMA = "doc_id long, text string, source string"
COLUMNS = ["doc_id", "size", "source_size", "target", "taken"]
ROWS = [
    *[(i, "w " * (i % 37 + 1), "a") for i in range(300)],
    *[(1000 + i, "v " * (5 * i), "b") for i in range(40)],
    *[(2000, "same words here", "c")] * 25, (2000, "other words here", "c"), (2001, "lone", None), (None, "x y", "c"), (None, None, "d"),
    (5, "", "e"), (6, " \t\n", "e"), (7, "　wide space", ""), (8, "z " * 40_000, "big"), (9, "tiny", "Z"), (9, "tiny", "Z"), (10, "é", "É"),
]


def taken(spark, rows, schema=SCHEMA, **options):
    return rows_taken(allot(spark, spark.createDataFrame(rows, schema).repartition(3), **options))


def plain(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=str)


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({MIXING})").fetchall(), key=str)


def filled(sizes, most=3):
    """Targets by resharing what is above the limit, round after round, as it is worded."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    fixed, rest = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return fixed | share
        for s in above:
            fixed[s] = most * sizes[s]
            rest -= fixed[s]


def test_same_as_sql(spark):
    got = plain(taken(spark, ROWS))
    assert got == by_sql(ROWS) and len(got) == len(ROWS)
    assert plain(taken(spark, ROWS)) == got


def test_targets_and_limits(spark):
    rows = taken(spark, ROWS).collect()
    sizes, got, want = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += r.size
        got[r.source] += r.taken
        want[r.source] = r.target
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
    assert want == pytest.approx(filled(sizes))
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for s in ("a", "b"):
        assert got[s] == pytest.approx(want[s], rel=0.02)
    assert {(r.doc_id, r.size) for r in rows} == {(i, len(words_of(t))) for i, t, _ in ROWS}


def test_whole_table_is_near_its_targets(spark):
    rows = QUERIES["op11_mixing"](spark, SMALL.replace("0.001", "0.01")).collect()
    got, want = Counter(), {}
    for r in rows:
        got[r.source_size, r.target] += r.taken
        want[r.source_size, r.target] = r.target
    for key, target in want.items():
        assert got[key] == pytest.approx(target, rel=0.02)


def test_sample_follows_pareto_order(spark):
    """Of one class the documents with the smallest ratio of random odds to inclusion odds are taken."""
    rows = [(i, "w " * n, "a") for i in range(900) for n in [64 + i % 8]] + [(9999, "v", "b")]
    allotted = allot(spark, spark.createDataFrame(rows, SCHEMA), weights=(1, 1), most=40).where("source = 'a'").collect()
    shares = {(r.source, r["class"]): r for r in _shares(spark, rows)}
    by_class = {}
    for r in allotted:
        by_class.setdefault(re.sub("0b", "", bin(r.size))[:4], []).append(r)
    for mine in by_class.values():
        share = next(s for s in shares.values() if s.low <= mine[0].size <= s.high)
        n, mean = len(mine), sum(r.size for r in mine) / len(mine)
        take = sum(r.extra for r in mine)

        def odds(p):
            return p / (1 - p)

        def ratio(r):
            return odds((r.draw + 0.5) / 2**52) / odds(take / n + share.tilt * (r.size - mean))

        if 0 < take < n:
            chosen = sorted(mine, key=ratio)[:take]
            assert {r.doc_id for r in chosen} == {r.doc_id for r in mine if r.extra}


def _shares(spark, rows):
    from pyspark.sql import functions as F

    units = mixing.documents_as_units(spark.createDataFrame(rows, SCHEMA), 0, "doc_id", "text", "source")
    sums = units.withColumn("class", mixing.size_class("size")).groupBy("source", "class").agg(
        F.count("*").alias("n"), F.sum("size").alias("words"), F.sum(F.expr("CAST(size * size AS decimal(38,0))")).alias("squares"),
        F.min("size").alias("low"), F.max("size").alias("high"),
    )
    targets = mixing.source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), (1, 1), 40)
    lists = sums.groupBy("source").agg(F.reverse(F.array_sort(F.collect_list(F.struct("class", "n", "words", "squares", "low", "high")))).alias("classes"))
    return mixing.class_shares(lists.join(targets, "source"), 40).join(sums, ["source", "class"]).collect()


def test_many_equal_rows_and_the_texts_themselves(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 10)
    rows = [(1, "twice told tale", "a")] * 101 + [(2, "once", "b"), (3, None, "b"), (None, "no id", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    allotted = allot(spark, docs)
    out = rows_taken(allotted)
    assert plain(out) == by_sql(rows)
    copies = Counter()
    for r in out.collect():
        copies[r.doc_id, r.source] += r.copies if r.size else 0
    texts = mixed_texts(docs, allotted).collect()
    assert Counter((r.doc_id, r.source) for r in texts if r.text) == +copies
    assert {(r.doc_id, r.text, r.source) for r in texts} <= set(rows)


def test_empty_table_other_columns_and_wrong_weights(spark):
    assert taken(spark, []).count() == 0
    schema = "doc_id long, text string, source string, size string, n int, draw int, key int, class int, target int"
    row = (1, "a b", "s", "x", 1, 2, 3, 4, 5)
    assert plain(taken(spark, [row], schema)) == by_sql([row[:3]])
    assert plain(taken(spark, [(1, None, None)])) == by_sql([(1, None, None)])
    with pytest.raises(ValueError):
        taken(spark, ROWS, weights=(1, 0))


def test_main_path_has_no_python(spark):
    plan = rows_taken(allot(spark, spark.createDataFrame(ROWS, SCHEMA)))._jdf.queryExecution().toString()
    assert not any(name in plan for name in ("Python", "Arrow", "Pandas", "ExternalRDD"))
