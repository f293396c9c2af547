import pytest
from pyspark.sql import functions as F

from postmill.functions import text
from postmill.operators import annotations as notes
from postmill.operators import catalogue as cat
from postmill.operators import upsert

EVENT = "name string, normalized_name string, status string, description string, author string"


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(
        [("A b", "a-b", "ACTIVE", "d", "x"), ("C", "c", "NOT_ACTIVE", "d", "y"), ("D", "d", "ACTIVE", "d", "z"), ("E", "e", "ACTIVE", "d", "z")],
        EVENT,
    )


@pytest.fixture(scope="module")
def terms(spark):
    keywords = spark.createDataFrame([("a-b", "y"), ("a-b", "x"), ("a-b", "x"), ("c", "q")], "event_name string, keyword string")
    follows = spark.createDataFrame([("d", "9"), ("gone", "8")], "event_name string, follow string")
    covid19 = spark.createDataFrame([("e",)], "event_name string")
    return keywords, follows, covid19


def test_lists_are_sorted_and_keep_repetitions(events, terms):
    rows = {r.normalized_name: (r.match_key, r.terms) for r in cat.events_with_terms(events, cat.tagged_terms(*terms)).collect()}
    assert rows == {"a-b": ("KEYWORDS", "x,x,y"), "c": ("KEYWORDS", "q"), "d": ("FOLLOWS", "9"), "e": ("COVID19", "")}


def test_active(events, terms):
    assert sorted(r.normalized_name for r in cat.active_events(events, *terms).collect()) == ["a-b", "d", "e"]
    assert sorted(r.keyword for r in cat.active_terms(events, terms[0], "keyword").collect()) == ["x", "y"]
    strings = {r.match_key: r.terms for r in cat.active_term_string(events, cat.tagged_terms(*terms)).collect()}
    assert strings == {"KEYWORDS": "x,y", "FOLLOWS": "9", "COVID19": ""}


def test_long_lists_come_in_chunks(spark, events):
    rows = spark.range(210).select(F.lit("a-b").alias("event_name"), F.lit("KEYWORDS").alias("match_key"),
                                   F.concat(F.repeat(F.lit("x"), 9999), F.col("id").cast("string")).alias("term"))
    chunks = cat.events_with_terms(events, rows).collect()
    assert len(chunks) == len({r.chunk for r in chunks}) > 1 and all(len(r.terms) < 2 * cat.CHUNK_BYTES for r in chunks)
    assert sorted(t for r in chunks for t in r.terms.split(",")) == sorted(r.term for r in rows.collect())


def test_copies_of_one_term_are_split(spark):
    rows = spark.range(1000).select(F.lit("e").alias("event_name"), F.lit(None).cast("string").alias("match_key"), F.lit("abc").alias("term"))
    chunks = cat.gather_terms(rows, ["event_name", "match_key"], chunk_bytes=400).collect()
    assert len(chunks) > 3 and sum(r.terms.count("abc") for r in chunks) == 1000
    assert [r.terms for r in cat.gather_terms(rows, ["event_name", "match_key"], distinct=True).collect()] == ["abc"]


def test_sync_and_log(spark, events):
    running = spark.createDataFrame([("a-b",), ("c",), ("old",)], "normalized_name string")
    diff = cat.sync_diff(events.where("status = 'ACTIVE'"), running)
    assert sorted((r.action, r.normalized_name) for r in diff.collect()) == [
        ("start", "d"), ("start", "e"), ("stop", "c"), ("stop", "old")
    ]
    log = cat.lifecycle_log(diff, "me", F.lit("2024-01-01").cast("timestamp")).collect()
    assert {(r.type, r.event_name) for r in log} == {
        ("START_EVENT", "d"), ("START_EVENT", "e"), ("PAUSE_EVENT", "c"), ("PAUSE_EVENT", "old")
    }


def test_new_events(spark, events):
    terms = spark.createDataFrame([], "event_name string, term string, match_key string")
    activity = spark.createDataFrame([], "type string, time timestamp, author string, event_name string")
    new = spark.createDataFrame(
        [
            ("A  B", "taken", "u", "ACTIVE", "KEYWORDS", ["k"]), ("New One", "d", "u", "ACTIVE", "KEYWORDS", ["x", "y"]),
            ("new one", "second", "u", "ACTIVE", "FOLLOWS", ["1"]), ("Bad", "", "u", "ACTIVE", "KEYWORDS", ["k"]),
        ],
        "name string, description string, author string, status string, match_key string, keywords array<string>",
    )
    rows = cat.add_events(events, terms, activity, new, F.lit("2024-01-01").cast("timestamp"))
    heads, words, log = ([tuple(r) for r in part.collect()] for part in rows)
    assert heads == [("New One", "new-one", "ACTIVE", "d", "u")]
    assert sorted(words) == [("new-one", "x", "KEYWORDS"), ("new-one", "y", "KEYWORDS")]
    assert [(r[0], r[2], r[3]) for r in log] == [("CREATE_EVENT", "u", "new-one")]


def test_status_change(spark, events):
    changes = spark.createDataFrame([("c", "FAILED")], "normalized_name string, status string")
    got = {r.normalized_name: r.status for r in cat.set_status(events, changes).collect()}
    assert got == {"a-b": "ACTIVE", "c": "FAILED", "d": "ACTIVE", "e": "ACTIVE"}


def test_detail_keeps_activity_in_time_order(spark, events, terms):
    log = spark.createDataFrame(
        [("PAUSE_EVENT", "2024-01-02", "u", "a-b"), ("CREATE_EVENT", "2024-01-01", "u", "a-b"), ("START_EVENT", "2024-01-01", "u", "zzz")],
        "type string, time string, author string, event_name string",
    ).withColumn("time", F.col("time").cast("timestamp"))
    rows = cat.event_detail(events, cat.tagged_terms(*terms), log).collect()
    assert [(r.normalized_name, r.activity_type) for r in rows if r.kind == "activity"] == [
        ("a-b", "CREATE_EVENT"), ("a-b", "PAUSE_EVENT")
    ]
    assert [r.normalized_name for r in rows if r.kind == "event"] == ["a-b", "c", "d", "e"]
    one = cat.event_detail(events, cat.tagged_terms(*terms), log, "d").collect()
    assert [(r.kind, r.normalized_name, r.terms) for r in one] == [("event", "d", None), ("terms", "d", "9")]


def test_validation(spark):
    rows = spark.createDataFrame(
        [("My  Event!", "d", ["k"]), ("", None, []), (None, "d", None)], "name string, description string, keywords array<string>"
    )
    got = [(r.normalized_name, r.reasons) for r in cat.validate_events(rows).collect()]
    assert got == [("my-event", []), ("", ["name", "description", "keywords"]), (None, ["name", "keywords"])]
    marks = spark.createDataFrame([("Very Bad", "1", "e", "t"), ("!", "", "e", None)], "tag string, tweet_id string, event_name string, tweet string")
    assert [(r.tag, r.reasons) for r in cat.validate_annotations(marks).collect()] == [
        ("very-bad", []), ("", ["tag", "tweet_id", "tweet"])
    ]


def test_slugs(spark):
    rows = spark.createDataFrame([("2018 Winter \t Storm",), ("Ünder_score-X",), ("",)], "v string")
    got = [tuple(r) for r in rows.select(text.slug(F.col("v")), text.table_name(text.slug(F.col("v")))).collect()]
    assert got == [("2018-winter-storm", "2018_winter_storm"), ("nderscore-x", "nderscore_x"), ("", "")]


MARK = "tweet_id string, tag string, event_name string, authuser string"


def test_annotation_lookup(spark):
    marks = spark.createDataFrame([("1", "a", "e", None), ("1", "b", "e", None), ("2", "a", "f", None)], MARK)
    count = lambda *a, **k: notes.annotation_lookup(marks, *a, **k).count()
    assert (count(), count("e"), count("e", ["1"]), count("e", []), count("e", ["2"]), count("e", ["1"], "b")) == (3, 2, 2, 2, 0, 1)
    assert count(None, marks.where("event_name = 'f'")) == 1


def test_annotation_delete_removes_orphans_only(spark):
    marks = spark.createDataFrame([("1", "a", "e", None), ("1", "b", "e", None), ("2", "a", "e", None)], MARK)
    posts = spark.createDataFrame([("1",), ("2",), ("3",)], "tweet_id string")
    left, kept = notes.delete_annotations(posts, marks, marks.where("tag = 'a'"))
    assert sorted(r.tweet_id for r in left.collect()) == ["1", "3"]
    assert [(r.tweet_id, r.tag) for r in kept.collect()] == [("1", "b")]


def test_add_annotations_ignores_known_keys(spark):
    marks = spark.createDataFrame([("1", "a-b", "e", "old")], MARK)
    posts = spark.createDataFrame([("1", "text")], "tweet_id string, tweet string")
    new = spark.createDataFrame(
        [("1", "A b", "e", "new", "other"), ("2", "c", "e", "u", "t2"), ("2", "c", "e", "v", "t3")], MARK + ", tweet string"
    )
    tweets, annotations = notes.add_annotations(posts, marks, new)
    assert sorted(tuple(r) for r in tweets.collect()) == [("1", "text"), ("2", "t2")]
    assert sorted(tuple(r) for r in annotations.collect()) == [("1", "a-b", "e", "old"), ("2", "c", "e", "u")]


def test_upsert_null_keys_never_conflict(spark):
    target = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    batch = spark.createDataFrame([("a", 9), ("b", 5), ("b", 4), (None, 2), (None, 7)], "k string, v int")
    rows = map(tuple, upsert.insert_or_ignore(target, batch, ["k"]).collect())
    assert sorted(rows, key=str) == sorted([("a", 1), (None, 2), ("b", 4), (None, 2), (None, 7)], key=str)


def test_exists(spark):
    wanted = spark.createDataFrame([("a",), ("x",)], "k string")
    table = spark.createDataFrame([("a",), ("a",)], "k string")
    assert sorted(map(tuple, upsert.exists_flags(wanted, table, ["k"]).collect())) == [("a", True), ("x", False)]
