"""Snapshots, readers and whole jobs over files."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from postmill.operators.geotag import geo_box_query
from postmill.operators.mentions import mentions_ranking
from postmill.operators.predicates import Expression, PostQuery, Predicate
from postmill.operators.search import search_cached
from postmill.plans import jobs
from postmill.sinks.snapshots import SnapshotStore
from postmill.sources import tables, timeline
from postmill.sources.tables import read_page


def land(root, event, hour, name, posts):
    folder = f"{root}/{event}/2024/01/01/{hour:02}"
    os.makedirs(folder, exist_ok=True)
    with gzip.open(f"{folder}/{name}", "wt") as out:
        out.write("\n".join(p if isinstance(p, str) else json.dumps(p) for p in posts))


POSTS = [
    {
        "id_str": "1", "text": "one", "retweet_count": 2, "favorite_count": 3, "user": {"screen_name": "ann", "id_str": "10"},
        "entities": {"user_mentions": [{"id": 5, "screen_name": "new"}, {"id": 5, "screen_name": "old"}, {"id": 6, "screen_name": "six"}]},
        "coordinates": {"coordinates": [10.0, 50.0]},
        "extended_tweet": {"full_text": "long", "entities": {"media": [{"id": 1, "media_url_https": "m1", "expanded_url": "x1"}, {"id": 2, "media_url_https": "m2", "expanded_url": "x2"}]}},
    },
    {"id_str": "2", "retweet_count": 9, "retweeted_status": {"user": {"id_str": "1"}}, "entities": {"user_mentions": [{"id": 5, "screen_name": "x"}]}},
    {"id_str": "3", "retweet_count": 1, "favorite_count": 1, "entities": {"user_mentions": []}, "unknown": {"deep": 1}},
    {"id_str": "4", "retweet_count": 4, "entities": {"user_mentions": [{"screen_name": "anonymous"}, {"id": 6, "screen_name": "six"}]}},
]


@pytest.fixture
def landing(tmp_path):
    root = str(tmp_path / "landing")
    land(root, "storm", 0, "tweet-1704067200000-2.json.gz", POSTS[:2])
    land(root, "storm", 1, "tweet-1704070800000-2.json.gz", POSTS[2:])
    land(root, "other", 0, "tweet-1704067200000-1.json.gz", [{"id_str": "x"}])
    return root


def test_timeline(spark, landing):
    rows = timeline.read_timeline(spark, landing, "storm")
    assert sorted(r.id_str for r in rows.collect()) == ["1", "2", "3", "4"]
    inferred = timeline.read_timeline(spark, landing, "storm", schema=None)
    assert "unknown" in inferred.columns and inferred.count() == 4


def test_mentions(spark, landing):
    rows = {r.user_id: r for r in mentions_ranking(timeline.read_timeline(spark, landing, "storm")).collect()}
    five, six, none = rows[5], rows[6], rows[None]
    assert (five.user, five.times_mentioned, five.total_retweets, five.total_likes) == (["new", "old"], 2, 4, 6)
    assert (six.user, six.times_mentioned, six.total_retweets, six.total_likes) == (["six"], 2, 6, 3)
    assert (none.user, none.times_mentioned, none.total_retweets, none.total_likes) == (["anonymous"], 0, 4, None)


def test_tolerant_and_quarantine(spark, tmp_path):
    root = str(tmp_path)
    land(root, "storm", 0, "a.json.gz", [POSTS[0], '{"id_str": "broken', "", "no json at all"])
    assert [r.id_str for r in timeline.read_tolerant(spark, f"{root}/storm").select("id_str").collect()] == ["1"]
    land(root, "types", 0, "a.json.gz", [POSTS[0], '{"id_str": "9", "retweet_count": "many"}'])
    posts = timeline.read_tolerant(spark, f"{root}/types")
    assert posts.count() == posts.select("id_str").count() == len(posts.collect()) == 1
    assert timeline.read_tolerant(spark, f"{root}/types", None).select("id_str").distinct().count() == 2
    good, bad = timeline.read_quarantined(spark, f"{root}/storm/*/*/*/*/*")
    assert [r.id_str for r in good.collect()] == ["1"]
    assert sorted(r.value for r in bad.collect()) == ["no json at all", '{"id_str": "broken']


def test_event_table(spark, landing):
    name = timeline.register_event_table(spark, landing, "storm")
    assert spark.sql(f"SELECT max(id_str) AS m FROM {name}").first().m == "4"
    assert timeline.register_event_table(spark, "/nowhere", "storm") == name
    spark.catalog.dropTempView(name)


def test_analysis_from_landed_files_to_pages(spark, landing, tmp_path):
    results = str(tmp_path / "results")
    counts = jobs.analyse_event(spark, landing, results, "storm", 1000)
    assert counts == {"mentions": 3, "media": 2, "geotag": 2}
    store = SnapshotStore(spark, results)
    page = jobs.snapshot_page(store, "mentions", "storm", 1, 2).orderBy("position").collect()
    assert [(r.position, r.user_id) for r in page] == [(0, 5), (1, 6)]
    assert [r.user_id for r in jobs.snapshot_page(store, "mentions", "storm", 2, 2).collect()] == [None]
    assert jobs.snapshot_page(store, "media", "storm").count() == 2
    assert jobs.load_geotag_index(store, "storm", 2000) == 1
    assert jobs.load_geotag_index(store, "storm", 2000) == 1
    assert jobs.load_geotag_index(store, "storm", 3000) == 0
    assert jobs.geotag_index(store, "storm").count() == 1
    assert jobs.geotag_index(store, "other").count() == 0
    found = geo_box_query(jobs.geotag_index(store, "storm"), (51.0, 9.0, 49.0, 11.0)).collect()
    assert [(r.event, r.tweet_id_str, r.image_link, r.is_retweet) for r in found] == [("storm", "1", "m1", False)]
    assert abs(found[0].coordinates[0] - 10) < 1e-4 and abs(found[0].coordinates[1] - 50) < 1e-4


def test_collected_stream_is_analysed(spark, tmp_path):
    from postmill.streaming import collect

    feed, root = tmp_path / "feed", str(tmp_path / "landed")
    feed.mkdir()
    (feed / "1").write_bytes(b"\r\n".join(json.dumps(p).encode() for p in POSTS) + b"\r\n\r\n")
    rules = spark.createDataFrame(
        [("storm", "COVID19", None), ("one", "KEYWORDS", "ann new")], tables.TABLES["rules"]
    )
    lines = collect.file_source(spark, str(feed), crlf=True)
    collect.drain(collect.collect_posts(lines, rules, root, str(tmp_path / "ck")))
    store = SnapshotStore(spark, str(tmp_path / "results"))
    posts = timeline.read_collected(spark, root, "storm")
    assert jobs.analyse_posts(store, posts, "storm", 1) == {"mentions": 3, "media": 2, "geotag": 2}
    assert [r.id_str for r in timeline.read_collected(spark, root, "one").collect()] == ["1"]


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    with pytest.raises(FileNotFoundError):
        store.latest("mentions", "e")
    assert store.write(spark.range(5), "mentions", "e", 100) == 5
    assert store.write(spark.range(7).repartition(3), "mentions", "e", 99, fmt="json", compression="gzip") == 7
    assert store.latest("mentions", "e").count() == 5
    assert store.write(spark.range(0), "mentions", "e", 1000) == 0
    assert store.latest_run("mentions", "e")[:3] == (1000, 0, "parquet")
    # A run that is tried again changes nothing.
    assert store.write(spark.range(3), "mentions", "e", 100) == 5
    assert store.runs().where("event = 'e' and run_ms = 100").count() == 1
    assert store.latest_run("mentions", "f") is None
    # Data without a manifest row, as an interrupted run leaves it, is not seen.
    spark.range(9).write.parquet(store._path("mentions", "e", 2000, "0f"))
    assert store.latest_run("mentions", "e").run_ms == 1000
    assert store.write(spark.range(4), "mentions", "e", 2000) == 4 == store.latest("mentions", "e").count()


def test_parts_leave_out_attempts_that_did_not_finish(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    assert store.parts("index", "e", "id bigint").count() == 0
    for run in (1, 2):
        spark.range(100).write.parquet(store._path("index", "e", run, "00"))
        rows = spark.range(run).where(F.lit(True))
        store.write(rows.join(store.parts("index", "e", "id bigint"), "id", "left_anti"), "index", "e", run)
        store.write(rows.join(store.parts("index", "e", "id bigint"), "id", "left_anti"), "index", "e", run)
    assert sorted(r.id for r in store.parts("index", "e", "id bigint").collect()) == [0, 1]


def test_search_results_live_ten_minutes(spark, tmp_path, lines):
    query = PostQuery([Predicate([Expression("ANYWORDS", "b,a")])])
    same = PostQuery([Predicate([Expression("ANYWORDS", "A,b")])])
    root = str(tmp_path / "cache")
    first, second = lines({"id_str": "1", "text": "a"}), lines({"id_str": "2", "text": "a"})

    def run(posts, q, now_ms):
        return [r.id_str for r in search_cached(spark, posts, q, "e", root, now_ms).collect()]

    assert run(first, query, 0) == ["1"]
    assert run(second, same, 599_999) == ["1"]
    assert run(second, same, 600_000) == ["2"]


def test_listing_and_pages_of_named_files(spark, landing):
    from postmill.operators.volume import file_listing, file_offsets

    index = file_offsets(file_listing(tables.stored_files(spark, f"{landing}/storm"), landing))
    assert [(r.filename, r.start_index, r.end_index) for r in index.orderBy("filename").collect()] == [
        ("storm/2024/01/01/00/tweet-1704067200000-2.json.gz", 0, 2),
        ("storm/2024/01/01/01/tweet-1704070800000-2.json.gz", 2, 4),
    ]
    rows = read_page(spark, landing, index, "storm", 2, 1).collect()
    assert [(r.position, json.loads(r.value)["id_str"]) for r in rows] == [(1, "2")]
    rows = read_page(spark, landing, index, "storm", 1, 3).collect()
    assert [json.loads(r.value)["id_str"] for r in rows] == ["1", "2", "3"]


def test_index_job_follows_the_stored_files(spark, landing, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "results"))

    def shown():
        rows = jobs.file_index(store).where("event = 'storm'").orderBy("start_index").collect()
        return [(r.filename.rsplit("/", 1)[1], r.start_index, r.end_index) for r in rows]

    assert jobs.refresh_file_index(store, landing, 1) == 3
    assert shown() == [("tweet-1704067200000-2.json.gz", 0, 2), ("tweet-1704070800000-2.json.gz", 2, 4)]
    land(landing, "storm", 2, "tweet-1704074400000-1.json.gz", POSTS[:1])
    land(landing, "storm", 0, "tweet-1704067200001-1.json.gz", POSTS[:1])
    assert jobs.refresh_file_index(store, landing, 2, [f"{landing}/storm", f"{landing}/other"]) == 5
    assert [s for _, s, _ in shown()] == [0, 2, 3, 5] and shown()[-1][2] == 6
    assert jobs.refresh_file_index(store, landing, 3) == 5


def test_jdbc_options():
    options = tables.jdbc_options("jdbc:x", "events", "id", (1, 100), 4, user="u")
    assert options["numPartitions"] == "4" and options["upperBound"] == "100" and options["user"] == "u"
    with pytest.raises(ValueError):
        tables.jdbc_options("jdbc:x", "events", "id")


def test_json_leaves_out_nulls(spark):
    from postmill.functions.posts import render_post

    row = spark.createDataFrame([("a", None)], "x string, y string").select(render_post(F.struct("*")).alias("j")).first()
    assert row.j == '{"x":"a"}'


def test_scratch_is_below_the_shared_folder(spark):
    from postmill.session import scratch_path

    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second and first.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from postmill.session import scratch_path

    class Context:
        master = "spark://x"

    class Conf:
        @staticmethod
        def get(key, default=None):
            return default

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(RuntimeError):
        scratch_path(Session, "x")
