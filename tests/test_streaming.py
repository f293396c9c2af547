import glob
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from postmill.operators.volume import batch_levels, file_offsets
from postmill.sources.tables import landed_files, read_lines, read_page
from postmill.streaming import collect

CLOCK = 1704067200000


def now():
    return F.timestamp_millis(F.lit(CLOCK))


def put(folder, name, posts):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as out:
        out.writelines(json.dumps(p) + "\n" for p in posts)


def rules(spark, *rows):
    return spark.createDataFrame(list(rows), "event string, match_key string, condition string")


def texts(spark, root, event):
    rows = read_lines(spark, root).where(F.col("event") == event).select(F.get_json_object("value", "$.t").alias("t"))
    return sorted(r.t for r in rows.collect())


def test_landing_layout_and_row_cap(spark, tmp_path):
    feed, root = str(tmp_path / "in"), str(tmp_path / "out")
    put(feed, "1.json", [{"t": f"fire {i:04}"} for i in range(2500)] + [{"t": "rain"}] * 3)
    both = rules(spark, ("burn", "KEYWORDS", "fire"), ("wet", "KEYWORDS", "rain"))
    collect.drain(collect.collect_posts(collect.file_source(spark, feed), both, root, str(tmp_path / "ck"), now))
    files = glob.glob(f"{root}/batch=*/event=burn/year=2024/month=01/day=01/hour=00/*.gz")
    sizes = []
    for f in files:
        with gzip.open(f, "rt") as lines:
            sizes.append(len(lines.readlines()))
    assert sum(sizes) == 2500 and max(sizes) <= 1000
    assert texts(spark, root, "wet") == ["rain"] * 3


def test_restart_adds_only_what_is_new(spark, tmp_path):
    feed, root, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    everything = rules(spark, ("all", "COVID19", ""))

    def run():
        collect.drain(collect.collect_posts(collect.file_source(spark, feed), everything, root, mark, now))

    put(feed, "1.json", [{"t": "a"}, {"t": "b"}])
    run()
    run()
    assert texts(spark, root, "all") == ["a", "b"]
    put(feed, "2.json", [{"t": "c"}])
    run()
    assert texts(spark, root, "all") == ["a", "b", "c"]


def test_failed_batch_is_landed_once(spark, tmp_path):
    feed, root, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    put(feed, "1.json", [{"t": "a"}, {"t": "b"}])
    everything = rules(spark, ("all", "COVID19", ""))
    lines = collect.file_source(spark, feed)

    written = collect.write_hourly

    def written_then_lost(routed, path, *args):
        written(routed, path, *args)
        raise RuntimeError("lost after the write")

    collect.write_hourly = written_then_lost
    try:
        with pytest.raises(Exception, match="lost after the write"):
            collect.drain(collect.collect_posts(lines, everything, root, mark, now))
    finally:
        collect.write_hourly = written
    collect.drain(collect.collect_posts(lines, everything, root, mark, now))
    assert texts(spark, root, "all") == ["a", "b"]


def test_rules_are_read_for_each_batch(spark, tmp_path):
    feed, root = str(tmp_path / "in"), str(tmp_path / "out")
    put(feed, "1.json", [{"t": "fire"}])
    put(feed, "2.json", [{"t": "fire"}])
    os.utime(f"{feed}/1.json", (1, 1))
    calls = []

    def current(session):
        calls.append(1)
        return rules(session, (f"event{len(calls)}", "KEYWORDS", "fire"))

    lines = collect.file_source(spark, feed, files_per_batch=1)
    collect.drain(collect.collect_posts(lines, current, root, str(tmp_path / "ck"), now))
    assert texts(spark, root, "event1") == ["fire"] and texts(spark, root, "event2") == ["fire"]


def test_framed_stream_to_file_sink(spark, tmp_path):
    feed = tmp_path / "in"
    feed.mkdir()
    (feed / "raw").write_bytes(b'{"t":"a\\n"}\r\n\r\n\r\n{"t":"b"}\r\n')
    lines = collect.file_source(spark, str(feed), crlf=True)
    out = str(tmp_path / "out")
    collect.drain(collect.file_sink(lines, out, str(tmp_path / "ck")))
    assert sorted(r.value for r in spark.read.text(out).collect()) == ['{"t":"a\\n"}', '{"t":"b"}']


def test_pages_read_from_landed_files(spark, tmp_path):
    feed, root = str(tmp_path / "in"), str(tmp_path / "out")
    everything = rules(spark, ("all", "COVID19", ""))
    for n in range(3):
        put(feed, f"{n}.json", [{"t": f"{n}-{i}"} for i in range(25)])
    lines = collect.file_source(spark, feed, files_per_batch=1)
    collect.drain(collect.collect_posts(lines, everything, root, str(tmp_path / "ck"), now, rows_per_file=10))
    listing = landed_files(spark, root)
    index = file_offsets(listing, batch_levels()).cache()
    assert index.agg(F.max("end_index")).first()[0] == 75
    pages = [read_page(spark, root, index, "all", p, 20).collect() for p in (1, 2, 3, 4, 5)]
    assert [len(p) for p in pages] == [20, 20, 20, 15, 0]
    assert [r.position for p in pages for r in p] == list(range(75))
    values = [json.loads(r.value)["t"] for p in pages for r in p]
    assert len(set(values)) == 75


def test_kafka_needs_its_connector(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        collect.kafka_source(spark, "localhost:1", "KEYWORDS")


def test_a_line_of_several_events_is_moved_once(spark, tmp_path):
    """The rows that reach the write's shuffle are lines, not pairs of line and event."""
    from postmill.operators.routing import route_sets

    several = rules(spark, ("b", "COVID19", ""), ("a", "KEYWORDS", "fire,rain"), ("c", "KEYWORDS", "rain"))
    lines = spark.createDataFrame([('{"t":"fire"}',), ('{"t":"rain"}',), ('{"t":"x"}',), (None,)], "value string")
    sets = route_sets(lines, several)
    assert sorted((r.events, r.value) for r in sets.where("value is not null").collect()) == [(["a", "b"], '{"t":"fire"}'), (["a", "b", "c"], '{"t":"rain"}'), (["b"], '{"t":"x"}')]
    assert route_sets(lines, rules(spark, ("c", "KEYWORDS", "rain"))).count() == 1
    assert sorted(r.events for r in route_sets(lines, several, max_conditions=1).collect()) == [["a"]] * 2 + [["b"]] * 4 + [["c"]]
    root = str(tmp_path / "out")
    collect.write_hourly(sets, f"{root}/batch=000000000000", now())
    assert texts(spark, root, "a") == ["fire", "rain"] and texts(spark, root, "c") == ["rain"]
