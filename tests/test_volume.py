import random

import pytest
from pyspark.sql import functions as F

from postmill.operators import paging, volume


def name(event, ms, n):
    import datetime

    at = datetime.datetime.fromtimestamp(ms / 1000, datetime.timezone.utc)
    return f"{event}/{at:%Y/%m/%d/%H}/tweet-{ms}-{n}.json.gz"


BASE = 1704067200000


def listing(spark, names):
    return volume.file_listing(spark.createDataFrame([(n,) for n in names], "filename string"))


def offsets(names):
    """Plain loop over sorted names."""
    out, at = [], {}
    for n in sorted(names):
        event, size = n.split("/")[0], int(n.removesuffix(".json.gz").split("-")[-1])
        start = at.get(event, 0)
        at[event] = start + size
        out.append((event, n, start, start + size))
    return sorted(out)


def shown(index):
    return sorted((r.event, r.filename, r.start_index, r.end_index) for r in index.collect())


@pytest.fixture(scope="module")
def names():
    rng = random.Random(11)
    return sorted(
        {name(e, BASE + rng.randint(0, 4 * 86400) * 1000 + rng.randint(0, 3), rng.choice([0, 1, 5, 1000]))
         for e in ("a", "bigger-event") for _ in range(150)}
    )


def test_names_are_parsed_and_others_skipped(spark):
    rows = listing(spark, ["e/2024/01/01/00/tweet-1704067200000-12.json.gz", "e/readme.txt", "e/x.json.gz", "e/a-b-c.json.gz"])
    assert [tuple(r) for r in rows.collect()] == [
        ("e", "e/2024/01/01/00/tweet-1704067200000-12.json.gz", 1704067200000, 12)
    ]


def test_root_is_cut_from_paths(spark):
    files = spark.createDataFrame([("file:///data/x/e/t-1-2.json.gz",), ("/data/x/e/t-1-3.json.gz",)], "filename string")
    got = sorted(r.filename for r in volume.file_listing(files, "file:/data/x/").collect())
    assert got == ["e/t-1-2.json.gz", "e/t-1-3.json.gz"]


def test_offsets_have_no_gaps(spark, names):
    assert shown(volume.file_offsets(listing(spark, names))) == offsets(names)


def test_refresh_appends(spark, names):
    half = [n for n in names if n < names[len(names) // 2]]
    index = volume.file_offsets(listing(spark, half))
    assert shown(volume.index_refresh(index, listing(spark, names))) == offsets(names)


def test_refresh_of_an_empty_index(spark, names):
    index = volume.file_offsets(listing(spark, names)).where("false")
    assert shown(volume.index_refresh(index, listing(spark, names))) == offsets(names)


def test_refresh_redoes_the_tail_for_a_late_file(spark):
    files = [name("e", BASE + i * 60000, 10) for i in range(30)]
    late = files[25]
    index = volume.file_offsets(listing(spark, [f for f in files if f != late]))
    assert shown(volume.index_refresh(index, listing(spark, files))) == offsets(files)


def test_refresh_finds_files_however_late_and_in_a_part_of_the_listing(spark):
    files = [name("e", BASE + i * 60000, 10) for i in range(30)]
    other = [name("f", BASE, 3)]
    index = volume.file_offsets(listing(spark, [f for f in files if f not in (files[3], files[20])] + other))
    assert shown(volume.index_refresh(index, listing(spark, [files[3], files[20], files[20]]))) == offsets(files + other)


def test_page_files_keep_middle_files_and_order(spark):
    files = [name("e", BASE + i * 1000, n) for i, n in enumerate([10, 5, 0, 5, 10])]
    index = volume.file_offsets(listing(spark, files))
    assert [r.filename for r in volume.page_files(index, 8, 21, "e").collect()] == [files[i] for i in (0, 1, 3, 4)]
    assert [r.filename for r in volume.page_files(index, 0, 10).collect()] == [files[0]]


def test_bucket_labels_and_sums(spark):
    files = [name("e", BASE, 3), name("e", BASE + 3599999, 4), name("e", BASE + 3600000, 5)]
    index = volume.file_offsets(listing(spark, files))
    rows = {b: [(r.time, r["count"]) for r in volume.bucket_counts(index, b, "e").collect()] for b in ("hour", "day", "month")}
    assert rows["hour"] == [("2024-01-01T00:00:00", 7), ("2024-01-01T01:00:00", 5)]
    assert rows["day"] == [("2024-01-01T00:00:00", 12)]
    assert rows["month"] == [("2024-01-00T00:00:00", 12)]
    with pytest.raises(ValueError):
        volume.bucket_counts(index, "week")


def test_totals_mark_events_without_files(spark, names):
    events = spark.createDataFrame([("a",), ("none",)], "event string")
    index = volume.file_offsets(listing(spark, names))
    got = {r.event: r.total_count for r in volume.event_totals(index, events).collect()}
    assert got == {"a": max(o[3] for o in offsets(names) if o[0] == "a"), "none": -1}


def test_latest(spark, names):
    index = volume.file_offsets(listing(spark, names))
    got = sorted(r.filename for r in volume.latest_files(index, 3).collect())
    assert got == sorted(n for e in ("a", "bigger-event") for n in sorted(x for x in names if x.startswith(e + "/"))[-3:])


def test_pages_partition_a_result(spark):
    rows = spark.range(250).withColumn("k", F.col("id") % 7).cache()
    order = [F.desc("k"), F.col("id")]
    ranked = paging.with_positions(rows.repartition(5), order).cache()
    wanted = [r.id for r in rows.orderBy(*order).collect()]
    top = [r.id for p in (1, 2, 3, 4) for r in paging.page_results(rows, order, p, 100).collect()]
    deep = [r.id for p in (1, 2, 3, 4) for r in paging.page_by_position(ranked, p, 100).orderBy("position").collect()]
    assert top == wanted and deep == wanted
    assert [r.position for r in ranked.orderBy("position").collect()] == list(range(250))


@pytest.mark.parametrize(
    "page,count,want", [(1, 100, (3, 100, "ok")), (3, 100, (3, 50, "ok")), (4, 100, (3, 0, "out_of_range")), (1, 250, (1, 250, "ok"))]
)
def test_page_meta(spark, page, count, want):
    row = paging.page_meta(spark.range(250), "e", page, count).first()
    assert (row.num_pages, row.tweet_count, row.status) == want and row.total_count == 250


def test_page_arguments():
    for page, count in ((0, 1), (1, 0), (1, 1001)):
        with pytest.raises(ValueError):
            volume.page_positions(page, count)
