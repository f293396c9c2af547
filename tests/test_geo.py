import random

import pytest
from pyspark.sql import functions as F

from postmill.functions import geo
from postmill.operators import geotag


def bisect(lat, lon, n):
    """Textbook bisection encoder."""
    spans, out, bit, value = [[-180.0, 180.0], [-90.0, 90.0]], "", 0, 0
    while len(out) < n:
        axis = bit % 2
        point = (lon, lat)[axis]
        low, high = spans[axis]
        middle = (low + high) / 2
        value = value * 2 + (point >= middle)
        spans[axis] = [middle, high] if point >= middle else [low, middle]
        bit += 1
        if bit % 5 == 0:
            out, value = out + geo.ALPHABET[value], 0
    return out


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(3)
    rows = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(400)]
    rows += [(0.0, 0.0), (90.0, 180.0), (-90.0, -180.0), (90.0, -180.0), (45.0, 90.0), (-1e-9, -1e-9)]
    rows += [(lat, lon) for lat in (-45.0, 22.5) for lon in (-135.0, 11.25)]
    return spark.createDataFrame(rows, "lat double, lon double").cache()


@pytest.mark.parametrize("n", [1, 2, 4, 5, 7, 10, 12])
def test_encode_equals_bisection(points, n):
    rows = points.select("lat", "lon", geo.geohash_encode(F.col("lat"), F.col("lon"), n).alias("h")).collect()
    assert all(r.h == bisect(r.lat, r.lon, n) for r in rows)


def test_known_value(spark):
    row = spark.range(1).select(geo.geohash_encode(F.lit(57.64911), F.lit(10.40744), 11).alias("h")).first()
    assert row.h == "u4pruydqqvj"


def test_bad_points(spark):
    rows = spark.createDataFrame([(None, 1.0), (1.0, None), (91.0, 1.0)], "lat double, lon double")
    assert [r.h for r in rows.select(geo.geohash_encode(F.col("lat"), F.col("lon")).alias("h")).collect()] == [None] * 3


def test_longitudes_wrap(spark):
    row = spark.range(1).select(
        *[geo.geohash_encode(F.lit(10.0), F.lit(x), 6).alias(f"h{i}") for i, x in enumerate((190.0, -170.0, 550.0, -530.0))]
    ).first()
    assert len({row.h0, row.h1, row.h2}) == 1
    assert geo.wrapped(190.0) == -170.0 and geo.wrapped(-190.0) == 170.0 and geo.wrapped(180.0) == 180.0


def test_decode_is_inside_the_cell_and_prefixes_nest(points):
    rows = points.select(
        "lat", "lon", geo.geohash_encode(F.col("lat"), F.col("lon")).alias("h"),
        geo.geohash_encode(F.col("lat"), F.col("lon"), 6).alias("short"),
    ).withColumn("c", geo.geohash_decode(F.col("h"))).collect()
    for r in rows:
        assert abs(r.c.lon - r.lon) <= 180 / 2**25 and abs(r.c.lat - r.lat) <= 90 / 2**25
        assert r.h.startswith(r.short)


BOXES = [(50.0, -10.0, 40.0, 10.0), (10.0, 170.0, -10.0, -170.0), (90.0, -180.0, 80.0, 180.0), (1.0, 1.0, 1.0, 1.0)]


@pytest.mark.parametrize("box", BOXES)
@pytest.mark.parametrize("n", [1, 2, 3])
def test_cover_holds_every_point_of_the_box(spark, points, box, n):
    boxes = spark.createDataFrame([box], "nw_lat double, nw_lon double, se_lat double, se_lon double")
    cover = [r.prefix for r in geo.geohash_cover(boxes, n).collect()]
    assert len(cover) == len(set(cover))
    inside = [
        r for r in points.collect()
        if box[2] <= r.lat <= box[0] and (box[1] <= r.lon <= box[3] if box[1] <= box[3] else r.lon >= box[1] or r.lon <= box[3])
    ]
    assert all(bisect(r.lat, r.lon, n) in cover for r in inside)


@pytest.mark.parametrize("box", BOXES)
@pytest.mark.parametrize("n", [1, 3, 4])
def test_box_filter_equals_prefix_match_with_the_cover(spark, points, box, n):
    index = points.select("lat", "lon", geo.geohash_encode(F.col("lat"), F.col("lon")).alias("geo_hash"))
    boxes = spark.createDataFrame([(1, *box)], "box int, nw_lat double, nw_lon double, se_lat double, se_lon double")
    joined = geotag.match_boxes(index, boxes, n, "box")
    assert sorted(r.geo_hash for r in joined.collect()) == sorted(
        r.geo_hash for r in geotag.geo_box_query(index, box, n).collect()
    )


def test_box_query_checks_the_resolution(points):
    with pytest.raises(ValueError):
        geotag.geo_box_query(points, BOXES[0], 7)


def tweet(id_str, point=None, box=None, media=None, **rest):
    out = {"id_str": id_str, "user": {"id_str": "u", "screen_name": "n"}, **rest}
    if point:
        out["coordinates"] = {"coordinates": point}
    if box:
        out["place"] = {"bounding_box": {"coordinates": [box]}}
    if media is not None:
        out["extended_tweet"] = {"entities": {"media": [{"id": i, "media_url_https": m} for i, m in enumerate(media)]}}
    return out


RING = [[9.0, 49.0], [9.0, 51.0], [11.0, 51.0], [11.0, 49.0]]


def test_extraction(lines):
    posts = lines(
        tweet("both", [1.0, 2.0], RING, ["a", "b"]),
        tweet("box", None, RING, ["c"], retweeted_status={"user": {"id_str": "9"}}),
        tweet("bare", [1.0, 2.0], None, None),
        tweet("no media", [1.0, 2.0], None, []),
        tweet("no place", None, None, ["d"]),
    )
    rows = geotag.geotag_extract(posts).collect()
    assert sorted((r.tweet_id_str, r.image_link) for r in rows) == [("both", "a"), ("both", "b"), ("box", "c")]
    by_id = {r.tweet_id_str: r for r in rows}
    assert by_id["both"].geo_hash == bisect(2.0, 1.0, 10)
    assert by_id["box"].geo_hash == bisect(50.0, 10.0, 10)
    assert by_id["box"].retweeted_status.user.id_str == "9"
    kept = geotag.geotag_extract(posts, keep_without_media=True).collect()
    assert sorted(r.tweet_id_str for r in kept) == ["bare", "both", "both", "box", "no media"]


def test_index_keeps_the_first_medium_and_earlier_rows(spark, lines):
    posts = lines(tweet("t", [1.0, 2.0], None, ["a", "b"]), tweet("s", [1.0, 2.0], None, ["z", "c"]))
    tags = geotag.geotag_extract(posts, positions=True).withColumn("event", F.lit("e"))
    index = geotag.geotag_index_rows(tags.where("tweet_id_str = 't' AND media_pos = 1"), "media_pos")
    rows = geotag.geotag_index_load(tags, index, "media_pos").collect()
    assert sorted((r.tweet_id_str, r.image_link, r.is_retweet) for r in rows) == [("s", "z", False), ("t", "b", False)]
