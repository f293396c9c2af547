"""Geo-tag extraction, the geo-tag index and box queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions import geo
from postmill.functions.posts import is_retweet
from postmill.operators.predicates import has_place
from postmill.operators.upsert import first_per_key, insert_or_ignore

TAG_FIELDS = [
    "user", "user_id_str", "geo_hash", "created_at", "tweet_id_str", "lang", "source",
    "in_reply_to_user_id_str", "text", "retweeted_status", "image_link",
]
INDEX_FIELDS = [
    "event", "geo_hash", "created_at", "username", "user_id_str", "tweet_id_str", "lang", "source",
    "in_reply_to_user_id_str", "text", "image_link", "is_retweet",
]


def geotag_extract(
    posts: DataFrame, *extra: str, keep_without_media: bool = False, positions: bool = False
) -> DataFrame:
    """One row per (placed post, medium) with the post's geohash.

    Placed posts without media are left out unless ``keep_without_media``.
    ``extra`` post columns pass through; ``positions`` adds ``media_pos``.
    """
    generate = F.posexplode_outer if keep_without_media else F.posexplode
    point = geo.resolve_point(F.col("coordinates.coordinates"), F.col("place.bounding_box.coordinates"))
    located = has_place(posts).select(
        *extra,
        F.col("user.screen_name").alias("user"),
        F.col("user.id_str").alias("user_id_str"),
        "created_at",
        F.col("id_str").alias("tweet_id_str"),
        "lang", "source", "in_reply_to_user_id_str", "text", "retweeted_status",
        F.col("extended_tweet.entities.media").alias("_media"),
        point.alias("_point"),
    )
    # The hash is computed once per post, before its media multiply the rows.
    hashed = located.withColumn("geo_hash", geo.geohash_encode(F.col("_point.lat"), F.col("_point.lon")))
    rows = hashed.select("*", generate("_media").alias("media_pos", "_m")).withColumn(
        "image_link", F.col("_m.media_url_https")
    )
    return rows.select(*extra, *TAG_FIELDS, *(["media_pos"] if positions else []))


def geotag_index_rows(tags: DataFrame, *order: str) -> DataFrame:
    """Index rows of extracted tags: per (event, post) the first in ``order``."""
    rows = tags.select(
        *[f for f in INDEX_FIELDS if f not in ("username", "is_retweet")],
        F.col("user").alias("username"),
        is_retweet().alias("is_retweet"),
        *order,
    )
    first = first_per_key(rows, ["event", "tweet_id_str"], list(order))
    return first.select(*INDEX_FIELDS)


def geotag_index_load(tags: DataFrame, index: DataFrame, *order: str) -> DataFrame:
    """The index after adding new tags; posts already present keep their row."""
    fresh = geotag_index_rows(tags, *order)
    return insert_or_ignore(index.select(*INDEX_FIELDS), fresh, ["event", "tweet_id_str"], unique=True)


def geo_box_query(
    index: DataFrame, box: tuple[float, float, float, float], resolution: int = 4
) -> DataFrame:
    """Index rows in cells that touch ``box`` = (NW lat, NW lon, SE lat, SE lon).

    Adds ``coordinates`` = [lon, lat], the centre of the row's stored cell. Row-local:
    no cover set is built, joined or broadcast, whatever the box and resolution.
    """
    if not 1 <= resolution <= 6:
        raise ValueError("resolution must be 1..6")
    center = geo.geohash_decode(F.col("geo_hash"))
    return (
        index.where(geo.in_box_cells(F.col("geo_hash"), box, resolution))
        .withColumn("_center", center)
        .withColumn("coordinates", F.array("_center.lon", "_center.lat"))
        .drop("_center")
    )


def match_boxes(index: DataFrame, boxes: DataFrame, resolution: int = 4, *box_key: str) -> DataFrame:
    """Index rows per box of a table of boxes: equi join of hash prefix and box cover.

    A cell belongs to a box once, so a row meets a box at most once. Spark's statistics take
    the cover for as small as the boxes it is generated from, and would broadcast it; it is
    merged instead, and hot cells are split by Spark's skew handling.
    """
    cover = geo.geohash_cover(boxes, resolution, name="_prefix").select(*box_key, "_prefix").hint("merge")
    tagged = index.withColumn("_prefix", F.substring("geo_hash", 1, resolution))
    return tagged.join(cover, "_prefix").drop("_prefix")
