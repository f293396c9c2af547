"""Projections of the nested post record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POST_FIELDS = ["id_str", "text", "timestamp_ms", "source"]
USER_FIELDS = [
    "name", "screen_name", "verified", "created_at", "description", "statuses_count",
    "favourites_count", "followers_count", "friends_count", "location", "time_zone", "url",
    "profile_image_url_https",
]


def post_with_user(posts: DataFrame, *extra: str) -> DataFrame:
    """Four post columns and thirteen user columns, the latter under their leaf names."""
    users = [F.col(f"user.{f}").alias(f) for f in USER_FIELDS]
    return posts.select(*extra, *POST_FIELDS, *users)


def nest_user(rows: DataFrame, *extra: str) -> DataFrame:
    """Put the user columns of ``post_with_user`` back into one ``user`` struct."""
    return rows.select(*extra, *POST_FIELDS, F.struct(*USER_FIELDS).alias("user"))


def authors_and_media(posts: DataFrame) -> DataFrame:
    """Author name, author id, media and box columns out of the nested record."""
    return posts.select(
        "id_str",
        F.col("user.screen_name").alias("user"),
        F.col("user.id_str").alias("user_id_str"),
        F.col("extended_tweet.entities.media").alias("media"),
        F.col("place.bounding_box.coordinates").alias("bounding_box"),
    )
