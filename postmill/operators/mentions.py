"""Mention ranking and media extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.operators.predicates import originals


def mention_sums(posts: DataFrame, *by: str) -> DataFrame:
    """Sums per mentioned account and name (and the columns ``by``), which add up over any parts of the posts."""
    mention = originals(posts).select(*by, "retweet_count", "favorite_count", F.explode("entities.user_mentions").alias("m"))
    return mention.groupBy(*by, F.col("m.id").alias("user_id"), F.col("m.screen_name").alias("name")).agg(
        F.count("m.id").alias("n"),
        F.sum("retweet_count").alias("retweets"),
        F.sum("favorite_count").alias("likes"),
    )


def ranking_of(sums: DataFrame, ordered: bool = True) -> DataFrame:
    """Ranking from ``mention_sums`` of parts that together are all posts."""
    ranked = sums.groupBy("user_id").agg(
        F.array_sort(F.collect_set("name")).alias("user"),
        F.sum("n").alias("times_mentioned"),
        F.sum("retweets").alias("total_retweets"),
        F.sum("likes").alias("total_likes"),
    )
    return ranked.orderBy(F.desc("times_mentioned"), F.asc_nulls_last("user_id")) if ordered else ranked


def mentions_ranking(posts: DataFrame, ordered: bool = True) -> DataFrame:
    """Per mentioned account: its names, times mentioned, sums of retweets and likes.

    Each occurrence counts, also twice within one post; mentions without an id form a
    group counted 0 times. Aggregating by (id, name) first folds a much-mentioned account
    to a few rows inside every map task, so the by-account shuffle carries no hot key.
    """
    return ranking_of(mention_sums(posts), ordered)


def media_extract(posts: DataFrame) -> DataFrame:
    """One row per (post, medium): author, medium id, image link, post link."""
    return posts.select(
        F.col("user.screen_name").alias("user"),
        F.explode("extended_tweet.entities.media").alias("m"),
    ).select(
        "user",
        F.col("m.id").alias("media_id"),
        F.col("m.media_url_https").alias("image_link"),
        F.col("m.expanded_url").alias("tweet_url"),
    )
