"""Post annotations: lookup, adding, deletion with orphan clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import slug
from postmill.operators.upsert import insert_or_ignore

KEY = ["tweet_id", "tag", "event_name"]


def annotation_lookup(
    annotations: DataFrame,
    event: str | None = None,
    tweet_ids: Sequence[str] | DataFrame | None = None,
    tag: str | None = None,
) -> DataFrame:
    """Annotations of an event, of some posts, with a tag; an absent or empty part is no filter.

    A short id list becomes an IN filter; a DataFrame with ``tweet_id`` a semi join.
    """
    if event is not None:
        annotations = annotations.where(F.col("event_name") == event)
    if tag is not None:
        annotations = annotations.where(F.col("tag") == tag)
    if isinstance(tweet_ids, DataFrame):
        annotations = annotations.join(tweet_ids.select("tweet_id"), "tweet_id", "left_semi")
    elif tweet_ids:
        annotations = annotations.where(F.col("tweet_id").isin(list(tweet_ids)))
    return annotations


def add_annotations(
    tweets: DataFrame, annotations: DataFrame, new: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """New (tweets, annotations) after adding rows (tweet_id, tag, event_name, authuser, tweet)."""
    normal = new.withColumn("tag", slug(F.col("tag")))
    return (
        insert_or_ignore(tweets, normal.select("tweet_id", "tweet"), ["tweet_id"]),
        insert_or_ignore(annotations, normal.select(*KEY, "authuser"), KEY),
    )


def delete_annotations(
    tweets: DataFrame, annotations: DataFrame, doomed: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """New (tweets, annotations) after deleting the keys in ``doomed``.

    A post goes too if the deletion left it without any annotation; posts that had
    nothing to delete stay.
    """
    left = annotations.join(doomed.select(*KEY), KEY, "left_anti")
    orphans = doomed.select("tweet_id").distinct().join(left, "tweet_id", "left_anti")
    return tweets.join(orphans, "tweet_id", "left_anti"), left
