"""Whole jobs: read an event, run an operator, publish a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators.geotag import geotag_extract, geotag_index_rows
from postmill.operators.mentions import media_extract, mentions_ranking
from postmill.operators.paging import page_by_position, with_positions
from postmill.operators.upsert import new_rows
from postmill.operators.volume import file_listing
from postmill.schema import GEO_INDEX
from postmill.session import scratch_folder
from postmill.sinks.file_index import read_index, refresh_parts
from postmill.sinks.snapshots import SnapshotStore
from postmill.sources.tables import stored_files
from postmill.sources.timeline import read_timeline


TAGS = (
    "user string, user_id_str string, geo_hash string, created_at string, tweet_id_str string, "
    "lang string, source string, in_reply_to_user_id_str string, text string, "
    "retweeted_status struct<user: struct<id_str: string>>, image_link string, media_pos int"
)


def run_mentions(store: SnapshotStore, posts: DataFrame, event: str, run_ms: int) -> int:
    """Publish the mention ranking with positions; returns the number of accounts."""
    ranked = mentions_ranking(posts, ordered=False)
    with scratch_folder(store.spark, "ranked") as path:
        placed = with_positions(ranked, [F.desc("times_mentioned"), F.asc_nulls_last("user_id")], path)
        return store.write(placed, "mentions", event, run_ms)


def run_media(store: SnapshotStore, posts: DataFrame, event: str, run_ms: int) -> int:
    """Publish the media rows with positions; returns their number."""
    with scratch_folder(store.spark, "ranked") as path:
        rows = with_positions(media_extract(posts), ["media_id", "tweet_url", "user"], path)
        return store.write(rows, "media", event, run_ms)


def run_geotag(store: SnapshotStore, posts: DataFrame, event: str, run_ms: int) -> int:
    """Publish the geo-tag rows as gzip JSON; returns their number."""
    rows = geotag_extract(posts, positions=True)
    return store.write(rows, "geotag", event, run_ms, fmt="json", compression="gzip")


def geotag_index(store: SnapshotStore, event: str) -> DataFrame:
    """The geo-tag index of an event."""
    return store.parts("geo_tag_index", event, GEO_INDEX)


def load_geotag_index(store: SnapshotStore, event: str, run_ms: int) -> int:
    """Append what an event's newest geo-tag snapshot adds to its index; returns the row count.

    Only this event's index is compared, nothing stored is rewritten, and a part sorted
    by geohash lets box queries skip most of its row groups.
    """
    tags = store.latest("geotag", event, schema=TAGS).withColumn("event", F.lit(event))
    fresh = geotag_index_rows(tags, "media_pos")
    added = new_rows(geotag_index(store, event), fresh, ["event", "tweet_id_str"], unique=True)
    return store.write(added.orderBy("geo_hash"), "geo_tag_index", event, run_ms)


def refresh_file_index(store: SnapshotStore, landing: str, run_ms: int, folders: list[str] | None = None) -> int:
    """Bring the file-offset index of all events up to the stored files.

    ``folders`` limits the listing, for instance to the days since the last refresh; indexed
    files elsewhere keep their rows. Returns the row count.
    """
    listing = file_listing(stored_files(store.spark, folders or landing), landing)
    refresh_parts(store.spark, _index_path(store), listing)
    return file_index(store).count()


def _index_path(store: SnapshotStore) -> str:
    return f"{store.root}/file_index"


def file_index(store: SnapshotStore, events: list[str] | None = None) -> DataFrame:
    """The file-offset index, of some events or of all."""
    return read_index(store.spark, _index_path(store), events)


def analyse_posts(store: SnapshotStore, posts: DataFrame, event: str, run_ms: int) -> dict[str, int]:
    """The three analysis jobs over an event's posts; returns their row counts."""
    return {
        "mentions": run_mentions(store, posts, event, run_ms),
        "media": run_media(store, posts, event, run_ms),
        "geotag": run_geotag(store, posts, event, run_ms),
    }


def analyse_event(spark: SparkSession, landing: str, results: str, event: str, run_ms: int) -> dict[str, int]:
    """``analyse_posts`` over the stored files of an event."""
    return analyse_posts(SnapshotStore(spark, results), read_timeline(spark, landing, event), event, run_ms)


def snapshot_page(store: SnapshotStore, job: str, event: str, page: int = 1, count: int = 100) -> DataFrame:
    """One page of an event's newest mentions or media snapshot."""
    return page_by_position(store.latest(job, event), page, count)
