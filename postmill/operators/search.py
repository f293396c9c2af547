"""Post search with paging, and reuse of stored search results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators.paging import DEFAULT_COUNT, meta_columns, page_by_position, page_results, with_positions
from postmill.operators.predicates import PostQuery
from postmill.operators.projections import nest_user, post_with_user
from postmill.session import scratch_folder
from postmill.sinks.snapshots import SnapshotStore

CACHE_LIFE_MS = 10 * 60 * 1000
JOB = "search"
# Pages go by post time and id.
ORDER = ["try_cast(timestamp_ms AS bigint)", "id_str"]


def search_posts(posts: DataFrame, query: PostQuery, **columns) -> DataFrame:
    """Every matching post in result form."""
    return post_with_user(query.apply(posts, **columns))


def search_page(
    posts: DataFrame, query: PostQuery, page: int = 1, count: int = DEFAULT_COUNT, **columns
) -> DataFrame:
    """One page of matching posts by post time and id, the user nested."""
    hits = search_posts(posts, query, **columns)
    return nest_user(page_results(hits, [F.expr(x) for x in ORDER], page, count))


def search_cached(
    spark: SparkSession,
    posts: DataFrame,
    query: PostQuery,
    event: str,
    root: str,
    now_ms: int,
    life_ms: int = CACHE_LIFE_MS,
) -> DataFrame:
    """The matching posts, read back from a stored result.

    Equal searches on one event share a stored result until it is ``life_ms`` old; then
    the search runs again. Pages and totals of the same search thus scan the posts once.
    """
    store, key = _stored_search(spark, posts, query, event, root, now_ms, life_ms)
    return store.latest(JOB, key).drop("position")


def search_answer(
    spark: SparkSession,
    posts: DataFrame,
    query: PostQuery,
    event: str,
    root: str,
    now_ms: int,
    page: int = 1,
    count: int = DEFAULT_COUNT,
    life_ms: int = CACHE_LIFE_MS,
) -> tuple[DataFrame, DataFrame]:
    """(posts of one page with the user nested, page metadata) of a search.

    The search runs once while its stored result is fresh; every page is a range of stored
    positions and the total is the row count of the manifest.
    """
    store, key = _stored_search(spark, posts, query, event, root, now_ms, life_ms)
    found = page_by_position(store.latest(JOB, key), page, count).orderBy("position").drop("position")
    total = spark.createDataFrame([(store.latest_run(JOB, key).row_count,)], "total_count bigint")
    return nest_user(found), meta_columns(total, F.lit(event), page, count)


def _stored_search(
    spark: SparkSession, posts: DataFrame, query: PostQuery, event: str, root: str, now_ms: int, life_ms: int
) -> tuple[SnapshotStore, str]:
    """The store that holds a fresh result of the search, with positions, and its key there."""
    store, key = SnapshotStore(spark, root), query.key(event)
    fresh = store.latest_run(JOB, key)
    if fresh is None or now_ms - fresh.run_ms >= life_ms:
        with scratch_folder(spark, "ranked") as path:
            store.write(with_positions(search_posts(posts, query), [F.expr(x) for x in ORDER], path), JOB, key, now_ms)
    return store, key
