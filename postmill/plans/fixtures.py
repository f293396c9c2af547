"""Post-shaped views over the benchmark tables.

Three kinds of posts, all built row by row from whole tables without grouping:

* ``text_posts``: one per document, whole text, author and time from the order of the
  same number, long text from the page of the same number;
* ``order_posts``: one per order, with point or box, media, retweet and reply marks;
* ``line_posts``: one per line item, with mentions and media.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.times import created_at, file_name
from postmill.schema import COVID19, FOLLOWS, KEYWORDS, MEDIA, MENTION, TABLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def order_ms() -> Column:
    """Post time of an order: its date, moved on by its price in seconds."""
    day = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return (day + F.floor("o_totalprice")) * 1000


def user_struct() -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        _text("c_custkey").alias("id_str"),
        F.col("c_name").alias("name"),
        F.translate(F.lower("c_name"), "#", "").alias("screen_name"),
        (F.col("c_mktsegment") == "MACHINERY").alias("verified"),
        none.alias("created_at"),
        F.col("c_mktsegment").alias("description"),
        F.col("c_custkey").alias("statuses_count"),
        F.col("c_nationkey").cast("bigint").alias("favourites_count"),
        F.floor("c_acctbal").alias("followers_count"),
        F.col("c_nationkey").cast("bigint").alias("friends_count"),
        F.concat(F.lit("nation "), _text("c_nationkey")).alias("location"),
        none.alias("time_zone"),
        none.alias("url"),
        F.concat(F.lit("https://img/u"), _text("c_custkey"), F.lit(".png")).alias("profile_image_url_https"),
    )


def _media(*keys: str) -> Column:
    return F.array(
        *[
            F.struct(
                F.col(k).alias("id"),
                F.concat(F.lit(f"https://img/{k[2:]}/"), _text(k), F.lit(".jpg")).alias("media_url_https"),
                F.concat(F.lit(f"https://post/{k[2:]}/"), _text(k)).alias("expanded_url"),
            )
            for k in keys
        ]
    ).cast(f"array<{MEDIA}>")


def _retweeted(mark: Column, account: Column) -> Column:
    return F.when(mark, F.struct(F.struct(account.cast("string").alias("id_str")).alias("user")))


def text_posts(spark: SparkSession, sf_dir: str, authors: bool = True, long_text: bool = True) -> DataFrame:
    """One post per document; parts a query does not need can be left out of the plan.

    ``authors`` brings user, time, hashtags, reply and retweet marks, ``long_text`` the
    long text. Orders meet their customers without any text, and only those of a document;
    both parts then join on the document's number, so a text is shuffled once.
    """
    posts = table(spark, sf_dir, "documents")
    columns = [_text("doc_id").alias("id_str"), "text", "lang", "source"]
    if authors:
        orders = table(spark, sf_dir, "orders").select(
            "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority"
        )
        written = orders.join(posts.select("doc_id"), F.col("o_orderkey") == F.col("doc_id"), "left_semi").join(
            table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left"
        )
        posts = posts.join(written, F.col("doc_id") == F.col("o_orderkey"), "left")
        tags = F.array(
            F.struct(F.col("c_mktsegment").alias("text")), F.struct(F.col("o_orderpriority").alias("text"))
        )
        columns += [
            created_at(F.timestamp_millis(order_ms())).alias("created_at"),
            order_ms().cast("string").alias("timestamp_ms"),
            F.when(F.col("o_orderpriority") == "2-HIGH", _text("c_nationkey")).alias("in_reply_to_user_id_str"),
            user_struct().alias("user"),
            F.struct(tags.alias("hashtags")).alias("entities"),
            _retweeted(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey") + 1).alias("retweeted_status"),
        ]
    if long_text:
        posts = posts.join(table(spark, sf_dir, "pages"), F.col("doc_id") == F.col("page_id"), "left")
        columns.append(F.struct(F.col("html").alias("full_text")).alias("extended_tweet"))
    return posts.select(*columns)


def order_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    posts = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    lon = F.col("o_totalprice") / 500000.0 * 360.0 - 180.0
    lat = F.col("c_acctbal") / 10000.0 * 90.0
    west, east, south, north = lon - 0.05, lon + 0.05, lat - 0.05, lat + 0.05
    ring = F.array(F.array(west, south), F.array(west, north), F.array(east, north), F.array(east, south))
    status = F.col("o_orderstatus")
    media = (
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", _media("o_orderkey"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", _media())
        .when(F.col("o_orderpriority") != "5-LOW", _media("o_orderkey", "o_custkey"))
    )
    return posts.select(
        _text("o_orderkey").alias("id_str"),
        created_at(F.timestamp_millis(order_ms())).alias("created_at"),
        order_ms().cast("string").alias("timestamp_ms"),
        F.col("o_orderpriority").alias("text"),
        F.lit("und").alias("lang"),
        F.lower("c_mktsegment").alias("source"),
        F.when(F.col("o_orderpriority") == "2-HIGH", _text("c_nationkey")).alias("in_reply_to_user_id_str"),
        user_struct().alias("user"),
        F.struct(F.struct(media.alias("media")).alias("entities")).alias("extended_tweet"),
        F.when(status == "F", F.struct(F.array(lon, lat).alias("coordinates"))).alias("coordinates"),
        F.when(status == "O", F.struct(F.struct(F.array(ring).alias("coordinates")).alias("bounding_box"))).alias("place"),
        _retweeted(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey") + 1).alias("retweeted_status"),
        F.lower("c_mktsegment").alias("event"),
    )


def line_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    plain = F.col("l_tax") != 0
    mentions = F.array(
        F.struct(
            F.col("l_suppkey").alias("id"),
            F.concat(F.lit("supplier"), _text("l_suppkey")).alias("screen_name"),
        ),
        F.struct(
            F.when(plain, F.col("l_partkey")).alias("id"),
            F.when(plain, F.concat(F.lit("part"), _text("l_partkey"))).alias("screen_name"),
        ),
    ).cast(f"array<{MENTION}>")
    media = F.when(
        F.col("l_returnflag") == "R",
        F.when(F.col("l_linestatus") == "O", _media("l_partkey", "l_suppkey")).otherwise(_media("l_partkey")),
    ).when(F.col("l_returnflag") == "A", _media())
    return lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id_str"),
        F.col("l_quantity").cast("bigint").alias("retweet_count"),
        F.col("l_linenumber").cast("bigint").alias("favorite_count"),
        F.struct(
            _text("l_suppkey").alias("id_str"),
            F.concat(F.lit("supplier"), _text("l_suppkey")).alias("screen_name"),
        ).alias("user"),
        F.struct(F.when(F.col("l_returnflag") != "N", mentions).alias("user_mentions")).alias("entities"),
        F.struct(F.struct(media.alias("media")).alias("entities")).alias("extended_tweet"),
        _retweeted(F.col("l_linestatus") == "F", F.col("l_suppkey")).alias("retweeted_status"),
    )


def raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_str, value): the text posts as JSON lines."""
    posts = text_posts(spark, sf_dir)
    return posts.select("id_str", F.to_json(F.struct("*")).alias("value"))


def supplier_name(key: Column) -> Column:
    """Normalized event name of a supplier number."""
    return F.concat(F.lit("supplier"), F.lpad(key.cast("string"), 9, "0"))


def supplier_kind() -> Column:
    return F.when(F.col("s_nationkey") < 12, KEYWORDS).when(F.col("s_nationkey") < 20, FOLLOWS).otherwise(COVID19)


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per supplier."""
    status = (
        F.when(F.col("s_acctbal") < 2000, "FAILED").when(F.col("s_acctbal") < 4500, "NOT_ACTIVE").otherwise("ACTIVE")
    )
    return table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"),
        supplier_name(F.col("s_suppkey")).alias("normalized_name"),
        status.alias("status"),
        F.concat(F.lit("nation "), _text("s_nationkey")).alias("description"),
        F.concat(F.lit("user"), _text("s_nationkey"), F.lit("@example.org")).alias("author"),
    )


def _terms(spark: SparkSession, sf_dir: str, kind: str, term: Column, name: str) -> DataFrame:
    seen = table(spark, sf_dir, "lineitem").select("l_suppkey", term.alias(name)).distinct()
    owners = table(spark, sf_dir, "supplier").where(supplier_kind() == kind).select("s_suppkey")
    return seen.join(owners, F.col("l_suppkey") == F.col("s_suppkey")).select(
        supplier_name(F.col("l_suppkey")).alias("event_name"), name
    )


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.lower(F.date_format("l_shipdate", "MMMM"))
    return _terms(spark, sf_dir, KEYWORDS, month, "keyword")


def follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir, FOLLOWS, _text("l_linenumber"), "follow")


def covid19(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "supplier").where(supplier_kind() == COVID19)
    return owners.select(supplier_name(F.col("s_suppkey")).alias("event_name"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One activity entry per stream event."""
    kind = (
        F.when(F.col("event_type") == "signup", "CREATE_EVENT")
        .when(F.col("event_type").isin("click", "view"), "START_EVENT")
        .otherwise("PAUSE_EVENT")
    )
    return table(spark, sf_dir, "events").select(
        kind.alias("type"),
        F.col("ts").cast("timestamp").alias("time"),
        F.concat(F.lit("user"), _text("user_id")).alias("author"),
        supplier_name(F.col("user_id")).alias("event_name"),
    )


def running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are running now: those with a large error entry."""
    rows = table(spark, sf_dir, "events").where((F.col("event_type") == "error") & (F.col("value") > 150))
    return rows.select(supplier_name(F.col("user_id")).alias("normalized_name")).distinct()


def stored_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream events as stored posts: event, time, id and the hour they were stored in."""
    stamp = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("event"),
        F.col("event_id").cast("bigint").alias("post_id"),
        F.unix_micros(stamp).alias("ts_us"),
        F.date_trunc("hour", stamp).alias("hour"),
    )


def hour_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored file per event and hour: event, hour, filename."""
    files = stored_posts(spark, sf_dir).groupBy("event", "hour").agg(
        F.max("ts_us").alias("last"), F.count(F.lit(1)).alias("n")
    )
    return files.select(
        "event", "hour", file_name(F.col("event"), F.timestamp_micros("last"), F.col("n")).alias("filename")
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations out of the labels: one per set flag."""
    marks = F.array(
        F.struct(F.lit("good-quality").alias("tag"), F.lit("quality").alias("event_name"), F.col("quality").alias("on")),
        F.struct(F.lit("toxic").alias("tag"), F.lit("toxicity").alias("event_name"), F.col("toxic").alias("on")),
    )
    rows = table(spark, sf_dir, "labels").select(_text("doc_id").alias("tweet_id"), F.explode(marks).alias("m"))
    return rows.where(F.col("m.on") == 1).select(
        "tweet_id", "m.tag", "m.event_name", F.lit(None).cast("string").alias("authuser")
    )


def rules(spark: SparkSession) -> DataFrame:
    """Match rules of five events."""
    rows = [
        ("storm", KEYWORDS, "the with,qui les"),
        ("flood", KEYWORDS, "und der,january"),
        ("quake", FOLLOWS, "3,7,11,24"),
        ("fire", KEYWORDS, "with"),
        ("everything", COVID19, ""),
    ]
    return spark.createDataFrame(rows, TABLES["rules"])
