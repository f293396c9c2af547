"""Registered queries: one callable (spark, folder of tables) -> DataFrame per key.

Every query reads whole tables. Limits occur only in page queries, where the page is the
result asked for.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import geo, text, times
from postmill.functions.posts import is_retweet, parse_post, render_post
from postmill.operators import annotations as notes
from postmill.operators import catalogue as cat
from postmill.operators import geotag, mentions, paging, predicates, projections, routing, search, upsert, volume
from postmill.operators.predicates import Expression, PostQuery, Predicate
from postmill.plans import fixtures as fx
from postmill.plans import jobs
from postmill.schema import FILE_INDEX, GEO_INDEX, TABLES
from postmill.session import scratch_folder, scratch_path, shuffles_dropped
from postmill.sinks import curated, event_table, file_index, keyed_table, mention_sums, word_index
from postmill.sinks.snapshots import SnapshotStore
from postmill.sources import tables, timeline
from postmill.streaming import collect, feed, publish

RUN_MS = 1704067200000
BOX = (50.0, -120.0, 10.0, 60.0)
START_MS, END_MS = 883612800000, 946684800000
FEED_FILES = 64

TREE = Predicate(
    [
        Expression("ALLWORDS", "the,with"),
        Expression("ANYWORDS", "avec,dans", is_or=True),
        Expression("NOTWORDS", "nicht"),
    ]
)
FULL = PostQuery(
    predicates=[TREE, Predicate([Expression("PHRASE", "of the")], is_or=True)],
    start_ms=START_MS,
    end_ms=END_MS,
    language="en",
    hashtags="Machinery,BUILDING,1-urgent",
)

RARE = Predicate([Expression("ALLWORDS", "apache,license"), Expression("NOTWORDS", "nicht"), Expression("PHRASE", "all rights reserved", is_or=True)])


# ---- projections and filters -------------------------------------------------

def project_nested(spark, d):
    rows = projections.authors_and_media(fx.order_posts(spark, d))
    return rows.select(
        "id_str", "user", "user_id_str",
        F.size("media").cast("string").alias("n_media"),
        F.get(F.get(F.get("bounding_box", F.lit(0)), F.lit(0)), F.lit(0)).alias("low_lon"),
    )


def project_tweet_user(spark, d):
    return projections.post_with_user(fx.text_posts(spark, d, long_text=False))


def filter_originals(spark, d):
    return predicates.originals(fx.text_posts(spark, d, long_text=False)).select("id_str")


def filter_geo_present(spark, d):
    return predicates.has_place(fx.order_posts(spark, d)).select("id_str")


def filter_time_range(spark, d):
    query = PostQuery(start_ms=START_MS, end_ms=END_MS)
    return query.apply(fx.order_posts(spark, d)).select("id_str", "created_at")


def filter_lang(spark, d):
    posts = fx.text_posts(spark, d, authors=False, long_text=False)
    return PostQuery(language="fr").apply(posts).select("id_str", "lang")


def filter_hashtag_any(spark, d):
    posts = fx.text_posts(spark, d, long_text=False)
    return PostQuery(hashtags="machinery,1-Urgent").apply(posts).select("id_str")


def _words(kind: str, words: str):
    def run(spark, d):
        posts = fx.text_posts(spark, d, authors=False)
        return posts.transform(predicates.words_match(kind, words)).select("id_str")

    return run


def filter_expr_tree(spark, d):
    return PostQuery([TREE]).apply(fx.text_posts(spark, d, authors=False)).select("id_str")


def filter_full_query(spark, d):
    return FULL.apply(fx.text_posts(spark, d)).select("id_str")


def filter_full_query_legacy(spark, d):
    return FULL.apply(fx.text_posts(spark, d), legacy=True).select("id_str")


def search_curated(spark, d):
    path = scratch_path(spark, "curated")
    curated.write_curated(fx.text_posts(spark, d), path)
    query = PostQuery([TREE], start_ms=START_MS, end_ms=END_MS, language="en")
    return curated.search_curated(spark.read.parquet(path), query).select("id_str", "created_ms")


def search_indexed(spark, d):
    """Rare words over two stored batches, found through the index of letter groups."""
    path = scratch_path(spark, "indexed")
    posts = fx.text_posts(spark, d)
    odd = F.col("id_str").cast("bigint") % 2 == 1
    word_index.write_batch(posts.where(odd), path, "1", blocks=8)
    word_index.write_batch(posts.where(~odd), path, "2", blocks=8)
    found = word_index.search_indexed(spark, path, PostQuery([RARE]))
    return found.select("id_str", "created_ms")


def search_tweets(spark, d):
    page = search.search_page(fx.text_posts(spark, d), PostQuery([TREE]), page=2, count=50)
    return page.select(*projections.POST_FIELDS, "user.*")


def search_cached(spark, d):
    root = scratch_path(spark, "results")
    query, posts = PostQuery([TREE]), fx.text_posts(spark, d)
    search.search_cached(spark, posts, query, "storm", root, RUN_MS)
    return search.search_cached(spark, posts, query, "storm", root, RUN_MS + 1)


def search_page_cached(spark, d):
    """Page 2 of a stored search, asked for twice, each row with the page's metadata."""
    root = scratch_path(spark, "results")
    query, posts = PostQuery([TREE]), fx.text_posts(spark, d)
    search.search_answer(spark, posts, query, "storm", root, RUN_MS, page=1, count=50)
    page, meta = search.search_answer(spark, posts, query, "storm", root, RUN_MS + 1, page=2, count=50)
    row = meta.first()
    more = {c: F.lit(row[c]).cast("bigint") for c in ("total_count", "num_pages", "tweet_count")}
    return page.select("id_str", "timestamp_ms", F.col("user.screen_name").alias("screen_name")).withColumns(more)


def collect_to_pages(spark, d):
    """Posts streamed in, published, indexed, counted, and page 2 of each event read back."""
    landed, root, mark, results = (scratch_path(spark, p) for p in ("landed", "stored", "checkpoint", "results"))
    with scratch_folder(spark, "feed") as feed:
        # Compressed files are read whole, so there are many of them; a batch is half of the feed.
        with shuffles_dropped(spark):
            fx.raw_posts(spark, d).select("value").repartition(FEED_FILES).write.options(**collect.GZIP).text(feed)
        lines = collect.file_source(spark, feed, files_per_batch=FEED_FILES // 2)
        collect.drain(collect.collect_posts(lines, fx.rules(spark), landed, mark, now=_clock))
    publish.publish_landed(spark, landed, root, RUN_MS, rows_per_file=40, keep_landed=False)
    store = SnapshotStore(spark, results)
    jobs.refresh_file_index(store, root, RUN_MS)
    index = jobs.file_index(store)
    counts = volume.bucket_counts(index, "month").select("event", F.lit("count").alias("kind"), F.col("count").cast("bigint").alias("n"))
    page = tables.read_page(spark, root, index, "everything", 2, 50)
    return counts.unionByName(page.select(F.lit("everything").alias("event"), F.lit("position").alias("kind"), F.col("position").alias("n")))


def page_meta(spark, d):
    hits = PostQuery([TREE]).apply(fx.text_posts(spark, d, authors=False))
    return paging.page_meta(hits, "storm", page=2, count=50)


# ---- matching and routing ----------------------------------------------------

def match_keyword(spark, d):
    posts = fx.raw_posts(spark, d)
    return posts.where(routing.match_keyword(F.col("value"), "The with")).select("id_str")


def match_follow(spark, d):
    posts = fx.raw_posts(spark, d)
    return posts.select("id_str", routing.match_follow(F.col("value"), "24").alias("is_match"))


def match_all(spark, d):
    return fx.raw_posts(spark, d).where(routing.match_all(F.col("value"))).select("id_str")


def match_any_condition(spark, d):
    posts = fx.raw_posts(spark, d)
    return posts.where(routing.match_any_condition(F.col("value"), "the with,qui les,")).select("id_str")


def route_rules(spark, d):
    return routing.route_rules(fx.raw_posts(spark, d), fx.rules(spark)).select("event", "id_str")


def route_rules_many(spark, d):
    return routing.route_many(fx.raw_posts(spark, d), fx.rules(spark)).select("event", "id_str")


def route_rules_null(spark, d):
    """Texts that are null for one role, through the way for many rules."""
    talks = fx.table(spark, d, "conversations")
    posts = talks.select("conv_id", "turn", F.when(F.col("role") != "system", F.col("text")).alias("value"))
    rules = spark.createDataFrame([("everything", "COVID19", ""), ("the", "KEYWORDS", "the")], TABLES["rules"])
    return routing.route_many(posts, rules).select("event", "conv_id", "turn")


# ---- mentions, media, geo ----------------------------------------------------

def _joined_names(rows):
    """Flat columns: names as comma text, the id (null for mentions without one) as text."""
    return rows.withColumn("user", F.array_join("user", ",")).withColumn("user_id", F.col("user_id").cast("string"))


def mentions_ranking(spark, d):
    return _joined_names(mentions.mentions_ranking(fx.line_posts(spark, d)))


def mentions_stored(spark, d):
    """The ranking merged from sums by hour folder; the second hour comes in a later run."""
    landed, root, sums = (scratch_path(spark, p) for p in ("landed", "stored", "sums"))
    posts = fx.line_posts(spark, d)
    later = F.pmod(F.xxhash64("id_str"), F.lit(2)) == 1
    for run, part in enumerate((posts.where(~later), posts.where(later))):
        lines = part.select(F.lit("storm").alias("event"), F.to_json(F.struct("*")).alias("value"))
        collect.write_hourly(lines, f"{landed}/batch={run:012d}", F.timestamp_millis(F.lit(RUN_MS + run * 3_600_000)), 20_000)
        publish.publish_landed(spark, landed, root, RUN_MS + run, 20_000)
        mention_sums.refresh_sums(spark, sums, root, "storm")
    return _joined_names(mention_sums.stored_ranking(spark, sums))


def media_extract(spark, d):
    return mentions.media_extract(fx.line_posts(spark, d))


def page_results(spark, d):
    ranked = mentions.mentions_ranking(fx.line_posts(spark, d), ordered=False)
    order = [F.desc("times_mentioned"), F.asc_nulls_last("user_id")]
    return _joined_names(paging.page_results(ranked, order, page=2, count=100))


def page_by_position(spark, d):
    ranked = mentions.mentions_ranking(fx.line_posts(spark, d), ordered=False)
    placed = paging.with_positions(ranked, [F.desc("times_mentioned"), F.asc_nulls_last("user_id")])
    return _joined_names(paging.page_by_position(placed, page=7, count=100))


def _points(spark, d):
    posts = predicates.has_place(fx.order_posts(spark, d))
    point = geo.resolve_point(F.col("coordinates.coordinates"), F.col("place.bounding_box.coordinates"))
    return posts.select("id_str", point.alias("p"))


def geohash_encode(spark, d):
    lat, lon = F.col("p.lat"), F.col("p.lon")
    return _points(spark, d).select(
        "id_str",
        geo.geohash_encode(lat, lon).alias("geo_hash"),
        geo.geohash_encode(lat, lon, 5).alias("geo_hash5"),
    )


def geohash_decode(spark, d):
    hashed = _points(spark, d).select("id_str", geo.geohash_encode(F.col("p.lat"), F.col("p.lon")).alias("geo_hash"))
    return hashed.select("id_str", geo.geohash_decode(F.col("geo_hash")).alias("c")).select("id_str", "c.lon", "c.lat")


def bbox_center(spark, d):
    posts = fx.order_posts(spark, d)
    return posts.select("id_str", geo.bbox_center(F.col("place.bounding_box.coordinates")).alias("c")).select(
        "id_str", "c.lon", "c.lat"
    )


def geo_resolve(spark, d):
    return _points(spark, d).select("id_str", "p.lon", "p.lat")


def geohash_cover(spark, d):
    box = F.get("place.bounding_box.coordinates", F.lit(0))
    corner = lambda i, axis: F.get(F.get(box, F.lit(i)), F.lit(axis))
    boxes = fx.order_posts(spark, d).where(F.col("place").isNotNull()).select(
        "id_str",
        corner(1, 1).alias("nw_lat"), corner(1, 0).alias("nw_lon"),
        corner(3, 1).alias("se_lat"), corner(3, 0).alias("se_lon"),
    )
    return geo.geohash_cover(boxes, 5).select("id_str", "prefix")


def geotag_extract(spark, d):
    rows = geotag.geotag_extract(fx.order_posts(spark, d), "event")
    return rows.withColumn("retweeted_status", F.col("retweeted_status.user.id_str"))


def _geo_index(spark, d):
    tags = geotag.geotag_extract(fx.order_posts(spark, d), "event", positions=True)
    return geotag.geotag_index_rows(tags, "media_pos")


def geotag_first(spark, d):
    """Load in two runs: exact points first, then everything."""
    posts = fx.order_posts(spark, d)
    points = posts.where(F.col("coordinates").isNotNull())
    index = geotag.geotag_index_rows(
        geotag.geotag_extract(points, "event", positions=True), "media_pos"
    )
    everything = geotag.geotag_extract(posts, "event", positions=True)
    return geotag.geotag_index_load(everything, index, "media_pos")


def geotag_load_twice(spark, d):
    """The index job, each of its two loads tried again after it was complete."""
    store = SnapshotStore(spark, scratch_path(spark, "results"))
    posts = fx.order_posts(spark, d)
    for run, part in enumerate((posts.where(F.col("coordinates").isNotNull()), posts)):
        rows = geotag.geotag_extract(part, "event", positions=True)
        store.write(rows, "geotag", "all", RUN_MS + run)
        for _ in range(2):
            fresh = geotag.geotag_index_rows(store.latest("geotag", "all", schema=rows.schema), "media_pos")
            index = store.parts("geo_tag_index", "all", GEO_INDEX)
            added = upsert.new_rows(index, fresh, ["event", "tweet_id_str"], unique=True)
            store.write(added.orderBy("geo_hash"), "geo_tag_index", "all", RUN_MS + run)
    return store.parts("geo_tag_index", "all", GEO_INDEX)


def geo_box_query(spark, d):
    found = geotag.geo_box_query(_geo_index(spark, d), BOX, 4)
    return found.select(
        "event", "tweet_id_str", "geo_hash",
        F.get("coordinates", F.lit(0)).alias("lon"), F.get("coordinates", F.lit(1)).alias("lat"),
    )


def geo_match_boxes(spark, d):
    lat, lon = F.col("s_acctbal") / 10000.0 * 90.0, F.col("s_nationkey") * 14.0 - 170.0
    boxes = fx.table(spark, d, "supplier").select(
        "s_suppkey",
        (lat + 2.0).alias("nw_lat"), (lon - 2.0).alias("nw_lon"),
        (lat - 2.0).alias("se_lat"), (lon + 2.0).alias("se_lon"),
    )
    return geotag.match_boxes(_geo_index(spark, d), boxes, 4, "s_suppkey").select("s_suppkey", "tweet_id_str")


def is_retweet_flag(spark, d):
    return fx.order_posts(spark, d).select("id_str", is_retweet().alias("is_retweet"))


# ---- stored files, volume, pages ----------------------------------------------

def _listing(spark, d):
    return volume.file_listing(fx.hour_files(spark, d).select("filename"))


def _index(spark, d):
    return volume.file_offsets(_listing(spark, d))


def file_index_parse(spark, d):
    return _listing(spark, d)


def file_offset_index(spark, d):
    return _index(spark, d)


def latest_files(spark, d):
    return volume.latest_files(_index(spark, d), 10).select("event", "filename")


def event_totals(spark, d):
    events = fx.table(spark, d, "events").select(F.col("event_type").alias("event")).unionByName(
        fx.table(spark, d, "region").select(F.lower("r_name").alias("event"))
    )
    return volume.event_totals(_index(spark, d), events)


def _counts(bucket):
    return lambda spark, d: volume.bucket_counts(_index(spark, d), bucket)


def page_files(spark, d):
    return volume.page_files(_index(spark, d), 100, 300)


def page_tweets(spark, d):
    posts = fx.stored_posts(spark, d)
    index = _index(spark, d)
    files = fx.hour_files(spark, d)
    located = posts.join(files, ["event", "hour"])
    levels = [F.floor(F.col("ts_us") / 60_000_000), F.floor(F.col("ts_us") / 1_000_000)]
    page = volume.page_posts(located, index, ["ts_us", "post_id"], levels, page=3, count=100)
    return page.select("event", "position", "post_id")


def page_status(spark, d):
    totals = event_totals(spark, d)
    return paging.meta_columns(totals, F.col("event"), page=21, count=100)


def index_refresh(spark, d):
    files = fx.hour_files(spark, d)
    cut = F.to_timestamp(F.lit("2024-01-20 00:00:00"))
    # One file that comes a day of hourly files late, and one that comes a few late.
    late = (F.col("event") == "click") & F.col("hour").isin(
        *[F.to_timestamp(F.lit(t)) for t in ("2024-01-18 17:00:00", "2024-01-19 20:00:00")]
    )
    seen = files.where((F.col("hour") < cut) & ~late).select("filename")
    path = scratch_path(spark, "index")
    volume.file_offsets(volume.file_listing(seen)).write.parquet(path)
    before = tables.read_table(spark, path, FILE_INDEX)
    return volume.index_refresh(before, volume.file_listing(files.select("filename")))


def index_refresh_twice(spark, d):
    """The same refresh tried again after it was complete, as a job that is restarted does."""
    store = SnapshotStore(spark, scratch_path(spark, "results"))
    files = volume.file_listing(fx.hour_files(spark, d).select("filename"))
    store.write(volume.file_offsets(files.where("event = 'view'")), "event_index", "all", RUN_MS)
    for _ in range(2):
        index = store.latest("event_index", "all", schema=FILE_INDEX)
        store.write(volume.index_refresh(index, files), "event_index", "all", RUN_MS + 1)
    return store.latest("event_index", "all", schema=FILE_INDEX)


def index_refresh_parts(spark, d):
    """An index in parts that follows the files of each week, then all, some of them late."""
    path = scratch_path(spark, "parts")
    files = fx.hour_files(spark, d)
    late = F.pmod(F.xxhash64("filename"), F.lit(50)) == 0
    for until in ("2024-01-11 00:00:00", "2024-01-21 00:00:00"):
        seen = files.where((F.col("hour") < F.to_timestamp(F.lit(until))) & ~late)
        file_index.refresh_parts(spark, path, volume.file_listing(seen.select("filename")))
    file_index.refresh_parts(spark, path, volume.file_listing(files.select("filename")))
    return file_index.read_index(spark, path)


def counts_by_column(spark, d):
    """Counts per day of a time column: every order one row of an index."""
    rows = fx.table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("event"), F.lit(0).alias("start_index"), F.lit(1).alias("end_index"), fx.order_ms().alias("ms")
    )
    return volume.bucket_counts(rows, "day", time="ms").select("event", "time", F.col("count").cast("bigint").alias("count"))


def hour_path(spark, d):
    return fx.table(spark, d, "orders").select(
        "o_orderkey", times.hour_path(F.timestamp_millis(fx.order_ms())).alias("folder")
    )


def parse_created_at(spark, d):
    posts = fx.order_posts(spark, d)
    return posts.select("id_str", times.created_ms(F.col("created_at")).alias("ms"))


# ---- catalogue and annotations -------------------------------------------------

def _terms(spark, d):
    return cat.tagged_terms(fx.keywords(spark, d), fx.follows(spark, d), fx.covid19(spark, d))


def events_with_terms(spark, d):
    rows = cat.events_with_terms(fx.catalogue(spark, d), _terms(spark, d))
    return rows.select("name", "normalized_name", "status", "match_key", "chunk", "terms")


def active_events(spark, d):
    rows = cat.active_events(
        fx.catalogue(spark, d), fx.keywords(spark, d), fx.follows(spark, d), fx.covid19(spark, d)
    )
    return rows.select("normalized_name", "author", "match_key", "chunk", "terms")


def active_terms(spark, d):
    return cat.active_terms(fx.catalogue(spark, d), fx.keywords(spark, d), "keyword")


def active_term_string(spark, d):
    return cat.active_term_string(
        fx.catalogue(spark, d), _terms(spark, d).where(F.col("match_key") != "COVID19")
    )


def _diff(spark, d):
    active = fx.catalogue(spark, d).where(F.col("status") == "ACTIVE")
    return cat.sync_diff(active, fx.running(spark, d))


def sync_diff(spark, d):
    return _diff(spark, d)


def lifecycle_log(spark, d):
    log = cat.lifecycle_log(_diff(spark, d), "sync@example.org", F.timestamp_millis(F.lit(RUN_MS)))
    return log.withColumn("time", F.unix_millis("time"))


def event_status(spark, d):
    """Catalogue after marking running but inactive events as failed."""
    failed = fx.running(spark, d).withColumn("status", F.lit("FAILED"))
    return cat.set_status(fx.catalogue(spark, d), failed).select("normalized_name", "status")


def event_detail(spark, d):
    rows = cat.event_detail(fx.catalogue(spark, d), _terms(spark, d), fx.activity(spark, d))
    return rows.select(
        "normalized_name", "status", "kind", "match_key", "chunk", "terms", "activity_type",
        F.unix_micros("activity_time").alias("activity_us"), "activity_author",
    )


def long_term_list(spark, d):
    """Term lists of whole texts, far over one chunk, taken apart again."""
    words = fx.table(spark, d, "documents").select(
        F.lit("KEYWORDS").alias("match_key"), F.concat_ws("-", "source", "doc_id", "text").alias("term")
    )
    talks = fx.table(spark, d, "conversations").select(F.lit("FOLLOWS").alias("match_key"), F.col("conv_id").cast("string").alias("term"))
    rows = words.unionByName(talks).withColumn("term", F.translate("term", ",", ";"))
    lists = cat.gather_terms(rows, ["match_key"], chunk_bytes=1 << 16)
    terms = F.split("terms", ",")
    size = F.octet_length("terms") - (F.size(terms) - 1)
    return lists.groupBy("match_key").agg(F.sum(F.size(terms)).alias("n_terms"), F.sum(size).cast("bigint").alias("n_bytes"))


def event_create(spark, d):
    """New events, one per source, with the languages as terms; taken and invalid ones are left out."""
    docs = fx.table(spark, d, "documents")
    new = docs.groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("keywords")).select(
        F.col("source").alias("name"), F.lit("all of a source").alias("description"), F.lit("me").alias("author"),
        F.lit("ACTIVE").alias("status"), F.lit("KEYWORDS").alias("match_key"), "keywords",
    )
    invalid = new.withColumns({"name": F.concat("name", F.lit(" x")), "match_key": F.lit(None).cast("string")})
    now = F.timestamp_millis(F.lit(1700000000000))
    events = fx.catalogue(spark, d).withColumn("created_at", F.lit(None).cast("timestamp"))
    terms = _terms(spark, d).select("event_name", "term", "match_key")
    heads, words, log = cat.add_events(events, terms, fx.activity(spark, d), new.unionByName(invalid), now)
    parts = [
        heads.select(F.lit("event").alias("kind"), "name", F.col("normalized_name").alias("event_name"), F.unix_millis("created_at").alias("ms")),
        words.select(F.lit("term").alias("kind"), F.col("term").alias("name"), "event_name", F.lit(None).cast("bigint").alias("ms")),
        log.select(F.lit("log").alias("kind"), F.col("type").alias("name"), "event_name", F.unix_millis("time").alias("ms")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def annotation_check(spark, d):
    labels = fx.table(spark, d, "labels")
    tag = F.when(F.col("quality") == 1, "Good  text").otherwise("!")
    rows = labels.select(F.col("doc_id").cast("string").alias("tweet_id"), tag.alias("tag"), F.lit("quality").alias("event_name"))
    return cat.validate_annotations(rows).select("tweet_id", "tag", F.array_join("reasons", ",").alias("reasons"))


def exists_flags(spark, d):
    wanted = fx.activity(spark, d).select(F.col("event_name").alias("normalized_name")).distinct()
    return upsert.exists_flags(wanted, fx.catalogue(spark, d), ["normalized_name"])


def validate_events(spark, d):
    events = fx.table(spark, d, "customer").select(
        F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).otherwise("").alias("description"),
        F.when(F.col("c_nationkey") > 0, F.array(F.col("c_mktsegment")))
        .otherwise(F.array().cast("array<string>")).alias("keywords"),
    )
    return cat.validate_events(events).select("name", "normalized_name", F.array_join("reasons", ",").alias("reasons"))


def annotation_lookup(spark, d):
    ids = fx.table(spark, d, "documents").where(F.col("lang") == "en").select(
        F.col("doc_id").cast("string").alias("tweet_id")
    )
    return notes.annotation_lookup(fx.annotations(spark, d), "quality", ids, "good-quality")


def annotation_delete(spark, d):
    marked = fx.annotations(spark, d)
    posts = marked.select("tweet_id").distinct()
    posts, left = notes.delete_annotations(posts, marked, marked.where(F.col("tag") == "toxic"))
    return left.select(F.lit("annotation").alias("kind"), "tweet_id", "tag").unionByName(
        posts.select(F.lit("tweet").alias("kind"), "tweet_id", F.lit(None).cast("string").alias("tag"))
    )


def upsert_ignore(spark, d):
    target = fx.table(spark, d, "labels").select(
        F.col("doc_id").cast("string").alias("tweet_id"), F.lit("label").alias("origin")
    )
    batch = fx.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("tweet_id"), F.col("source").alias("origin")
    ).unionByName(
        fx.table(spark, d, "pages").select(
            F.col("page_id").cast("string").alias("tweet_id"), F.lit("page").alias("origin")
        )
    )
    return upsert.insert_or_ignore(target, batch, ["tweet_id"], ["origin"])


def upsert_bucketed(spark, d):
    """The same two sources into a table stored in buckets, pages a batch after documents."""
    target, documents, pages = (
        fx.table(spark, d, name).select(F.col(key).cast("string").alias("tweet_id"), origin.alias("origin"))
        for name, key, origin in (("labels", "doc_id", F.lit("label")), ("documents", "doc_id", F.col("source")), ("pages", "page_id", F.lit("page")))
    )
    path = scratch_path(spark, "keyed")
    name = "keyed_" + path.rsplit("-", 1)[1]
    keyed_table.create_keyed(target, name, ["tweet_id"], 8, path)
    for batch in (documents, pages, documents):
        keyed_table.insert_new(spark, name, batch, ["tweet_id"], 8, ["origin"], path)
    return spark.table(name)


# ---- text functions ------------------------------------------------------------

def slug_name(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


def table_name(spark, d):
    name = F.concat_ws(" ", F.col("c_name"), F.lower("c_mktsegment"))
    return fx.table(spark, d, "customer").select("c_custkey", text.table_name(text.slug(name)).alias("table_name"))


def canonical_words(spark, d):
    return fx.table(spark, d, "documents").select(
        "doc_id",
        text.canonical_words(F.col("text")).alias("words"),
        text.canonical_hashtags(F.col("text")).alias("hashtags"),
    )


def query_key(spark, d):
    return fx.table(spark, d, "documents").select(
        "doc_id",
        text.query_key(
            F.col("source"), F.concat(F.lit("(ALLWORDS"), text.canonical_words(F.col("text")), F.lit(")")),
            F.lit(None), F.col("lang"), F.lit(0), F.col("n_chars"),
        ).alias("key"),
    )


def json_roundtrip(spark, d):
    post = parse_post(render_post(F.struct("*")))
    return fx.text_posts(spark, d).select(post.alias("p")).select(
        "p.id_str", "p.text", "p.lang", "p.user.name",
        F.col("p.extended_tweet.full_text").alias("full_text"),
        F.get("p.entities.hashtags", F.lit(0))["text"].alias("first_tag"),
        F.col("p.retweeted_status.user.id_str").alias("retweeted_user"),
    )


# ---- sources, sinks, streams ----------------------------------------------------

def _land(spark, d, event="storm"):
    """Write the text posts as landed gzip NDJSON of one event; returns the root."""
    root = scratch_path(spark, "landing")
    fx.raw_posts(spark, d).select("value").write.option("compression", "gzip").text(f"{root}/{event}/1998/01/01/00")
    return root


def _with_noise(spark, d):
    """Post lines mixed with lines that are not JSON (the conversation texts)."""
    path = scratch_path(spark, "mixed")
    noise = fx.table(spark, d, "conversations").select(
        F.regexp_replace("text", r"[\r\n]+", " ").alias("value")
    )
    fx.raw_posts(spark, d).select("value").unionByName(noise).write.text(path)
    return path


def scan_timeline(spark, d):
    posts = timeline.read_timeline(spark, _land(spark, d), "storm")
    return posts.select(
        "id_str", "lang", "text", F.col("user.screen_name").alias("screen_name"),
        F.size("entities.hashtags").cast("bigint").alias("n_tags"),
    )


def scan_tolerant(spark, d):
    return timeline.read_tolerant(spark, _with_noise(spark, d)).select("id_str", "lang")


def scan_tolerant_counts(spark, d):
    """Rows counted in three ways over lines that also hold numbers of a wrong type."""
    path = _with_noise(spark, d)
    wrong = fx.table(spark, d, "pages").select(
        F.to_json(F.struct(F.col("page_id").cast("string").alias("id_str"), F.col("url").alias("retweet_count"))).alias("value")
    )
    wrong.write.mode("append").text(path)
    posts = timeline.read_tolerant(spark, path)
    counts = [posts.agg(F.lit("all").alias("of"), F.count(F.lit(1)).alias("n"))]
    counts += [posts.select(c).agg(F.lit(c).alias("of"), F.sum(F.lit(1)).alias("n")) for c in ("id_str", "lang")]
    return timeline.union_partitions(counts)


def scan_quarantine(spark, d):
    lines = timeline.read_flagged(spark, _with_noise(spark, d))
    return lines.select(
        F.when(F.col("malformed"), "bad").otherwise("post").alias("kind"),
        F.when(F.col("malformed"), F.col("value")).otherwise(F.col("post.id_str")).alias("value"),
    )


def adhoc_sql(spark, d):
    event = "storm-" + scratch_path(spark, "x").rsplit("-", 1)[1]
    view = timeline.register_event_table(spark, _land(spark, d, event), event)
    return spark.sql(
        f"SELECT lang, count(*) AS posts, count(extended_tweet.full_text) AS long_posts FROM {view} GROUP BY lang"
    )


def event_table_drift(spark, d):
    """SQL over a stored table whose second load brought a field; one language, days before 1996."""
    path = scratch_path(spark, "events")
    posts, even = fx.text_posts(spark, d), F.col("id_str").cast("bigint") % 2 == 0
    value = F.to_json(F.struct("*")).alias("value")
    event_table.load_lines(spark, path, "storm", posts.where(~even).select(value), 1)
    more = posts.where(even).withColumn("reach", F.col("id_str").cast("bigint") * 10)
    event_table.load_lines(spark, path, "storm", more.select(value), 2)
    view = event_table.register_events(spark, path, "events_" + path.rsplit("-", 1)[1])
    return spark.sql(
        f"""SELECT lang, count(*) AS posts, count(extended_tweet.full_text) AS long_posts, sum(reach) AS reach
        FROM {view} WHERE _day < '1996-01-01' GROUP BY lang"""
    )


def frame_lines(spark, d):
    path = scratch_path(spark, "feed")
    blank = fx.table(spark, d, "pages").select(F.lit("").alias("value"))
    feed = fx.raw_posts(spark, d).select("value").unionByName(blank)
    feed.write.option("lineSep", "\r\n").text(path)
    return timeline.read_framed(spark, path).select(F.get_json_object("value", "$.id_str").alias("id_str"))


def _feeds(spark, d):
    sources = {
        "documents": ("doc_id", "text"), "pages": ("page_id", "html"),
        "benchmark": ("item_id", "text"), "conversations": ("conv_id", "text"),
    }
    return [
        fx.table(spark, d, name).select(
            F.lit(name).alias("feed"), F.col(key).cast("string").alias("id"), F.col(body).alias("text")
        )
        for name, (key, body) in sources.items()
    ]


def stream_feed(spark, d):
    """A live feed of four partitions with keep-alives, read to its end as a stream."""
    root, out, mark = (scratch_path(spark, p) for p in ("feed", "out", "checkpoint"))
    blank = fx.table(spark, d, "pages").select(F.lit("").alias("value"))
    lines = fx.raw_posts(spark, d).select("value").unionByName(blank)
    lines.repartition(4).write.option("lineSep", "\r\n").text(root)
    posts = feed.read_feed(spark, root).select(parse_post(F.col("value"), "id_str string, lang string").alias("p")).select("p.*")
    collect.drain(posts.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark))
    return spark.read.schema("id_str string, lang string").parquet(out)


def union_partitions(spark, d):
    return timeline.union_partitions(_feeds(spark, d))


def stream_source(spark, d):
    path, out = scratch_path(spark, "feed"), scratch_path(spark, "copy")
    fx.raw_posts(spark, d).select("value").write.text(path)
    lines = collect.file_source(spark, path, files_per_batch=4)
    collect.drain(collect.file_sink(lines, out, scratch_path(spark, "checkpoint")))
    return spark.read.text(out).select(
        F.get_json_object("value", "$.id_str").alias("id_str"),
        F.get_json_object("value", "$.lang").alias("lang"),
    )


def stream_sink(spark, d):
    """A framed feed copied to a sink, line by line."""
    path, out = scratch_path(spark, "feed"), scratch_path(spark, "copy")
    blank = fx.table(spark, d, "pages").select(F.lit("").alias("value"))
    _talk(spark, d).unionByName(blank).write.option("lineSep", "\r\n").text(path)
    lines = collect.file_source(spark, path, crlf=True)
    collect.drain(collect.file_sink(lines, out, scratch_path(spark, "checkpoint")))
    return spark.read.text(out).select(
        F.get_json_object("value", "$.id_str").alias("id_str"), F.get_json_object("value", "$.text").alias("text")
    )


def _landed(spark, root):
    path = F.concat_ws("/", "year", "month", "day", "hour")
    return tables.read_lines(spark, root).select(
        "event", path.alias("folder"), F.get_json_object("value", "$.id_str").alias("id_str")
    )


def _clock():
    return F.timestamp_millis(F.lit(RUN_MS))


def land_hourly(spark, d):
    path, root = scratch_path(spark, "feed"), scratch_path(spark, "landed")
    fx.raw_posts(spark, d).select("value").write.text(path)
    lines = collect.file_source(spark, path)
    collect.drain(
        collect.collect_posts(lines, fx.rules(spark), root, scratch_path(spark, "checkpoint"), now=_clock)
    )
    return _landed(spark, root)


def _talk(spark, d):
    """Conversation turns as JSON lines."""
    turns = fx.table(spark, d, "conversations")
    key = F.concat_ws("-", F.lit("turn"), "conv_id", "turn").alias("id_str")
    return turns.select(F.to_json(F.struct(key, "text")).alias("value"))


def _two_runs(spark, d, first_rules, second_rules):
    """Two runs of one stream over a growing folder, the second after a restart."""
    path, root, mark = (scratch_path(spark, p) for p in ("feed", "landed", "checkpoint"))
    for part, rules in ((fx.raw_posts(spark, d).select("value"), first_rules), (_talk(spark, d), second_rules)):
        part.write.mode("append").text(path)
        lines = collect.file_source(spark, path)
        collect.drain(collect.collect_posts(lines, rules, root, mark, now=_clock))
    return _landed(spark, root)


def restart_exactly_once(spark, d):
    return _two_runs(spark, d, fx.rules(spark), fx.rules(spark))


def rule_refresh(spark, d):
    """The rule table is replaced between two batches of one stream."""
    path = scratch_path(spark, "rules")
    rules = fx.rules(spark)
    rules.where(F.col("event") == "fire").write.parquet(f"{path}/v=1")
    rules.where(F.col("event") != "everything").write.parquet(f"{path}/v=2")
    versions = iter((1, 2))
    current = {}

    def read_rules(session):
        return session.read.parquet(f"{path}/v={current['v']}")

    feed, root, mark = (scratch_path(spark, p) for p in ("feed", "landed", "checkpoint"))
    for part in (fx.raw_posts(spark, d).select("value"), _talk(spark, d)):
        current["v"] = next(versions)
        part.write.mode("append").text(feed)
        collect.drain(collect.collect_posts(collect.file_source(spark, feed), read_rules, root, mark, now=_clock))
    return _landed(spark, root)


def snapshot_write(spark, d):
    store = SnapshotStore(spark, scratch_path(spark, "results"))
    ranked = mentions.mentions_ranking(fx.line_posts(spark, d), ordered=False)
    store.write(ranked, "mentions", "storm", RUN_MS)
    store.write(mentions.media_extract(fx.line_posts(spark, d)), "media", "storm", RUN_MS + 1, fmt="json")
    return store.runs().drop("attempt")


def snapshot_rows(spark, d):
    """Rows of a snapshot written as gzip JSON, tried twice, read back."""
    store = SnapshotStore(spark, scratch_path(spark, "results"))
    rows = mentions.media_extract(fx.line_posts(spark, d))
    for _ in range(2):
        store.write(rows, "media", "storm", RUN_MS, fmt="json", compression="gzip")
    return store.latest("media", "storm", schema=rows.schema)


def snapshot_latest(spark, d):
    store = SnapshotStore(spark, scratch_path(spark, "results"))
    posts = fx.line_posts(spark, d)
    store.write(mentions.media_extract(posts), "analysis", "storm", RUN_MS)
    store.write(mentions.mentions_ranking(posts, ordered=False), "analysis", "storm", RUN_MS + 1)
    return _joined_names(store.latest("analysis", "storm"))


def scan_catalogue(spark, d):
    """Events with their keywords, both read back as stored tables."""
    root = scratch_path(spark, "tables")
    fx.catalogue(spark, d).withColumn("created_at", F.lit(None).cast("timestamp")).write.parquet(f"{root}/events")
    fx.keywords(spark, d).write.parquet(f"{root}/keywords")
    events, words = (tables.read_named(spark, root, n) for n in ("events", "keywords"))
    rows = events.join(words, events.normalized_name == words.event_name)
    return rows.select("name", "normalized_name", "status", "description", "author", "keyword")


QUERIES = {
    "mentions_ranking": mentions_ranking,
    "mentions_stored": mentions_stored,
    "media_extract": media_extract,
    "project_nested": project_nested,
    "project_tweet_user": project_tweet_user,
    "filter_originals": filter_originals,
    "filter_geo_present": filter_geo_present,
    "filter_time_range": filter_time_range,
    "filter_lang": filter_lang,
    "filter_hashtag_any": filter_hashtag_any,
    "filter_allwords": _words("ALLWORDS", "The,with"),
    "filter_anywords": _words("ANYWORDS", "avec,nicht"),
    "filter_notwords": _words("NOTWORDS", "the,und"),
    "filter_phrase": _words("PHRASE", "of the,and the"),
    "filter_expr_tree": filter_expr_tree,
    "filter_full_query": filter_full_query,
    "filter_full_query_legacy": filter_full_query_legacy,
    "search_tweets": search_tweets,
    "search_cached": search_cached,
    "search_page_cached": search_page_cached,
    "collect_to_pages": collect_to_pages,
    "search_curated": search_curated,
    "search_indexed": search_indexed,
    "page_meta": page_meta,
    "page_results": page_results,
    "page_by_position": page_by_position,
    "match_keyword": match_keyword,
    "match_follow": match_follow,
    "match_all": match_all,
    "match_any_condition": match_any_condition,
    "route_rules": route_rules,
    "route_rules_many": route_rules_many,
    "route_rules_null": route_rules_null,
    "geotag_load_twice": geotag_load_twice,
    "index_refresh_twice": index_refresh_twice,
    "index_refresh_parts": index_refresh_parts,
    "counts_by_column": counts_by_column,
    "long_term_list": long_term_list,
    "event_create": event_create,
    "annotation_check": annotation_check,
    "scan_tolerant_counts": scan_tolerant_counts,
    "snapshot_rows": snapshot_rows,
    "geohash_encode": geohash_encode,
    "geohash_decode": geohash_decode,
    "bbox_center": bbox_center,
    "geo_resolve": geo_resolve,
    "geohash_cover": geohash_cover,
    "geotag_extract": geotag_extract,
    "geotag_first": geotag_first,
    "geo_box_query": geo_box_query,
    "geo_match_boxes": geo_match_boxes,
    "is_retweet": is_retweet_flag,
    "file_index_parse": file_index_parse,
    "file_offset_index": file_offset_index,
    "latest_files": latest_files,
    "event_totals": event_totals,
    "counts_hour": _counts("hour"),
    "counts_day": _counts("day"),
    "counts_month": _counts("month"),
    "page_files": page_files,
    "page_tweets": page_tweets,
    "page_status": page_status,
    "index_refresh": index_refresh,
    "hour_path": hour_path,
    "parse_created_at": parse_created_at,
    "events_with_terms": events_with_terms,
    "active_events": active_events,
    "active_terms": active_terms,
    "active_term_string": active_term_string,
    "sync_diff": sync_diff,
    "lifecycle_log": lifecycle_log,
    "event_status": event_status,
    "event_detail": event_detail,
    "exists_flags": exists_flags,
    "validate_events": validate_events,
    "annotation_lookup": annotation_lookup,
    "annotation_delete": annotation_delete,
    "upsert_ignore": upsert_ignore,
    "upsert_bucketed": upsert_bucketed,
    "slug_name": slug_name,
    "table_name": table_name,
    "canonical_words": canonical_words,
    "query_key": query_key,
    "json_roundtrip": json_roundtrip,
    "scan_timeline": scan_timeline,
    "scan_tolerant": scan_tolerant,
    "scan_quarantine": scan_quarantine,
    "scan_catalogue": scan_catalogue,
    "adhoc_sql": adhoc_sql,
    "event_table_drift": event_table_drift,
    "frame_lines": frame_lines,
    "union_partitions": union_partitions,
    "stream_source": stream_source,
    "stream_feed": stream_feed,
    "stream_sink": stream_sink,
    "land_hourly": land_hourly,
    "restart_exactly_once": restart_exactly_once,
    "rule_refresh": rule_refresh,
    "snapshot_write": snapshot_write,
    "snapshot_latest": snapshot_latest,
}
