"""Event catalogue: terms per event, active events, start/stop differences, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import slug
from postmill.operators.upsert import first_per_key
from postmill.schema import ACTIVE, COVID19, CREATE_EVENT, FOLLOWS, KEYWORDS, PAUSE_EVENT, START_EVENT

EVENT_COLUMNS = ["name", "normalized_name", "status", "created_at", "description", "author"]

# A term list ends up in settings of a collector; a setting holds at most one MiB.
CHUNK_BYTES = 1 << 20


def validate_events(events: DataFrame) -> DataFrame:
    """Events with a ``reasons`` array: the required fields that are empty.

    An event is valid when the array is empty. ``normalized_name`` is derived from
    ``name`` here, as it is for every new event.
    """
    checks = [(f, F.coalesce(F.length(f), F.lit(0)) == 0) for f in ("name", "description")]
    checks.append(("keywords", F.coalesce(F.size("keywords"), F.lit(0)) <= 0))
    if "match_key" in events.columns:
        checks.append(("match_key", F.coalesce(F.length("match_key"), F.lit(0)) == 0))
    return _with_reasons(events, checks).withColumn("normalized_name", slug(F.col("name")))


def validate_annotations(annotations: DataFrame) -> DataFrame:
    """Annotations with a ``reasons`` array and their tag normalized."""
    fields = [f for f in ("tag", "tweet_id", "event_name", "tweet") if f in annotations.columns]
    checks = [(f, F.coalesce(F.length(f), F.lit(0)) == 0) for f in fields]
    normal = annotations.withColumn("tag", slug(F.col("tag")))
    return _with_reasons(normal, checks)


def _with_reasons(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    flags = F.array(*[F.when(bad, F.lit(name)) for name, bad in checks])
    return rows.withColumn("reasons", F.array_compact(flags))


def tagged_terms(keywords: DataFrame, follows: DataFrame, covid19: DataFrame) -> DataFrame:
    """The three term tables as one (event_name, term, match_key); match-all has an empty term."""
    parts = [
        keywords.select("event_name", F.col("keyword").alias("term"), F.lit(KEYWORDS).alias("match_key")),
        follows.select("event_name", F.col("follow").alias("term"), F.lit(FOLLOWS).alias("match_key")),
        covid19.select("event_name", F.lit("").alias("term"), F.lit(COVID19).alias("match_key")),
    ]
    return reduce(DataFrame.unionByName, parts)


def event_terms(events: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per (event, term): inner join on the normalized name."""
    return events.join(terms, events.normalized_name == terms.event_name).drop("event_name")


def gather_terms(rows: DataFrame, keys: list[str], distinct: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Term lists per key as comma texts ``terms``, sorted, in numbered chunks.

    A list of at most ``chunk_bytes`` is one text, chunk 0. The terms of a longer one are
    dealt to as many chunks by their hash, so that no list is too long and no task gathers
    more than about one chunk; repetitions of a term are folded to counts first and split
    likewise. Only keys with a longer list are looked up, one short row for each: there are
    fewer of them than the terms hold ``chunk_bytes``, so they are broadcast and no term moves by key alone.
    """
    if distinct:
        counted = rows.select(*keys, "term").distinct().withColumn("_n", F.lit(1).cast("bigint"))
    else:
        counted = rows.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("_n"))
    size = F.octet_length("term") + 1
    chunks = F.ceil(F.sum(size * F.col("_n")) / chunk_bytes).cast("bigint")
    lists = counted.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(chunks.alias("_chunks"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    placed = counted.join(F.broadcast(lists.where("_chunks > 1")), same, "left")
    placed = placed.select(*keys, "term", "_n", F.coalesce("_chunks", F.lit(1).cast("bigint")).alias("_chunks"))
    # A term with very many copies is cut into pieces that fit a chunk.
    most = F.greatest(F.floor(F.lit(chunk_bytes) / size), F.lit(1))
    placed = placed.select("*", most.alias("_most"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / most))).alias("_piece"))
    copies = F.least(F.col("_n") - F.col("_piece") * F.col("_most"), F.col("_most")).cast("int")
    chunk = F.pmod(F.xxhash64("term", "_piece"), F.col("_chunks")).cast("int")
    placed = placed.select(*keys, "term", copies.alias("_copies"), F.when(F.col("_chunks") > 1, chunk).otherwise(0).alias("chunk"))
    repeated = F.flatten(F.collect_list(F.array_repeat("term", F.col("_copies"))))
    return placed.groupBy(*keys, "chunk").agg(F.array_join(F.array_sort(repeated), ",").alias("terms"))


def events_with_terms(events: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per event, match key and chunk with the sorted term list as comma text."""
    lists = gather_terms(terms, ["event_name", "match_key"])
    return event_terms(events, lists)


def active_events(
    events: DataFrame, keywords: DataFrame, follows: DataFrame, covid19: DataFrame
) -> DataFrame:
    """Active events of all three kinds with match key and term list, by chunk."""
    live = events.where(F.col("status") == ACTIVE)
    return events_with_terms(live, tagged_terms(keywords, follows, covid19))


def active_terms(events: DataFrame, terms: DataFrame, column: str) -> DataFrame:
    """Distinct terms of active events.

    Terms are made distinct per event before the join, so the join and the last
    distinct see each (event, term) once however often the term table repeats it.
    """
    live = events.where(F.col("status") == ACTIVE).select(F.col("normalized_name").alias("event_name"))
    distinct = terms.select("event_name", column).distinct()
    return distinct.join(live, "event_name", "left_semi").select(column).distinct()


def active_term_string(events: DataFrame, terms: DataFrame) -> DataFrame:
    """Per match key the distinct terms of active events as comma text, by chunk."""
    live = events.where(F.col("status") == ACTIVE).select(F.col("normalized_name").alias("event_name"))
    rows = terms.join(live, "event_name", "left_semi")
    return gather_terms(rows, ["match_key"], distinct=True)


def sync_diff(active: DataFrame, running: DataFrame, key: str = "normalized_name") -> DataFrame:
    """What to stop (running, not active) and what to start (active, not running)."""
    want, have = active.select(key).distinct(), running.select(key).distinct()
    stop = have.join(want, key, "left_anti").withColumn("action", F.lit("stop"))
    start = want.join(have, key, "left_anti").withColumn("action", F.lit("start"))
    return stop.unionByName(start)


def lifecycle_log(diff: DataFrame, author: str, now: Column) -> DataFrame:
    """Activity rows for a start/stop difference."""
    kind = F.when(F.col("action") == "start", START_EVENT).otherwise(PAUSE_EVENT)
    return diff.select(
        kind.alias("type"),
        now.alias("time"),
        F.lit(author).alias("author"),
        F.col("normalized_name").alias("event_name"),
    )


def creation_log(events: DataFrame, now: Column) -> DataFrame:
    """Activity rows for newly inserted events."""
    return events.select(
        F.lit(CREATE_EVENT).alias("type"), now.alias("time"), "author",
        F.col("normalized_name").alias("event_name"),
    )


def add_events(
    events: DataFrame, terms: DataFrame, activity: DataFrame, new: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows to append to (events, terms, activity) for new events.

    ``new`` has name, description, author, status, match_key and a keyword list, and may have
    ``created_at``; without one the event is created ``now``. Invalid events and events whose
    normalized name is taken are left out; of new events with the same normalized name the
    first by name is taken.
    """
    valid = validate_events(new).where(F.size("reasons") == 0).drop("reasons")
    created = F.coalesce("created_at", now) if "created_at" in new.columns else now
    valid = valid.withColumn("created_at", created.cast("timestamp"))
    head = [*EVENT_COLUMNS, "match_key", "keywords"]
    first = first_per_key(valid.select(*head), ["normalized_name"], ["name", "description"])
    added = first.join(events.select("normalized_name"), "normalized_name", "left_anti")
    event_rows = added.select(*[c for c in EVENT_COLUMNS if c in events.columns])
    term_rows = added.select(
        F.col("normalized_name").alias("event_name"), F.explode("keywords").alias("term"), "match_key"
    ).select(*terms.columns)
    return event_rows, term_rows, creation_log(added, now).select(*activity.columns)


def set_status(events: DataFrame, changes: DataFrame) -> DataFrame:
    """Event table after status changes (``normalized_name``, ``status``; one row per event)."""
    new = changes.select("normalized_name", F.col("status").alias("_new"))
    return (
        events.join(new, "normalized_name", "left")
        .withColumn("status", F.coalesce("_new", "status"))
        .select(*events.columns)
    )


def event_detail(
    events: DataFrame, terms: DataFrame, activity: DataFrame, normalized_name: str | None = None
) -> DataFrame:
    """Events, their terms and their activity as rows of three kinds, in order.

    ``event`` rows hold the event alone, ``terms`` rows a match key and a chunk of its sorted
    terms, ``activity`` rows one entry each, in time order. Nothing of an event is copied to
    its other rows but its name and status, and sorting by (event, kind, time) spreads a busy
    event over several tasks.
    """
    if normalized_name is not None:
        events = events.where(F.col("normalized_name") == normalized_name)
        terms = terms.where(F.col("event_name") == normalized_name)
        activity = activity.where(F.col("event_name") == normalized_name)
    narrow = events.select("normalized_name", "status")
    lists = gather_terms(terms, ["event_name", "match_key"])
    listed = narrow.join(lists, narrow.normalized_name == lists.event_name).drop("event_name")
    log = activity.select(
        F.col("event_name").alias("_event"),
        F.col("type").alias("activity_type"),
        F.col("time").alias("activity_time"),
        F.col("author").alias("activity_author"),
    )
    busy = narrow.join(log, narrow.normalized_name == log["_event"]).drop("_event")
    rows = events.withColumn("kind", F.lit("event"))
    rows = rows.unionByName(listed.withColumn("kind", F.lit("terms")), allowMissingColumns=True)
    rows = rows.unionByName(busy.withColumn("kind", F.lit("activity")), allowMissingColumns=True)
    place = F.when(F.col("kind") == "event", 0).when(F.col("kind") == "terms", 1).otherwise(2)
    return rows.orderBy("normalized_name", place, "activity_time", "activity_type", "activity_author", "match_key", "chunk")
