"""Matching raw posts against event rules.

A rule is (event, match_key, condition), the condition a comma list. A post goes to an
event at most once, however many items of the list match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.posts import parse_post
from postmill.functions.text import split_list
from postmill.schema import COVID19, FOLLOWS, POST_ACCOUNTS

# Every task holds the rules as a table while there are at most this many conditions in this many bytes.
MAX_TABLE_CONDITIONS = 100_000
MAX_TABLE_BYTES = 8 << 20
# So few rules are all tested on every post, which costs less than its letter groups.
MAX_DIRECT = 32
# Bits of the map of keys in use, and parts that the posts of one key are dealt to.
KEY_BITS = 1 << 20
LANES = 16
GRAM = 3
# Marks account keys; longer than any letter group, so the two never coincide.
ACCOUNT = "account:"


def java_trim(value: Column) -> Column:
    """Strip characters up to and including the blank from both ends."""
    return F.regexp_replace(value, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def keyword_terms(condition: Column) -> Column:
    """Lower-case blank-separated terms of one condition."""
    return F.split(F.lower(java_trim(condition)), " ")


def match_keyword(value: Column, condition: str | Column) -> Column:
    """Every term of the condition occurs in the lower-cased raw text of the post."""
    condition = F.lit(condition) if isinstance(condition, str) else condition
    return _once(F.lower(value), lambda low: _has_terms(low, keyword_terms(condition)))


def _has_terms(lowered: Column, terms: Column) -> Column:
    return F.forall(terms, lambda term: F.contains(lowered, term))


def _once(value: Column, test) -> Column:
    """``test(value)`` with the value worked out once, however often the test uses it."""
    return F.exists(F.array(value), test)


def accounts(value: Column) -> Column:
    """Account ids a raw post belongs to: author, replied-to account, repeated author.

    Null if the post is malformed or lacks an author, or repeats a post without author.
    """
    post = parse_post(value, POST_ACCOUNTS)
    repeated = post["retweeted_status"]
    usable = post["user"].isNotNull() & (repeated.isNull() | repeated["user"].isNotNull())
    ids = F.array(post["user"]["id_str"], post["in_reply_to_user_id_str"], repeated["user"]["id_str"])
    return F.when(usable, F.array_distinct(F.array_compact(ids)))


def match_follow(value: Column, condition: str | Column) -> Column:
    """The post belongs to the account; never null."""
    condition = F.lit(condition) if isinstance(condition, str) else condition
    return F.coalesce(F.array_contains(accounts(value), condition), F.lit(False))


def match_all(value: Column) -> Column:
    """Every post."""
    return F.lit(True)


def match_any_condition(value: Column, conditions: str | Column) -> Column:
    """Any item of a comma list of keyword conditions matches."""
    conditions = F.lit(conditions) if isinstance(conditions, str) else conditions
    return _once(
        F.lower(value),
        lambda low: F.exists(split_list(conditions), lambda c: _has_terms(low, keyword_terms(c))),
    )


def event_rules(rules: DataFrame) -> DataFrame:
    """One row per (event, match_key, single condition), repetitions removed.

    A match-all rule needs no condition.
    """
    listed = F.when(F.col("match_key") == COVID19, F.array(F.lit(""))).otherwise(split_list(F.col("condition")))
    return rules.select("event", "match_key", F.explode(listed).alias("condition")).distinct()


def route_rules(
    posts: DataFrame,
    rules: DataFrame,
    value: str = "value",
    max_conditions: int = MAX_TABLE_CONDITIONS,
) -> DataFrame:
    """(event, post columns) for every post and event whose rule it meets.

    Rules whose size (measured here) fits in every task become a table of slots that each post
    looks its keys up in, so posts are neither joined nor shuffled. More rules go through
    ``route_many``, where the same keys are equality joins.
    """
    routed = _table_sets(posts, rules, value, max_conditions)
    if routed is None:
        return route_many(posts, rules, value)
    return routed.select(F.explode("events").alias("event"), *[c for c in posts.columns if c != "event"])


def route_sets(
    posts: DataFrame,
    rules: DataFrame,
    value: str = "value",
    max_conditions: int = MAX_TABLE_CONDITIONS,
) -> DataFrame:
    """``route_rules`` before a post is multiplied: (``events``, post columns) of every post with an event.

    Equal sets are listed alike. With more rules than fit in a table a post comes once for each
    of its events.
    """
    routed = _table_sets(posts, rules, value, max_conditions)
    if routed is None:
        return route_many(posts, rules, value).withColumn("events", F.array("event")).drop("event")
    return routed


def _table_sets(posts: DataFrame, rules: DataFrame, value: str, max_conditions: int) -> DataFrame | None:
    """(``events``, post columns) of posts with an event, by a table of rules; None if they do not fit in one."""
    filed = filed_rules(rules).cache()
    try:
        size = filed.agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(
                F.sum(F.octet_length("event") + F.octet_length("_key") + F.octet_length(F.array_join("_terms", " "))), F.lit(0)
            ).alias("bytes"),
            F.collect_set(F.when(~_is_account("_key"), F.length("_key"))).alias("lengths"),
            F.coalesce(F.max(_is_account("_key")), F.lit(False)).alias("follows"),
        ).first()
        if size.n > max_conditions or size.bytes > MAX_TABLE_BYTES:
            return None
        slots = max(1024, 1 << (4 * size.n).bit_length())
        table, every = slot_table(filed, slots)
    finally:
        filed.unpersist()
    source = [c for c in posts.columns if c not in ("event", "events")]
    prepared = posts.select("*", F.lower(value).alias("_low"), (accounts(F.col(value)) if size.follows else _no_texts()).alias("_ids"))
    # Slots count from 1; keys without a rule in their slot are gone before anything is tested.
    slot = F.transform(offered_keys("_low", "_ids", size.lengths), lambda key: (F.pmod(F.xxhash64(key), F.lit(slots)) + 1).cast("int"))
    if size.n <= MAX_DIRECT:
        met, held = prepared, F.flatten(table)
    else:
        met = prepared.withColumn("_slots", F.array_distinct(F.filter(slot, lambda k: F.size(F.element_at(table, k)) > 0)))
        held = F.flatten(F.transform("_slots", lambda k: F.element_at(table, k)))
    passed = F.filter(held, lambda rule: _passes(rule, F.col("_low"), F.col("_ids")))
    events = F.array_sort(F.array_distinct(F.concat(every, F.flatten(F.transform(passed, lambda rule: rule["events"])))))
    # Filters on a generated column stay behind it; on a plain one each would test all rules again.
    return met.select(F.explode_outer(F.array(events)).alias("events"), *source).where(F.size("events") > 0)


def _no_texts() -> Column:
    return F.array().cast("array<string>")


def _is_account(key: str) -> Column:
    return F.coalesce(F.startswith(F.col(key), F.lit(ACCOUNT)), F.lit(False))


def filed_rules(rules: DataFrame) -> DataFrame:
    """(event, _key, _terms) of every condition, filed under one key.

    An account rule is filed under the account, a keyword condition under the first letters (at
    most ``GRAM``) of its longest term, a match-all rule under no key (null). A condition without
    letters is filed under the empty text, which every post offers.
    """
    single = event_rules(rules)
    is_follow, is_every = F.col("match_key") == FOLLOWS, F.col("match_key") == COVID19
    terms = keyword_terms(F.col("condition"))
    longest = F.array_max(F.transform(terms, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    return single.withColumn("match_key", F.coalesce("match_key", F.lit(""))).select(
        "event",
        F.when(is_follow, F.concat(F.lit(ACCOUNT), F.col("condition"))).when(~is_every, F.substring(longest, 1, GRAM)).alias("_key"),
        F.when(is_follow | is_every, _no_texts()).otherwise(F.array_sort(F.array_distinct(terms))).alias("_terms"),
    )


def offered_keys(low: str, ids: str, lengths: list[int]) -> Column:
    """Keys of a post: its accounts and its letter groups of the lengths that rules are filed under.

    A null post offers no letters.
    """
    # Overlapping groups: an empty match at every place that n letters follow.
    groups = [
        F.coalesce(F.regexp_extract_all(F.col(low), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)), _no_texts())
        if n
        else F.when(F.col(low).isNotNull(), F.array(F.lit(""))).otherwise(_no_texts())
        for n in sorted(lengths)
    ]
    return F.concat(F.transform(F.coalesce(ids, _no_texts()), lambda i: F.concat(F.lit(ACCOUNT), i)), *groups)


def _passes(rule: Column, low: Column, ids: Column) -> Column:
    """A rule met through a key holds: its account is one of the post's, or all its terms occur."""
    own = F.exists(ids, lambda i: F.concat(F.lit(ACCOUNT), i) == rule["_key"])
    return F.when(F.startswith(rule["_key"], F.lit(ACCOUNT)), F.coalesce(own, F.lit(False))).otherwise(_has_terms(low, rule["_terms"]))


def slot_table(filed: DataFrame, slots: int) -> tuple[Column, Column]:
    """(rules by slot of their key's hash, events of match-all rules), worked out once for all posts."""
    kind = F.struct("_key", "_terms", F.array_sort(F.collect_set("event")).alias("events"))
    rules = filed.where(F.col("_key").isNotNull()).groupBy("_key", "_terms").agg(kind.alias("rule"))
    rules = rules.groupBy(F.pmod(F.xxhash64("_key"), F.lit(slots)).alias("slot")).agg(F.array_sort(F.collect_list("rule")).alias("rules"))
    empty = F.array().cast(rules.schema["rules"].dataType)
    dense = filed.sparkSession.range(slots).withColumnRenamed("id", "slot").join(rules, "slot", "left")
    listed = F.array_sort(F.collect_list(F.struct("slot", F.coalesce("rules", empty).alias("rules"))))
    every = filed.where(F.col("_key").isNull()).agg(F.array_sort(F.collect_set("event")).alias("e"))
    return constant(dense.agg(F.transform(listed, lambda x: x["rules"]).alias("rules"))), constant(every)


def constant(single: DataFrame) -> Column:
    """The only value of a frame, an array of bounded size, as a constant that functions of posts can hold.

    A subquery may not stand inside a function of arrays.
    """
    (field,) = single.schema.fields
    value = single.select(F.to_json(F.col(f"`{field.name}`"))).first()[0]
    return F.from_json(F.lit(value), field.dataType)


def key_bits(filed: DataFrame) -> Column:
    """2**20 bits, set for the hashes of all keys in use, as an array of longs: 128 KiB however many rules."""
    place = F.pmod(F.xxhash64("_key"), F.lit(KEY_BITS))
    words = filed.where(F.col("_key").isNotNull()).groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(_key), {KEY_BITS}) & 63 AS INT))")).alias("bits")
    )
    dense = filed.sparkSession.range(KEY_BITS // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    listed = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return constant(dense.agg(F.transform(listed, lambda x: x["bits"]).alias("bits")))


def keys_in_use(offered: Column, bits: Column) -> Column:
    """The offered keys whose bit is set, each once."""
    place = lambda key: F.pmod(F.xxhash64(key), F.lit(KEY_BITS))
    word = lambda key: F.element_at(bits, (F.shiftright(place(key), 6) + 1).cast("int"))
    return F.array_distinct(F.filter(offered, lambda key: F.getbit(word(key), (place(key) % 64).cast("int")) == 1))


def route_many(posts: DataFrame, rules: DataFrame, value: str = "value") -> DataFrame:
    """``route_rules`` for any number of rules, by equality joins.

    A post offers its accounts and letter groups as keys, of which only those with a rule
    (by a bitmap of fixed size) become rows; each meets the conditions filed under it, and the whole
    condition is tested on each meeting. Conditions are grouped by key and terms first, so
    events with the same condition cost one test. A key that most posts hold is dealt over
    ``LANES``, and so are the posts of match-all rules, which need no key.
    """
    filed = filed_rules(rules)
    keyed = filed.where(F.col("_key").isNotNull())
    # At most GRAM + 1 different lengths come back; posts only offer those in use.
    in_use = keyed.where(~_is_account("_key")).select(F.length("_key").alias("n")).distinct().collect()
    offered = keys_in_use(offered_keys("_low", "_ids", [row.n for row in in_use]), key_bits(filed))
    # What a post matches depends on its text alone, so candidates are found and tested
    # per text digest; the narrow rows of the keys never carry the text. No digest is empty, so
    # the empty text stands for a null post.
    digest = F.coalesce(F.sha2(value, 256), F.lit(""))
    lane = F.pmod(F.xxhash64("_post"), F.lit(LANES))
    lanes = F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))).alias("_lane")
    texts = posts.select(digest.alias("_post"), F.lower(value).alias("_low"), accounts(F.col(value)).alias("_ids")).dropDuplicates(["_post"])
    candidates = (
        texts.select("_post", F.explode(offered).alias("_key"))
        .withColumn("_lane", lane)
        .join(keyed.select("_key", "_terms").distinct().select("*", lanes), ["_key", "_lane"])
        .select("_post", "_key", "_terms")
    )
    tested = texts.join(candidates, "_post").where(_passes(F.struct("_key", "_terms"), F.col("_low"), F.col("_ids")))
    hits = tested.select("_post", "_key", "_terms").join(keyed, ["_key", "_terms"]).select("_post", "event").distinct()
    every = filed.where(F.col("_key").isNull()).select("event").distinct()
    source = [c for c in posts.columns if c != "event"]
    marked = posts.select(*source, digest.alias("_post"))
    # A match-all rule's posts are not looked up again through its other rules.
    found = marked.join(hits.join(every, "event", "left_anti"), "_post").select("event", *source)
    at_random = F.pmod(F.xxhash64("_post", F.monotonically_increasing_id()), F.lit(LANES))
    whole = marked.withColumn("_lane", at_random).join(every.select("event", lanes), "_lane").select("event", *source)
    return found.unionByName(whole)
