import json
import random

import pytest
from pyspark.sql import functions as F

from postmill.operators import routing

RULES = "event string, match_key string, condition string"


def raw(spark, *values):
    rows = [(str(i), v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "n string, value string")


def hits(df, condition):
    return [r.n for r in df.where(condition).orderBy("n").collect()]


def test_keyword_needs_every_term_anywhere_in_the_raw_text(spark):
    posts = raw(spark, {"text": "Big FIRE near lake"}, {"text": "fire"}, {"user": {"name": "lakefire"}}, "not json: fire lake")
    match = lambda c: hits(posts, routing.match_keyword(F.col("value"), c))
    assert match("Fire LAKE") == ["0", "2", "3"]
    assert match("  fire  lake ") == ["0", "2", "3"]
    assert match("") == ["0", "1", "2", "3"]


def test_condition_lists(spark):
    posts = raw(spark, "aa", "bb", "cc")
    match = lambda c: hits(posts, routing.match_any_condition(F.col("value"), c))
    assert match("aa,bb") == ["0", "1"]
    assert match("aa,,") == ["0"]
    assert match("aa,,bb") == ["0", "1", "2"]
    assert match("") == ["0", "1", "2"]
    assert match(",") == []


def test_follow(spark):
    posts = raw(
        spark,
        {"user": {"id_str": "7"}},
        {"user": {"id_str": "1"}, "in_reply_to_user_id_str": "7"},
        {"user": {"id_str": "1"}, "retweeted_status": {"user": {"id_str": "7"}}},
        {"user": {"id_str": "1"}, "retweeted_status": None},
        {"in_reply_to_user_id_str": "7"},
        {"user": {"id_str": "7"}, "retweeted_status": {"text": "x"}},
        {"user": {}, "in_reply_to_user_id_str": "7"},
        '{"user": {"id_str": "7"',
        "7",
    )
    assert hits(posts, routing.match_follow(F.col("value"), "7")) == ["0", "1", "2", "6"]
    flags = posts.select(routing.match_follow(F.col("value"), "7").alias("f")).collect()
    assert all(r.f is not None for r in flags)


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(5)
    words = ["fire", "Flood", "ab", "x", "storm watch", "ÉTÉ", "lake"]
    posts = []
    for _ in range(80):
        post = {"text": " ".join(rng.choices(words, k=rng.randint(0, 4))), "user": {"id_str": str(rng.randint(1, 6))}}
        if rng.random() < 0.3:
            post["in_reply_to_user_id_str"] = str(rng.randint(1, 6))
        posts.append(post)
    posts += [posts[0], posts[0], "", "x", "broken {", None]
    rules = [
        ("a", "KEYWORDS", "fire,flood fire,lake"), ("b", "KEYWORDS", "storm"), ("b", "KEYWORDS", "watch,ab"),
        ("c", "FOLLOWS", "1,2"), ("d", "COVID19", ""), ("e", "KEYWORDS", "x,é"), ("f", "KEYWORDS", ""),
        ("g", "FOLLOWS", "99"), ("h", "KEYWORDS", "zzz"), ("b", "FOLLOWS", "3"),
    ]
    return raw(spark, *posts).cache(), spark.createDataFrame(rules, RULES)


def expected(posts, rules):
    out = set()
    for r in rules.collect():
        for c in r.condition.split(",") if r.condition else [""]:
            if r.match_key == "FOLLOWS":
                keep = routing.match_follow(F.col("value"), c)
            elif r.match_key == "COVID19":
                keep = routing.match_all(F.col("value"))
            else:
                keep = routing.match_keyword(F.col("value"), c)
            out |= {(r.event, n) for n in hits(posts, keep)}
    return sorted(out)


def test_both_ways_of_routing_agree_and_keep_copies(many):
    posts, rules = many
    small = sorted((r.event, r.n) for r in routing.route_rules(posts, rules).collect())
    large = sorted((r.event, r.n) for r in routing.route_many(posts, rules).collect())
    forced = sorted((r.event, r.n) for r in routing.route_rules(posts, rules, max_conditions=3).collect())
    assert small == large == forced == expected(posts, rules)


def both(posts, rules):
    return [sorted((r.event, r.n) for r in way(posts, rules).collect()) for way in (routing.route_rules, routing.route_many)]


def generated(posts, seed=3):
    """Thousands of conditions, most of them met by no post, some by many."""
    rng = random.Random(seed)
    rows = [(f"e{k % 400}", "KEYWORDS", "".join(rng.choices("bcdfgklmn", k=rng.randint(3, 7)))) for k in range(3000)]
    rows += [(f"e{k % 400}", "FOLLOWS", str(10_000 + k)) for k in range(300)]
    rows += [("hot", "KEYWORDS", "common word"), ("hot", "KEYWORDS", "com"), ("hotter", "KEYWORDS", "commo"), ("all", "COVID19", ""), ("all", "KEYWORDS", "com")]
    texts = [{"text": f"a common word {''.join(rng.choices('bcdfgklmn', k=40))}", "user": {"id_str": str(10_000 + k % 50)}} for k in range(posts)]
    return texts, rows


def test_thousands_of_conditions_without_a_nested_loop(spark):
    texts, rows = generated(60)
    posts, rules = raw(spark, *texts, None, ""), spark.createDataFrame(rows, RULES)
    one, many = both(posts, rules)
    assert one == many == expected_in_python(texts + [None, ""], rows)
    for way in (routing.route_rules, routing.route_many):
        plan = way(posts, rules)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "Exchange" not in routing.route_rules(posts, rules)._jdf.queryExecution().executedPlan().toString()


def expected_in_python(texts, rows):
    out = set()
    for n, post in enumerate(texts):
        low = None if post is None else (post if isinstance(post, str) else json.dumps(post)).lower()
        for event, kind, condition in rows:
            if kind == "COVID19":
                out.add((event, str(n)))
            elif low is not None and kind == "FOLLOWS":
                if not isinstance(post, str) and post["user"]["id_str"] == condition:
                    out.add((event, str(n)))
            elif low is not None and all(t in low for t in condition.split(" ")):
                out.add((event, str(n)))
    return sorted(out)


def test_only_keys_with_a_rule_become_rows(spark):
    texts, _ = generated(40)
    posts = raw(spark, *texts).select(F.lower("value").alias("_low"), routing.accounts(F.col("value")).alias("_ids"))
    filed = routing.filed_rules(spark.createDataFrame([("a", "KEYWORDS", "common word"), ("b", "FOLLOWS", "10003"), ("c", "COVID19", "")], RULES))
    offered = routing.offered_keys("_low", "_ids", [3])
    kept = posts.select(F.explode(routing.keys_in_use(offered, routing.key_bits(filed))).alias("key")).groupBy("key").count().collect()
    found = {r.key: r["count"] for r in kept}
    assert found["com"] == 40 and found["account:10003"] == 1
    # Each post has about 90 letter groups; some may share a bit with a key in use.
    assert sum(found.values()) < 60
    assert posts.select(F.sum(F.size(offered))).first()[0] > 40 * 60


def test_hot_keys_are_dealt_over_lanes(spark):
    """A text that all posts share, a key that they all hold, and match-all rules."""
    texts = [{"text": "a common word", "user": {"id_str": "1"}}] * 300 + [{"text": f"common {k}", "user": {"id_str": "1"}} for k in range(300)]
    rows = [("hot", "KEYWORDS", "com"), ("acc", "FOLLOWS", "1"), ("blank", "KEYWORDS", " "), ("all", "COVID19", ""), ("every", "COVID19", "")]
    posts, rules = raw(spark, *texts), spark.createDataFrame(rows, RULES)
    one, many = both(posts, rules)
    assert one == many and len(one) == 5 * 600
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = routing.route_many(posts, rules)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("_lane") >= 4 and "hashpartitioning(_key" in plan
        assert all("_lane" in line for line in plan.splitlines() if "Exchange hashpartitioning(_key" in line and "_terms" not in line.split("hashpartitioning")[1].split("]")[0])
        assert sorted((r.event, r.n) for r in routing.route_many(posts, rules).collect()) == one
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_rules_and_columns_named_like_keys(spark):
    posts = raw(spark, {"text": "x", "user": {"id_str": "1"}}).withColumn("event", F.lit("old"))
    none = spark.createDataFrame([], RULES)
    assert both(posts, none) == [[], []]
    assert both(posts, spark.createDataFrame([("a", "KEYWORDS", "x"), ("b", "FOLLOWS", "1"), ("c", None, "x"), ("d", "FOLLOWS", None)], RULES)) == [
        [("a", "0"), ("b", "0"), ("c", "0")]
    ] * 2
