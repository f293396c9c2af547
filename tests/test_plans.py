"""Properties of physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from postmill.functions import geo
from postmill.operators import catalogue, geotag, routing, volume
from postmill.operators.predicates import PostQuery
from postmill.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def plan(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("key", list(entry.queries()))
def test_no_python_and_no_cartesian_product(spark, key):
    text = plan(entry.queries()[key](spark, SF))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "CartesianProduct"):
        assert node not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_routing_looks_rules_up_without_a_join(spark):
    posts, rules = fx.raw_posts(spark, SF).select("value"), fx.rules(spark)
    both = plan(routing.route_rules(posts, rules)), plan(posts)
    for kind in ("Join", "Exchange"):
        assert both[0].count(kind) == both[1].count(kind)
    assert "NestedLoop" not in both[0]


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.range(1000).select(
        (F.col("id") * 10).alias("start_index"), (F.col("id") * 10 + 10).alias("end_index"),
        F.lit("e").alias("event"), F.col("id").cast("string").alias("filename"), F.col("id").alias("timestamp"),
    )
    rows.write.parquet(path)
    text = plan(volume.page_files(spark.read.parquet(path), 100, 200, "e"))
    assert "LessThan(start_index,200)" in text and "GreaterThan(end_index,100)" in text


def test_box_bounds_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "geo")
    spark.range(10).select(
        geo.geohash_encode(F.col("id").cast("double"), F.col("id").cast("double")).alias("geo_hash"), "id"
    ).write.parquet(path)
    text = plan(geotag.geo_box_query(spark.read.parquet(path), (5.0, 1.0, 1.0, 5.0), 4))
    assert "GreaterThanOrEqual(geo_hash,s00" in text and "LessThan(geo_hash,s0" in text


def test_stored_time_and_language_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "posts")
    spark.range(10).select(F.col("id").alias("created_ms"), F.lit("en").alias("lang"), F.lit("t").alias("text")).write.parquet(path)
    posts = spark.read.parquet(path)
    query = PostQuery(start_ms=3, end_ms=5, language="en")
    found = query.apply(posts, ms=F.col("created_ms"), text=F.col("text"), full_text=F.col("text")).select("created_ms")
    text = plan(found)
    assert "GreaterThanOrEqual(created_ms,3)" in text and "EqualTo(lang,en)" in text
    assert "ReadSchema: struct<created_ms:bigint,lang:string>" in text


def test_curated_search_prunes_months(spark, tmp_path):
    from postmill.sinks import curated

    path = str(tmp_path / "curated")
    posts = spark.createDataFrame(
        [("1", "Fri Dec 31 00:00:00 +0000 1999", "en"), ("2", "Sun Jan 02 00:00:00 +0000 2000", "en"), ("3", "bad", "en")],
        "id_str string, created_at string, lang string",
    )
    curated.write_curated(posts, path)
    found = curated.search_curated(
        spark.read.parquet(path), PostQuery(start_ms=946771200000, language="en"), text=F.lit(""), full_text=F.lit("")
    )
    text = plan(found)
    assert "PartitionFilters: [isnotnull(month" in text and ">= 2000-01)" in text
    assert "GreaterThanOrEqual(created_ms,946771200000)" in text
    assert [r.id_str for r in found.collect()] == ["2"]


def test_ranking_shuffles_only_partial_sums(spark):
    text = plan(entry.queries()["mentions_ranking"](spark, SF))
    assert "partial_sum" in text and "ReadSchema" in text
    assert "l_comment" not in text and "l_extendedprice" not in text


def test_latest_files_are_trimmed_before_the_shuffle(spark):
    name = F.col("id").cast("string")
    files = spark.range(1000).select(F.substring(name, 1, 1).alias("event"), name.alias("filename"))
    text = plan(volume.latest_files(files)).split("\n\n")[0]
    assert text.count("WindowGroupLimit") == 2


def test_a_cover_is_never_broadcast(spark):
    """The size Spark reckons with is that of a few boxes, not of their many cells."""
    index = spark.range(100).select(F.concat(F.lit("s00"), "id").alias("geo_hash"), "id")
    boxes = spark.createDataFrame([(1, 50.0, -10.0, 40.0, 10.0)], "box int, nw_lat double, nw_lon double, se_lat double, se_lon double")
    text = plan(geotag.match_boxes(index, boxes, 4, "box"))
    assert "SortMergeJoin" in text and "Broadcast" not in text


@pytest.mark.parametrize("columns", [["text"], ["html", "full_text"]])
def test_text_posts_shuffle_each_text_once(spark, columns):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(fx.text_posts(spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    moved = re.findall(r"Exchange\nInput \[\d+\]: \[(.*)\]", text)
    assert len(moved) >= 4 and sum(any(f"{c}#" in x for c in columns) for x in moved) == 1


def test_long_lists_never_move_by_key_alone(spark):
    """All terms of a key in one task would be the whole of a long list."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        terms = spark.range(1000).select((F.col("id") % 2).cast("string").alias("match_key"), F.col("id").cast("string").alias("term"))
        text = plan(catalogue.gather_terms(terms, ["match_key"], chunk_bytes=64))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    moved = re.findall(r"Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning\((.*), \d+\)", text)
    carried = [by for columns, by in moved if "term#" in columns]
    assert carried and all("term#" in by or "chunk#" in by for by in carried)
