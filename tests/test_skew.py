"""Results stay whole when one key holds a third of all rows."""

import glob
import os
import shutil

import duckdb
import pytest

import __spark_entry__ as entry
from tests.test_oracles import canonical

SOURCE = "/root/testdata/sf0.001"
KEYS = [
    "mentions_ranking", "media_extract", "page_by_position", "geotag_first", "geo_box_query", "route_rules",
    "file_offset_index", "latest_files", "index_refresh", "page_tweets", "counts_hour", "event_detail",
    "events_with_terms", "active_term_string", "upsert_ignore", "search_tweets", "land_hourly",
]
HOT = {
    "lineitem": """SELECT * REPLACE (CASE WHEN hash(l_orderkey * 7 + l_linenumber) % 3 = 0 THEN 5 ELSE l_suppkey END AS l_suppkey,
        CASE WHEN hash(l_orderkey + l_partkey) % 3 = 0 THEN 7 ELSE l_orderkey END AS l_orderkey) FROM source""",
    "orders": "SELECT * REPLACE (CASE WHEN hash(o_orderkey) % 3 = 0 THEN 3 ELSE o_custkey END AS o_custkey) FROM source",
    "events": """SELECT * REPLACE (CASE WHEN hash(event_id) % 3 = 0 THEN 2 ELSE user_id END AS user_id,
        CASE WHEN hash(event_id) % 3 = 0 THEN 'click' ELSE event_type END AS event_type,
        CASE WHEN hash(event_id) % 3 = 0 THEN TIMESTAMP '2024-01-05 03:00:00' + to_milliseconds(event_id) ELSE ts END AS ts) FROM source""",
    "documents": """SELECT * REPLACE (CASE WHEN hash(doc_id) % 3 = 0 THEN (SELECT text FROM source WHERE doc_id = 1) ELSE text END AS text)
        FROM source""",
}


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skewed"))
    con = duckdb.connect()
    for path in glob.glob(f"{SOURCE}/*.parquet"):
        name = os.path.basename(path)[:-8]
        target = f"{folder}/{name}.parquet"
        if name in HOT:
            con.execute(f"CREATE OR REPLACE VIEW source AS SELECT * FROM '{path}'")
            con.execute(f"COPY ({HOT[name]}) TO '{target}' (FORMAT parquet)")
        else:
            shutil.copyfile(path, target)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{target}'")
    return folder, con


@pytest.mark.parametrize("key", KEYS)
def test_same_result_with_hot_keys(spark, skewed, key):
    folder, con = skewed
    ours = entry.queries()[key](spark, folder)
    got = canonical(ours.columns, [tuple(r) for r in ours.collect()])
    result = con.execute(entry.oracle_sql()[key])
    names = [d[0] for d in result.description]
    assert got == canonical(names, result.fetchall())
