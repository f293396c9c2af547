"""The registered queries as plain SQL over the same tables, written independently."""

from __future__ import annotations

RUN_MS = 1704067200000
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"

ORDER_MS = "(CAST(epoch(o_orderdate) AS BIGINT) + CAST(floor(o_totalprice) AS BIGINT)) * 1000"
CREATED_AT = "strftime(make_timestamp(ms * 1000), '%a %b %d %H:%M:%S +0000 %Y')"

USER = """
  c_name AS name, replace(lower(c_name), '#', '') AS screen_name,
  c_mktsegment = 'MACHINERY' AS verified, CAST(NULL AS VARCHAR) AS created_at,
  c_mktsegment AS description, c_custkey AS statuses_count,
  CAST(c_nationkey AS BIGINT) AS favourites_count,
  CAST(floor(c_acctbal) AS BIGINT) AS followers_count,
  CAST(c_nationkey AS BIGINT) AS friends_count,
  'nation ' || c_nationkey AS location, CAST(NULL AS VARCHAR) AS time_zone,
  CAST(NULL AS VARCHAR) AS url, 'https://img/u' || c_custkey || '.png' AS profile_image_url_https"""

BASE = f"""
text_posts AS (
  SELECT CAST(doc_id AS VARCHAR) AS id_str, doc_id, text, lang, source, html AS full_text,
    {ORDER_MS} AS ms, o_orderpriority AS prio, o_custkey, c.*,
    CASE WHEN o_orderpriority = '2-HIGH' THEN CAST(c_nationkey AS VARCHAR) END AS reply,
    CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_custkey + 1 AS VARCHAR) END AS rt
  FROM documents LEFT JOIN orders ON o_orderkey = doc_id
  LEFT JOIN customer c ON c_custkey = o_custkey LEFT JOIN pages ON page_id = doc_id),
order_posts AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id_str, o_orderkey, o_custkey, {ORDER_MS} AS ms, o_orderpriority AS prio,
    o_orderstatus AS st, lower(c_mktsegment) AS event, c.*,
    o_totalprice / CAST(500000 AS DOUBLE) * CAST(360 AS DOUBLE) - CAST(180 AS DOUBLE) AS lon0,
    c_acctbal / CAST(10000 AS DOUBLE) * CAST(90 AS DOUBLE) AS lat0,
    CASE WHEN o_orderpriority = '2-HIGH' THEN CAST(c_nationkey AS VARCHAR) END AS reply,
    CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_custkey + 1 AS VARCHAR) END AS rt
  FROM orders JOIN customer c ON c_custkey = o_custkey),
boxes AS (
  SELECT *, lon0 - CAST(0.05 AS DOUBLE) AS west, lon0 + CAST(0.05 AS DOUBLE) AS east,
    lat0 - CAST(0.05 AS DOUBLE) AS south, lat0 + CAST(0.05 AS DOUBLE) AS north FROM order_posts),
points AS (
  SELECT *, CASE WHEN st = 'F' THEN lon0 ELSE (west + east) / 2 END AS lon,
    CASE WHEN st = 'F' THEN lat0 ELSE (south + north) / 2 END AS lat
  FROM boxes WHERE st IN ('F', 'O'))"""


def wrap(lon: str) -> str:
    return (
        f"(CASE WHEN abs({lon}) <= 180 THEN {lon} ELSE sign({lon}) * (abs({lon}) - "
        f"floor((abs({lon}) + CAST(180 AS DOUBLE)) / CAST(360 AS DOUBLE)) * CAST(360 AS DOUBLE)) END)"
    )


def cell(value: str, half: int, bits: int) -> str:
    n = 1 << bits
    return (
        f"CAST(least(floor(({value} + CAST({half} AS DOUBLE)) / CAST({2 * half} AS DOUBLE) * CAST({n} AS DOUBLE)), "
        f"{n - 1}) AS BIGINT)"
    )


def hash_of(x: str, y: str, precision: int) -> str:
    """Geohash text of column names x (grid column) and y (grid row)."""
    xb, yb = (5 * precision + 1) // 2, 5 * precision // 2
    out = []
    for k in range(precision):
        bits = []
        for j in range(5):
            i = 5 * k + j
            name, total = (x, xb) if i % 2 == 0 else (y, yb)
            bits.append(f"(({name} >> {total - 1 - i // 2}) & 1) * {2 ** (4 - j)}")
        out.append(f"substr('{ALPHABET}', CAST(1 + {' + '.join(bits)} AS BIGINT), 1)")
    return "(" + " || ".join(out) + ")"


HASHED = BASE + f""",
cells AS (
  SELECT *, {cell(wrap('lon'), 180, 25)} AS x10, {cell('lat', 90, 25)} AS y10,
    {cell(wrap('lon'), 180, 13)} AS x5, {cell('lat', 90, 12)} AS y5,
    {cell(wrap('lon'), 180, 10)} AS x4, {cell('lat', 90, 10)} AS y4 FROM points),
hashed AS (
  SELECT *, {hash_of('x10', 'y10', 10)} AS geo_hash, {hash_of('x5', 'y5', 5)} AS geo_hash5 FROM cells),
media AS (
  SELECT o_orderkey, 0 AS pos, 'https://img/orderkey/' || o_orderkey || '.jpg' AS image_link
  FROM orders WHERE o_orderpriority IN ('4-NOT SPECIFIED', '1-URGENT', '2-HIGH')
  UNION ALL
  SELECT o_orderkey, 1, 'https://img/custkey/' || o_custkey || '.jpg'
  FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
tags AS (
  SELECT event, replace(lower(c_name), '#', '') AS "user", CAST(c_custkey AS VARCHAR) AS user_id_str, geo_hash,
    {CREATED_AT} AS created_at, id_str AS tweet_id_str, 'und' AS lang, event AS source,
    reply AS in_reply_to_user_id_str, prio AS text, rt AS retweeted_status, image_link, pos, st, x4, y4, x10, y10
  FROM hashed JOIN media USING (o_orderkey)),
geo_index AS (SELECT * FROM tags WHERE pos = 0)"""

LON10 = "(x10 + CAST(0.5 AS DOUBLE)) / CAST(33554432 AS DOUBLE) * CAST(360 AS DOUBLE) - CAST(180 AS DOUBLE)"
LAT10 = "(y10 + CAST(0.5 AS DOUBLE)) / CAST(33554432 AS DOUBLE) * CAST(180 AS DOUBLE) - CAST(90 AS DOUBLE)"

LINES = """
mention AS (
  SELECT l_suppkey AS id, 'supplier' || l_suppkey AS screen_name, l_quantity, l_linenumber
  FROM lineitem WHERE l_returnflag <> 'N' AND l_linestatus <> 'F'
  UNION ALL
  SELECT CASE WHEN l_tax <> 0 THEN l_partkey END, CASE WHEN l_tax <> 0 THEN 'part' || l_partkey END,
    l_quantity, l_linenumber
  FROM lineitem WHERE l_returnflag <> 'N' AND l_linestatus <> 'F'),
ranking AS (
  SELECT id AS user_id,
    coalesce(string_agg(DISTINCT screen_name, ',' ORDER BY screen_name), '') AS "user",
    CAST(count(id) AS BIGINT) AS times_mentioned,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_retweets,
    CAST(sum(l_linenumber) AS BIGINT) AS total_likes
  FROM mention GROUP BY id),
line_media AS (
  SELECT 'supplier' || l_suppkey AS "user", l_partkey AS media_id,
    'https://img/partkey/' || l_partkey || '.jpg' AS image_link, 'https://post/partkey/' || l_partkey AS tweet_url
  FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL
  SELECT 'supplier' || l_suppkey, l_suppkey,
    'https://img/suppkey/' || l_suppkey || '.jpg', 'https://post/suppkey/' || l_suppkey
  FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O')"""


def _escaped(column: str) -> str:
    """JSON text of a string, as far as word matching can tell."""
    out = f"coalesce({column}, '')"
    for raw, shown in (("chr(92)", "'\\\\'"), ("chr(34)", "'\\\"'"), ("chr(10)", "'\\n'"), ("chr(9)", "'\\t'"), ("chr(13)", "'\\r'")):
        out = f"replace({out}, {raw}, {shown})"
    return out


RAW = BASE + f""",
raw AS (
  SELECT *, lower({_escaped('text')} || ' ' || {_escaped('full_text')} || ' ' || lang || source || ' ' || c_name
    || ' ' || c_mktsegment || ' ' || prio || ' ' || {CREATED_AT}) AS low
  FROM text_posts)"""


def _has(word: str, column: str = "low") -> str:
    return f"contains({column}, '{word}')"


STORM = f"(({_has('the')} AND {_has('with')}) OR ({_has('qui')} AND {_has('les')}))"
FLOOD = f"(({_has('und')} AND {_has('der')}) OR {_has('january')})"
QUAKE_IDS = "('3', '7', '11', '24')"
QUAKE = f"(CAST(c_custkey AS VARCHAR) IN {QUAKE_IDS} OR reply IN {QUAKE_IDS} OR rt IN {QUAKE_IDS})"

ROUTED = RAW + f""",
routed AS (
  SELECT 'storm' AS event, id_str FROM raw WHERE {STORM}
  UNION ALL SELECT 'flood', id_str FROM raw WHERE {FLOOD}
  UNION ALL SELECT 'quake', id_str FROM raw WHERE {QUAKE}
  UNION ALL SELECT 'fire', id_str FROM raw WHERE {_has('with')}
  UNION ALL SELECT 'everything', id_str FROM raw),
talk AS (
  SELECT 'turn-' || conv_id || '-' || turn AS id_str, lower({_escaped('text')}) AS low FROM conversations),
talk_routed AS (
  SELECT 'storm' AS event, id_str FROM talk WHERE {STORM}
  UNION ALL SELECT 'flood', id_str FROM talk WHERE {FLOOD}
  UNION ALL SELECT 'fire', id_str FROM talk WHERE {_has('with')}
  UNION ALL SELECT 'everything', id_str FROM talk)"""
FOLDER = "'2024/01/01/00' AS folder"


def _like(words: list[str], glue: str, negate: bool = False) -> str:
    op = "NOT LIKE" if negate else "LIKE"
    sides = [f" {glue} ".join(f"lower({c}) {op} '%{w}%'" for w in words) for c in ("text", "full_text")]
    return f"(({sides[0]}) OR ({sides[1]}))"


WORDS = "SELECT CAST(doc_id AS VARCHAR) AS id_str FROM documents LEFT JOIN (SELECT page_id, html AS full_text FROM pages) ON page_id = doc_id WHERE "
TREE = f"({_like(['the', 'with'], 'AND')} OR ({_like(['avec', 'dans'], 'OR')} AND {_like(['nicht'], 'AND', True)}))"
RARE = f"(({_like(['apache', 'license'], 'AND')} AND {_like(['nicht'], 'AND', True)}) OR {_like(['all rights reserved'], 'AND')})"
OF_THE = _like(["of the"], "AND")
FIXED = (
    "ms BETWEEN 883612800000 AND 946684800000 AND lang = 'en' AND "
    "(lower(c_mktsegment) IN ('machinery', 'building', '1-urgent') OR lower(prio) IN ('machinery', 'building', '1-urgent'))"
)

FILES = """
stored AS (
  SELECT event_type AS event, event_id AS post_id, ts, date_trunc('hour', ts) AS hour FROM events),
files AS (
  SELECT event, hour, epoch_us(max(ts)) // 1000 AS timestamp, count(*) AS size,
    event || '/' || strftime(max(ts), '%Y/%m/%d/%H/') || 'tweet-' || (epoch_us(max(ts)) // 1000) || '-' || count(*) || '.json.gz' AS filename
  FROM stored GROUP BY event, hour),
file_index AS (
  SELECT event, hour, filename, timestamp,
    CAST(coalesce(sum(size) OVER (PARTITION BY event ORDER BY filename ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_index,
    CAST(sum(size) OVER (PARTITION BY event ORDER BY filename) AS BIGINT) AS end_index
  FROM files),
totals AS (
  SELECT e.event, CAST(coalesce(max(end_index), -1) AS BIGINT) AS total_count
  FROM (SELECT event_type AS event FROM events UNION SELECT lower(r_name) FROM region) e
  LEFT JOIN file_index i ON i.event = e.event GROUP BY e.event)"""


def _counts(fmt: str) -> str:
    return (
        f"WITH {FILES} SELECT event, strftime(make_timestamp(timestamp * 1000), '{fmt}') AS \"time\", "
        'CAST(sum(end_index - start_index) AS BIGINT) AS "count" FROM file_index GROUP BY ALL'
    )


CATALOGUE = """
cat AS (
  SELECT s_suppkey, s_name AS name, 'supplier' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS normalized_name,
    CASE WHEN s_acctbal < 2000 THEN 'FAILED' WHEN s_acctbal < 4500 THEN 'NOT_ACTIVE' ELSE 'ACTIVE' END AS status,
    'nation ' || s_nationkey AS description, 'user' || s_nationkey || '@example.org' AS author,
    CASE WHEN s_nationkey < 12 THEN 'KEYWORDS' WHEN s_nationkey < 20 THEN 'FOLLOWS' ELSE 'COVID19' END AS match_key
  FROM supplier),
term_rows AS (
  SELECT DISTINCT s_suppkey, match_key, lower(strftime(l_shipdate, '%B')) AS term
  FROM lineitem JOIN cat ON s_suppkey = l_suppkey WHERE match_key = 'KEYWORDS'
  UNION ALL
  SELECT DISTINCT s_suppkey, match_key, CAST(l_linenumber AS VARCHAR)
  FROM lineitem JOIN cat ON s_suppkey = l_suppkey WHERE match_key = 'FOLLOWS'
  UNION ALL SELECT s_suppkey, match_key, '' FROM cat WHERE match_key = 'COVID19'),
lists AS (
  SELECT s_suppkey, string_agg(term, ',' ORDER BY term) AS terms FROM term_rows GROUP BY s_suppkey),
acts AS (
  SELECT 'supplier' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS event_name,
    CASE WHEN event_type = 'signup' THEN 'CREATE_EVENT' WHEN event_type IN ('click', 'view') THEN 'START_EVENT'
      ELSE 'PAUSE_EVENT' END AS activity_type,
    epoch_us(ts) AS activity_us, 'user' || user_id AS activity_author FROM events),
run AS (
  SELECT DISTINCT 'supplier' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS normalized_name
  FROM events WHERE event_type = 'error' AND value > 150),
diff AS (
  SELECT normalized_name, 'stop' AS action FROM run
  WHERE normalized_name NOT IN (SELECT normalized_name FROM cat WHERE status = 'ACTIVE')
  UNION ALL
  SELECT normalized_name, 'start' FROM cat
  WHERE status = 'ACTIVE' AND normalized_name NOT IN (SELECT normalized_name FROM run))"""

NOTES = """
notes AS (
  SELECT CAST(doc_id AS VARCHAR) AS tweet_id, 'good-quality' AS tag, 'quality' AS event_name FROM labels WHERE quality = 1
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 'toxic', 'toxicity' FROM labels WHERE toxic = 1)"""

# Java's white space, without the line feeds that RE2 spells the same way.
SPACES = r"[ \t\n\x0B\f\r]+"


def _slug(value: str) -> str:
    return f"lower(regexp_replace(regexp_replace({value}, '{SPACES}', '-', 'g'), '[^-a-zA-Z0-9]', '', 'g'))"


def _canonical(value: str) -> str:
    kept = f"regexp_replace({value}, ',+$', '')"
    return (
        f"CASE WHEN {value} = '' OR {kept} = '' THEN '' "
        f"ELSE array_to_string(list_sort(string_split({kept}, ',')), ',') END"
    )


PLACED_BOX = f"""
edge AS (
  SELECT id_str, {cell(wrap('west'), 180, 13)} AS x1,
    {cell(wrap('east'), 180, 13)} AS x2, {wrap('west')} > {wrap('east')} AS crosses,
    {cell('greatest(least(south, 90), -90)', 90, 12)} AS y1, {cell('greatest(least(north, 90), -90)', 90, 12)} AS y2
  FROM boxes WHERE st = 'O'),
columns_ AS (
  SELECT id_str, y1, y2, unnest(generate_series(x1, CASE WHEN crosses THEN least(x2 + 8192, x1 + 8191) ELSE x2 END)) % 8192 AS x FROM edge),
grid AS (SELECT id_str, x, unnest(generate_series(y1, y2)) AS y FROM columns_)"""

SUPPLIER_BOX = f"""
area AS (
  SELECT s_suppkey, s_acctbal / CAST(10000 AS DOUBLE) * CAST(90 AS DOUBLE) AS la,
    s_nationkey * CAST(14 AS DOUBLE) - CAST(170 AS DOUBLE) AS lo FROM supplier),
span AS (
  SELECT s_suppkey, {cell(wrap('(lo - 2)'), 180, 10)} AS x1, {cell(wrap('(lo + 2)'), 180, 10)} AS x2,
    {wrap('(lo - 2)')} > {wrap('(lo + 2)')} AS crosses,
    {cell('greatest(least(la - 2, 90), -90)', 90, 10)} AS y1, {cell('greatest(least(la + 2, 90), -90)', 90, 10)} AS y2
  FROM area)"""

ORACLES = {
    "mentions_ranking": f"WITH {LINES} SELECT * REPLACE (CAST(user_id AS VARCHAR) AS user_id) FROM ranking",
    "media_extract": f"WITH {LINES} SELECT * FROM line_media",
    "project_nested": f"""WITH {BASE} SELECT id_str, replace(lower(c_name), '#', '') AS "user",
        CAST(c_custkey AS VARCHAR) AS user_id_str,
        CASE prio WHEN '4-NOT SPECIFIED' THEN '1' WHEN '3-MEDIUM' THEN '0' WHEN '5-LOW' THEN NULL ELSE '2' END AS n_media,
        CASE WHEN st = 'O' THEN west END AS low_lon FROM boxes""",
    "project_tweet_user": f"WITH {BASE} SELECT id_str, text, CAST(ms AS VARCHAR) AS timestamp_ms, source, {USER} FROM text_posts",
    "filter_originals": f"WITH {BASE} SELECT id_str FROM text_posts WHERE rt IS NULL",
    "filter_geo_present": f"WITH {BASE} SELECT id_str FROM order_posts WHERE st IN ('F', 'O')",
    "filter_time_range": f"WITH {BASE} SELECT id_str, {CREATED_AT} AS created_at FROM order_posts WHERE ms BETWEEN 883612800000 AND 946684800000",
    "filter_lang": "SELECT CAST(doc_id AS VARCHAR) AS id_str, lang FROM documents WHERE lang = 'fr'",
    "filter_hashtag_any": f"WITH {BASE} SELECT id_str FROM text_posts WHERE c_mktsegment = 'MACHINERY' OR prio = '1-URGENT'",
    "filter_allwords": WORDS + _like(["the", "with"], "AND"),
    "filter_anywords": WORDS + _like(["avec", "nicht"], "OR"),
    "filter_notwords": WORDS + _like(["the", "und"], "AND", True),
    "filter_phrase": WORDS + _like(["of the", "and the"], "AND"),
    "filter_expr_tree": WORDS + TREE,
    "filter_full_query": f"WITH {BASE} SELECT id_str FROM text_posts WHERE {FIXED} AND ({TREE} OR {OF_THE})",
    "filter_full_query_legacy": f"WITH {BASE} SELECT id_str FROM text_posts WHERE {FIXED} AND {TREE} OR {OF_THE}",
    "search_tweets": f"""WITH {BASE}, hits AS (
        SELECT id_str, text, CAST(ms AS VARCHAR) AS timestamp_ms, source, {USER}, ms FROM text_posts WHERE {TREE}
        ORDER BY ms, id_str LIMIT 50 OFFSET 50) SELECT * EXCLUDE (ms) FROM hits""",
    "search_page_cached": f"""WITH {BASE}, hits AS (SELECT * FROM text_posts WHERE {TREE})
        SELECT id_str, CAST(ms AS VARCHAR) AS timestamp_ms, replace(lower(c_name), '#', '') AS screen_name, (SELECT count(*) FROM hits) AS total_count,
          CAST(ceil((SELECT count(*) FROM hits) / 50.0) AS BIGINT) AS num_pages,
          greatest(0, least(50, (SELECT count(*) FROM hits) - 50)) AS tweet_count
        FROM hits ORDER BY ms, id_str LIMIT 50 OFFSET 50""",
    "search_cached": f"WITH {BASE} SELECT id_str, text, CAST(ms AS VARCHAR) AS timestamp_ms, source, {USER} FROM text_posts WHERE {TREE}",
    "search_curated": f"""WITH {BASE} SELECT id_str, ms AS created_ms FROM text_posts
        WHERE ms BETWEEN 883612800000 AND 946684800000 AND lang = 'en' AND {TREE}""",
    "search_indexed": f"WITH {BASE} SELECT id_str, ms AS created_ms FROM text_posts WHERE {RARE}",
    "page_meta": f"""WITH t AS (SELECT count(*) AS n FROM ({WORDS}{TREE}))
        SELECT 'storm' AS event_name, CAST(2 AS BIGINT) AS page, CAST(50 AS BIGINT) AS "count", CAST(n AS BIGINT) AS total_count,
        CAST(ceil(n / 50.0) AS BIGINT) AS num_pages, CAST(greatest(0, least(50, n - 50)) AS BIGINT) AS tweet_count,
        CASE WHEN n < 50 THEN 'out_of_range' ELSE 'ok' END AS status FROM t""",
    "page_results": f"WITH {LINES} SELECT * REPLACE (CAST(user_id AS VARCHAR) AS user_id) FROM ranking ORDER BY times_mentioned DESC, ranking.user_id NULLS LAST LIMIT 100 OFFSET 100",
    "page_by_position": f"""WITH {LINES}, r AS (
        SELECT *, row_number() OVER (ORDER BY times_mentioned DESC, user_id NULLS LAST) - 1 AS position FROM ranking)
        SELECT * REPLACE (CAST(user_id AS VARCHAR) AS user_id) FROM r WHERE position >= 600 AND position < 700""",
    "match_keyword": f"WITH {RAW} SELECT id_str FROM raw WHERE {_has('the')} AND {_has('with')}",
    "match_follow": f"""WITH {BASE} SELECT id_str, CAST(c_custkey AS VARCHAR) = '24' OR coalesce(reply = '24', FALSE)
        OR coalesce(rt = '24', FALSE) AS is_match FROM text_posts""",
    "match_all": "SELECT CAST(doc_id AS VARCHAR) AS id_str FROM documents",
    "match_any_condition": f"WITH {RAW} SELECT id_str FROM raw WHERE {STORM}",
    "route_rules": f"WITH {ROUTED} SELECT event, id_str FROM routed",
    "route_rules_many": f"WITH {ROUTED} SELECT event, id_str FROM routed",
    "geohash_encode": f"WITH {HASHED} SELECT id_str, geo_hash, geo_hash5 FROM hashed",
    "geohash_decode": f"WITH {HASHED} SELECT id_str, {LON10} AS lon, {LAT10} AS lat FROM hashed",
    "bbox_center": f"""WITH {BASE} SELECT id_str, CASE WHEN st = 'O' THEN (west + east) / 2 END AS lon,
        CASE WHEN st = 'O' THEN (south + north) / 2 END AS lat FROM boxes""",
    "geo_resolve": f"WITH {BASE} SELECT id_str, lon, lat FROM points",
    "geohash_cover": f"WITH {BASE}, {PLACED_BOX} SELECT id_str, {hash_of('x', 'y', 5)} AS prefix FROM grid",
    "geotag_extract": f"WITH {HASHED} SELECT * EXCLUDE (pos, st, x4, y4, x10, y10) FROM tags",
    "geotag_first": f"""WITH {HASHED} SELECT event, geo_hash, created_at, "user" AS username, user_id_str, tweet_id_str,
        lang, source, in_reply_to_user_id_str, text, image_link, retweeted_status IS NOT NULL AS is_retweet FROM geo_index""",
    "geo_box_query": f"""WITH {HASHED}, box AS (
        SELECT {cell('CAST(-120 AS DOUBLE)', 180, 10)} AS x1, {cell('CAST(60 AS DOUBLE)', 180, 10)} AS x2,
          {cell('CAST(10 AS DOUBLE)', 90, 10)} AS y1, {cell('CAST(50 AS DOUBLE)', 90, 10)} AS y2)
        SELECT event, tweet_id_str, geo_hash, {LON10} AS lon, {LAT10} AS lat FROM geo_index, box
        WHERE x4 BETWEEN x1 AND x2 AND y4 BETWEEN y1 AND y2""",
    "geo_match_boxes": f"""WITH {HASHED}, {SUPPLIER_BOX} SELECT s_suppkey, tweet_id_str FROM geo_index JOIN span
        ON y4 BETWEEN y1 AND y2 AND CASE WHEN crosses THEN x4 >= x1 OR x4 <= x2 ELSE x4 BETWEEN x1 AND x2 END""",
    "is_retweet": "SELECT CAST(o_orderkey AS VARCHAR) AS id_str, o_orderpriority = '1-URGENT' AS is_retweet FROM orders",
    "file_index_parse": f"WITH {FILES} SELECT event, filename, timestamp, CAST(size AS BIGINT) AS size FROM files",
    "file_offset_index": f"WITH {FILES} SELECT * EXCLUDE (hour) FROM file_index",
    "latest_files": f"""WITH {FILES}, r AS (
        SELECT event, filename, row_number() OVER (PARTITION BY event ORDER BY filename DESC) AS k FROM files)
        SELECT event, filename FROM r WHERE k <= 10""",
    "event_totals": f"WITH {FILES} SELECT event, total_count FROM totals",
    "counts_hour": _counts("%Y-%m-%dT%H:00:00"),
    "counts_day": _counts("%Y-%m-%dT00:00:00"),
    "counts_month": _counts("%Y-%m-00T00:00:00"),
    "page_files": f"WITH {FILES} SELECT * EXCLUDE (hour) FROM file_index WHERE start_index < 300 AND end_index > 100",
    "page_tweets": f"""WITH {FILES}, r AS (
        SELECT event, post_id, row_number() OVER (PARTITION BY event ORDER BY ts, post_id) - 1 AS position FROM stored)
        SELECT event, position, post_id FROM r WHERE position >= 200 AND position < 300""",
    "page_status": f"""WITH {FILES} SELECT event AS event_name, CAST(21 AS BIGINT) AS page, CAST(100 AS BIGINT) AS "count", total_count,
        CAST(ceil(total_count / 100.0) AS BIGINT) AS num_pages,
        CAST(greatest(0, least(100, total_count - 2000)) AS BIGINT) AS tweet_count,
        CASE WHEN total_count = -1 THEN 'not_found' WHEN total_count < 2000 THEN 'out_of_range' ELSE 'ok' END AS status FROM totals""",
    "index_refresh": f"WITH {FILES} SELECT * EXCLUDE (hour) FROM file_index",
    "hour_path": f"WITH o AS (SELECT o_orderkey, {ORDER_MS} AS ms FROM orders) SELECT o_orderkey, strftime(make_timestamp(ms * 1000), '%Y/%m/%d/%H/') AS folder FROM o",
    "parse_created_at": f"SELECT CAST(o_orderkey AS VARCHAR) AS id_str, {ORDER_MS} AS ms FROM orders",
    "events_with_terms": f"WITH {CATALOGUE} SELECT name, normalized_name, status, match_key, CAST(0 AS INTEGER) AS chunk, terms FROM cat JOIN lists USING (s_suppkey)",
    "active_events": f"WITH {CATALOGUE} SELECT normalized_name, author, match_key, CAST(0 AS INTEGER) AS chunk, terms FROM cat JOIN lists USING (s_suppkey) WHERE status = 'ACTIVE'",
    "active_terms": f"""WITH {CATALOGUE} SELECT DISTINCT term AS keyword FROM term_rows JOIN cat USING (s_suppkey)
        WHERE status = 'ACTIVE' AND cat.match_key = 'KEYWORDS'""",
    "active_term_string": f"""WITH {CATALOGUE} SELECT cat.match_key, CAST(0 AS INTEGER) AS chunk, string_agg(DISTINCT term, ',' ORDER BY term) AS terms
        FROM term_rows JOIN cat USING (s_suppkey) WHERE status = 'ACTIVE' AND cat.match_key <> 'COVID19' GROUP BY cat.match_key""",
    "sync_diff": f"WITH {CATALOGUE} SELECT normalized_name, action FROM diff",
    "lifecycle_log": f"""WITH {CATALOGUE} SELECT CASE action WHEN 'start' THEN 'START_EVENT' ELSE 'PAUSE_EVENT' END AS type,
        CAST({RUN_MS} AS BIGINT) AS "time", 'sync@example.org' AS author, normalized_name AS event_name FROM diff""",
    "event_status": f"""WITH {CATALOGUE} SELECT normalized_name,
        CASE WHEN normalized_name IN (SELECT normalized_name FROM run) THEN 'FAILED' ELSE status END AS status FROM cat""",
    "event_detail": f"""WITH {CATALOGUE} SELECT normalized_name, status, 'event' AS kind, CAST(NULL AS VARCHAR) AS match_key, CAST(NULL AS INTEGER) AS chunk,
        CAST(NULL AS VARCHAR) AS terms, CAST(NULL AS VARCHAR) AS activity_type, CAST(NULL AS BIGINT) AS activity_us,
        CAST(NULL AS VARCHAR) AS activity_author FROM cat
        UNION ALL SELECT normalized_name, status, 'terms', match_key, 0, terms, NULL, NULL, NULL FROM cat JOIN lists USING (s_suppkey)
        UNION ALL SELECT normalized_name, status, 'activity', NULL, NULL, NULL, activity_type, activity_us, activity_author
        FROM cat JOIN acts ON event_name = normalized_name""",
    "exists_flags": f"""WITH {CATALOGUE} SELECT DISTINCT event_name AS normalized_name,
        event_name IN (SELECT normalized_name FROM cat) AS found FROM acts""",
    "validate_events": f"""SELECT c_name AS name, {_slug('c_name')} AS normalized_name,
        concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'description' END, CASE WHEN c_nationkey = 0 THEN 'keywords' END) AS reasons
        FROM customer""",
    "annotation_lookup": f"""WITH {NOTES} SELECT tweet_id, tag, event_name, CAST(NULL AS VARCHAR) AS authuser FROM notes
        WHERE event_name = 'quality' AND tag = 'good-quality'
        AND tweet_id IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE lang = 'en')""",
    "annotation_delete": f"""WITH {NOTES}, gone AS (
        SELECT tweet_id FROM notes GROUP BY tweet_id HAVING count(*) = count(*) FILTER (WHERE tag = 'toxic'))
        SELECT 'annotation' AS kind, tweet_id, tag FROM notes WHERE tag <> 'toxic'
        UNION ALL SELECT DISTINCT 'tweet', tweet_id, CAST(NULL AS VARCHAR) FROM notes WHERE tweet_id NOT IN (SELECT tweet_id FROM gone)""",
    "upsert_ignore": """WITH target AS (SELECT CAST(doc_id AS VARCHAR) AS tweet_id, 'label' AS origin FROM labels),
        batch AS (SELECT CAST(doc_id AS VARCHAR) AS tweet_id, source AS origin FROM documents
          UNION ALL SELECT CAST(page_id AS VARCHAR), 'page' FROM pages)
        SELECT * FROM target UNION ALL
        SELECT tweet_id, min(origin) FROM batch WHERE tweet_id NOT IN (SELECT tweet_id FROM target) GROUP BY tweet_id""",
    "upsert_bucketed": """SELECT CAST(doc_id AS VARCHAR) AS tweet_id, 'label' AS origin FROM labels
        UNION ALL SELECT CAST(doc_id AS VARCHAR), min(source) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id
        UNION ALL SELECT CAST(page_id AS VARCHAR), 'page' FROM pages
        WHERE page_id NOT IN (SELECT doc_id FROM labels) AND page_id NOT IN (SELECT doc_id FROM documents) GROUP BY page_id""",
    "slug_name": f"SELECT doc_id, {_slug('text')} AS slug FROM documents",
    "table_name": f"SELECT c_custkey, replace({_slug('c_name || chr(32) || lower(c_mktsegment)')}, '-', '_') AS table_name FROM customer",
    "canonical_words": f"SELECT doc_id, {_canonical('lower(text)')} AS words, {_canonical('text')} AS hashtags FROM documents",
    "query_key": f"""SELECT doc_id, sha256(source || '(ALLWORDS' || {_canonical('lower(text)')} || '),-,=' || lang || ',0,' || n_chars) AS key
        FROM documents""",
    "json_roundtrip": f"""WITH {BASE} SELECT id_str, text, lang, c_name AS name, full_text, c_mktsegment AS first_tag,
        rt AS retweeted_user FROM text_posts""",
    "scan_timeline": f"""WITH {BASE} SELECT id_str, lang, text, replace(lower(c_name), '#', '') AS screen_name,
        CAST(2 AS BIGINT) AS n_tags FROM text_posts""",
    "scan_tolerant": "SELECT CAST(doc_id AS VARCHAR) AS id_str, lang FROM documents",
    "scan_tolerant_counts": """SELECT unnest(['all', 'id_str', 'lang']) AS "of", n FROM (SELECT count(*) AS n FROM documents)""",
    "long_term_list": f"""WITH t AS (SELECT 'KEYWORDS' AS match_key, source || '-' || doc_id || '-' || text AS term FROM documents
        UNION ALL SELECT 'FOLLOWS', CAST(conv_id AS VARCHAR) FROM conversations)
        SELECT match_key, count(*) AS n_terms, sum(strlen(replace(term, ',', ';')))::BIGINT AS n_bytes FROM t GROUP BY match_key""",
    "route_rules_null": """SELECT 'everything' AS event, conv_id, turn FROM conversations
        UNION ALL SELECT 'the', conv_id, turn FROM conversations WHERE role <> 'system' AND contains(lower(text), 'the')""",
    "event_create": """SELECT 'event' AS kind, min(source) AS name, 'src' || regexp_extract(source, '[0-9]+') AS event_name, CAST(1700000000000 AS BIGINT) AS ms
        FROM documents GROUP BY source
        UNION ALL SELECT 'term', lang, source, NULL FROM (SELECT DISTINCT source, lang FROM documents)
        UNION ALL SELECT 'log', 'CREATE_EVENT', source, 1700000000000 FROM (SELECT DISTINCT source FROM documents)""",
    "annotation_check": """SELECT CAST(doc_id AS VARCHAR) AS tweet_id, CASE WHEN quality = 1 THEN 'good-text' ELSE '' END AS tag,
        CASE WHEN quality = 1 THEN '' ELSE 'tag' END AS reasons FROM labels""",
    "counts_by_column": f"""WITH o AS (SELECT o_orderstatus AS event, {ORDER_MS} AS ms FROM orders)
        SELECT event, strftime(make_timestamp(ms * 1000), '%Y-%m-%dT00:00:00') AS "time", count(*) AS "count" FROM o GROUP BY ALL""",
    "scan_quarantine": r"""SELECT 'post' AS kind, CAST(doc_id AS VARCHAR) AS value FROM documents
        UNION ALL SELECT 'bad', v FROM (SELECT regexp_replace(text, '[\r\n]+', ' ', 'g') AS v FROM conversations) WHERE trim(v) <> ''""",
    "scan_catalogue": f"""WITH {CATALOGUE} SELECT name, normalized_name, status, description, author, term AS keyword
        FROM cat JOIN term_rows USING (s_suppkey) WHERE cat.match_key = 'KEYWORDS'""",
    "adhoc_sql": f"WITH {BASE} SELECT lang, count(*) AS posts, count(full_text) AS long_posts FROM text_posts GROUP BY lang",
    "event_table_drift": f"""WITH {BASE} SELECT lang, count(*) AS posts, count(full_text) AS long_posts,
        CAST(sum(CASE WHEN doc_id % 2 = 0 THEN doc_id * 10 END) AS BIGINT) AS reach
        FROM text_posts WHERE ms < 820454400000 GROUP BY lang""",
    "frame_lines": "SELECT CAST(doc_id AS VARCHAR) AS id_str FROM documents",
    "union_partitions": """SELECT 'documents' AS feed, CAST(doc_id AS VARCHAR) AS id, text FROM documents
        UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), html FROM pages
        UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR), text FROM benchmark
        UNION ALL SELECT 'conversations', CAST(conv_id AS VARCHAR), text FROM conversations""",
    "stream_feed": "SELECT CAST(doc_id AS VARCHAR) AS id_str, lang FROM documents",
    "stream_source": "SELECT CAST(doc_id AS VARCHAR) AS id_str, lang FROM documents",
    "stream_sink": "SELECT 'turn-' || conv_id || '-' || turn AS id_str, text FROM conversations",
    "collect_to_pages": f"""WITH {ROUTED} SELECT event, 'count' AS kind, count(*) AS n FROM routed GROUP BY event
        UNION ALL SELECT 'everything', 'position', unnest(range(50, least(100, (SELECT count(*) FROM raw))))""",
    "land_hourly": f"WITH {ROUTED} SELECT event, {FOLDER}, id_str FROM routed",
    "restart_exactly_once": f"WITH {ROUTED} SELECT event, {FOLDER}, id_str FROM routed UNION ALL SELECT event, {FOLDER}, id_str FROM talk_routed",
    "rule_refresh": f"""WITH {ROUTED} SELECT event, {FOLDER}, id_str FROM routed WHERE event = 'fire'
        UNION ALL SELECT event, {FOLDER}, id_str FROM talk_routed WHERE event <> 'everything'""",
    "snapshot_write": f"""WITH {LINES} SELECT 'mentions' AS job, 'storm' AS event, CAST({RUN_MS} AS BIGINT) AS run_ms,
        (SELECT count(*) FROM ranking) AS row_count, 'parquet' AS format
        UNION ALL SELECT 'media', 'storm', CAST({RUN_MS + 1} AS BIGINT), (SELECT count(*) FROM line_media), 'json'""",
    "snapshot_latest": f"WITH {LINES} SELECT * REPLACE (CAST(user_id AS VARCHAR) AS user_id) FROM ranking",
}

# Jobs that are run twice, or read back, give what the plain queries give.
ORACLES |= {
    "geotag_load_twice": ORACLES["geotag_first"],
    "index_refresh_twice": ORACLES["index_refresh"],
    "index_refresh_parts": ORACLES["index_refresh"],
    "mentions_stored": ORACLES["mentions_ranking"],
    "snapshot_rows": ORACLES["media_extract"],
}
