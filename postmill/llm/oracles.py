"""The queries that SQL can express, as SQL over the same tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWERED = r"""regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k GROUP BY 1, 2),
l AS (
  SELECT a, b, c, na.n AS na, nb.n AS nb FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 5 * c >= 4 * (na.n + nb.n - c)
),
reach(a, b) AS (SELECT a, a FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b)
SELECT d.doc_id,
  coalesce((SELECT min(b) FROM l WHERE l.a = d.doc_id AND c = na AND na = nb), d.doc_id) AS class_id,
  (SELECT count(*) FROM l WHERE l.a = d.doc_id AND l.b <> d.doc_id) AS n_links,
  coalesce((SELECT min(b) FROM reach WHERE reach.a = d.doc_id), d.doc_id) AS component_id
FROM d
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
),
firsts AS (SELECT k, min(doc_id) AS m FROM windows GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, p
  FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN firsts USING (k) WHERE m < doc_id)
),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (
  SELECT e.doc_id, count(gone.p) AS n, string_agg(word, ' ' ORDER BY e.p) FILTER (WHERE gone.p IS NULL) AS t
  FROM e LEFT JOIN gone USING (doc_id, p) GROUP BY e.doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

BACKOFF = f"""
WITH d AS (SELECT doc_id, {LOWERED} AS w FROM documents),
t AS (SELECT doc_id, len(w) AS n, unnest(w) AS a, generate_subscripts(w, 1) AS p FROM d),
g AS (
  SELECT doc_id, n, p, a, lag(a) OVER o AS b, lag(a, 2) OVER o AS c FROM t
  WINDOW o AS (PARTITION BY doc_id ORDER BY p)
),
o1 AS (SELECT doc_id, a, count(*) AS n FROM g GROUP BY ALL),
o2 AS (SELECT doc_id, b, a, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY ALL),
o3 AS (SELECT doc_id, c, b, a, count(*) AS n FROM g WHERE c IS NOT NULL GROUP BY ALL),
t1 AS (SELECT a, sum(n) AS n FROM o1 GROUP BY ALL),
t2 AS (SELECT b, a, sum(n) AS n FROM o2 GROUP BY ALL),
t3 AS (SELECT c, b, a, sum(n) AS n FROM o3 GROUP BY ALL),
k AS (
  SELECT g.doc_id, least(g.p, 3) AS depth, t1.n - o1.n AS n1, t2.n - o2.n AS n2, t3.n - o3.n AS n3,
    (SELECT count(*) FROM t) - g.n AS d1, u1.n - v1.n AS d2, u2.n - v2.n AS d3
  FROM g
  JOIN t1 ON t1.a = g.a JOIN o1 ON o1.doc_id = g.doc_id AND o1.a = g.a
  LEFT JOIN t2 ON t2.a = g.a AND t2.b = g.b LEFT JOIN o2 ON o2.doc_id = g.doc_id AND o2.a = g.a AND o2.b = g.b
  LEFT JOIN t3 ON t3.a = g.a AND t3.b = g.b AND t3.c = g.c
  LEFT JOIN o3 ON o3.doc_id = g.doc_id AND o3.a = g.a AND o3.b = g.b AND o3.c = g.c
  LEFT JOIN t1 u1 ON u1.a = g.b LEFT JOIN o1 v1 ON v1.doc_id = g.doc_id AND v1.a = g.b
  LEFT JOIN t2 u2 ON u2.a = g.b AND u2.b = g.c LEFT JOIN o2 v2 ON v2.doc_id = g.doc_id AND v2.a = g.b AND v2.b = g.c
),
s AS (
  SELECT doc_id, sum(CASE
    WHEN depth = 3 AND n3 > 0 THEN ln(n3 / d3)
    WHEN depth >= 2 AND n2 > 0 THEN ln(n2 / d2) + (depth - 2) * ln(0.4)
    WHEN n1 > 0 THEN ln(n1 / d1) + (depth - 1) * ln(0.4)
    ELSE depth * ln(0.4) - ln(d1 + 1) END) AS score
  FROM k GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, round(coalesce(score, 0.0), 3) AS log_score FROM d LEFT JOIN s USING (doc_id)
"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {LOWERED} AS w FROM documents),
b AS (SELECT item_id, {LOWERED} AS w FROM benchmark),
items AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS k
  FROM (SELECT item_id, w, least(len(w), 13) AS l, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
),
found AS (
  SELECT doc_id, item_id, i, x.l FROM (
    SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS k
    FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM items) WHERE len(w) >= l)
  ) x JOIN items ON items.l = x.l AND items.k = x.k
),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM found GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(len(ids), 0) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
  coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

CHATS = """
WITH m AS (SELECT conv_id, turn, role, text, length(text) AS size, to_json(text)::VARCHAR AS quoted FROM conversations),
assistants AS (SELECT * FROM m WHERE role = 'assistant'),
answers AS (
  SELECT conv_id, turn, turn - 1 AS asked, n, quoted
  FROM (SELECT *, unnest(CASE WHEN size % 3 = 0 THEN [0] ELSE [0, 1] END) AS n FROM m WHERE role = 'user' AND turn > 0)
),
calls AS (
  SELECT conv_id, turn, 0 AS level, CASE WHEN size % 6 = 0 THEN 1 ELSE 0 END AS place, 0 AS n, 'search' AS name, size % 5 <> 0 AS valid,
    '{"limit":' || CASE WHEN size % 5 = 0 THEN '"many"' ELSE (size % 7)::VARCHAR END || ',"query":' || quoted || '}' AS arguments
  FROM assistants
  UNION ALL
  SELECT conv_id, turn, CASE WHEN size % 6 = 0 THEN 1 ELSE 0 END, CASE WHEN size % 6 = 0 THEN 0 ELSE 1 END, 1, 'summarise', size % 4 <> 0,
    CASE WHEN size % 4 = 0 THEN '{"words":' ELSE '{"short":' || (size < 200)::VARCHAR || ',"words":' END || size::VARCHAR || '}'
  FROM assistants
)
SELECT c.conv_id, c.turn, c.level, c.place, 'call' AS kind, CASE WHEN a.conv_id IS NULL THEN 'unanswered' ELSE 'answered' END AS status,
  c.conv_id || ':' || c.turn || ':' || c.n AS call_id, c.name, c.valid, (a.conv_id IS NOT NULL)::BIGINT AS n_results,
  '{"arguments":' || arguments || ',"id":"' || c.conv_id || ':' || c.turn || ':' || c.n || '","name":"' || c.name || '","result":'
    || coalesce(a.quoted, 'null') || '}' AS json
FROM calls c LEFT JOIN answers a ON a.conv_id = c.conv_id AND a.asked = c.turn AND a.n = c.n
UNION ALL
SELECT conv_id, turn, 0, -1, 'message', 'message', NULL, NULL, NULL, 0,
  '{"content":' || coalesce(quoted, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}'
FROM m WHERE NOT (role = 'user' AND turn > 0)
UNION ALL
SELECT a.conv_id, a.turn, 0, -1, 'orphan', 'orphan', a.conv_id || ':' || a.asked || ':' || a.n, NULL, NULL, 0,
  '{"content":' || a.quoted || ',"tool_call_id":"' || a.conv_id || ':' || a.asked || ':' || a.n || '"}'
FROM answers a ANTI JOIN assistants c ON c.conv_id = a.conv_id AND c.turn = a.asked
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
    AND len(list_filter(embedding, lambda y: y <> 0)) > 0
),
u AS (SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS n FROM v),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_inner_product(a.x, b.x) / (a.n * b.n) >= 0.9
),
reach(a, b) AS (SELECT a, a FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
lowest AS (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(m, vec_id) AS component_id, vec_id = coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN lowest USING (vec_id) LEFT JOIN degree USING (vec_id)
"""

MIXING = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len({WORDS}) AS size,
    CAST('0x' || substr(md5(concat_ws(':', '0', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))), 1, 13) AS BIGINT) AS draw
  FROM documents
),
c AS (
  SELECT *, coalesce('=' || source, '') AS k, CAST(length(bin(size)) AS BIGINT) AS bits,
    CASE WHEN size < 16 THEN size ELSE 8 * length(bin(size)) + (size >> (length(bin(size)) - 4)) - 8 END AS class
  FROM d
),
s AS (
  SELECT k, CAST(sum(size) AS BIGINT) AS source_size,
    CAST((row_number() OVER (ORDER BY min(source) NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM c GROUP BY k
),
fill AS (
  SELECT *, coalesce(3 * sum(source_size) OVER (ORDER BY 3 * source_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
    sum(weight) OVER (ORDER BY 3 * source_size / weight DESC, k DESC) AS free, sum(source_size) OVER () AS total
  FROM s
),
level AS (SELECT max(CAST(total - held AS DOUBLE) / free) AS level FROM fill),
t AS (SELECT k, source_size, least(CAST(3 * source_size AS DOUBLE), level * weight) AS target FROM s, level),
g AS (
  SELECT k, class, count(*) AS n, CAST(sum(size) AS BIGINT) AS words, CAST(sum(CAST(size AS HUGEINT) * size) AS DOUBLE) AS squares,
    min(size) AS low, max(size) AS high, row_number() OVER (PARTITION BY k ORDER BY class DESC) AS nth
  FROM c WHERE size > 0 GROUP BY k, class
),
f AS (
  SELECT k, 0::BIGINT AS nth, NULL::BIGINT AS class, 0::BIGINT AS whole, 0::BIGINT AS take, 0::DOUBLE AS tilt, 0::DOUBLE AS open FROM t
  UNION ALL
  SELECT k, nth, class, whole, take, tilt, wanted - copies * mean - tilt * varied
  FROM (
    SELECT *, CASE WHEN spread > 0 AND varied > 0
      THEN greatest(-room, least(room, (wanted - copies * mean) / varied)) ELSE 0 END AS tilt
    FROM (
      SELECT *, 0.9::DOUBLE * least(share, 1 - share) / nullif(spread, 0) AS room
      FROM (
        SELECT *, CAST(take AS DOUBLE) / n AS share, greatest(high - mean, mean - low) AS spread, squares - CAST(words AS DOUBLE) * mean AS varied
        FROM (
          SELECT *, copies - whole * n AS take
          FROM (
            SELECT *, CAST(floor(copies / n) AS BIGINT) AS whole
            FROM (
              SELECT *, CAST(greatest(0, least(3 * n, floor(wanted / mean + 0.5::DOUBLE))) AS BIGINT) AS copies
              FROM (
                SELECT g.*, target / source_size * CAST(words AS DOUBLE) + f.open AS wanted, CAST(words AS DOUBLE) / CAST(n AS DOUBLE) AS mean
                FROM f JOIN g ON g.k = f.k AND g.nth = f.nth + 1 JOIN t ON t.k = f.k
              )
            )
          )
        )
      )
    )
  )
),
r AS (
  SELECT c.doc_id, c.size, t.source_size, t.target, coalesce(f.whole, 0) AS whole, coalesce(f.take, 0) AS take,
    row_number() OVER (PARTITION BY c.k, c.class ORDER BY
      ((c.draw + 0.5::DOUBLE) / 4503599627370496 / (1 - (c.draw + 0.5::DOUBLE) / 4503599627370496))
      / ((CAST(take AS DOUBLE) / g.n + tilt * (c.size - CAST(words AS DOUBLE) / g.n))
        / (1 - (CAST(take AS DOUBLE) / g.n + tilt * (c.size - CAST(words AS DOUBLE) / g.n)))), c.draw, c.doc_id) AS place
  FROM c JOIN t ON t.k = c.k LEFT JOIN f ON f.k = c.k AND f.class = c.class LEFT JOIN g ON g.k = c.k AND g.class = c.class
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (whole + CASE WHEN place <= take THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""

# Checksum of UTF-8 bytes by its bitwise definition; near words meet where one letter is left out.
VARIANTS = """
WITH RECURSIVE steps AS (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, b: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
        FROM (SELECT unnest(range(256)) AS i))
),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run
  FROM documents
),
held AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS code FROM runs GROUP BY ALL),
marked AS (
  SELECT run, n, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(len(code) // 2), lambda i: CAST('0x' || substr(code, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8)), 4294967295) AS mark
  FROM held, steps
),
changed AS (
  SELECT n, CASE WHEN mark % 97 = 0 THEN substr(run, 1, mark % length(run)) || substr(run, mark % length(run) + 2) ELSE run END AS word
  FROM marked
),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
),
near AS (
  SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
),
best AS (SELECT word, count(*) AS n_near, min((-n, near)) AS best FROM near GROUP BY word),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 2 * n THEN best[2] END AS form, CASE WHEN -best[1] >= 2 * n THEN -best[1] END AS form_n
  FROM words LEFT JOIN best USING (word)
),
ends AS (
  SELECT word, word AS root, form AS onward FROM forms
  UNION ALL SELECT ends.word, forms.word, forms.form FROM ends JOIN forms ON forms.word = ends.onward
)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN ends ON ends.word = forms.word AND ends.onward IS NULL
"""

ORACLES = {
    "op1_ngram_jaccard": JACCARD,
    "op3_substring_dedup": SUBSTRINGS,
    "op4_lm_score": BACKOFF,
    "op5_decontaminate": DECONTAMINATE,
    "op7_chat_format": CHATS,
    "op8_embedding_dedup": EMBEDDINGS,
    "op11_mixing": MIXING,
    "op12_spelling_variants": VARIANTS,
}
