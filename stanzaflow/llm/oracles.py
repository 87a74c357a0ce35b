"""DuckDB SQL for the queries that SQL can express; no query of the engine reads these."""

#: A text's words, and the distinct five-word shingles of a list of words w (fewer words: all as one).
_WORDS = "list_filter(regexp_split_to_array(coalesce({}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_SHINGLES = (
    "list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]"
    " ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)"
)
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op2_substring_dedup": f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
win AS MATERIALIZED (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)
), hit AS (
  SELECT doc_id, p FROM win JOIN (SELECT k, min(doc_id) AS first FROM win GROUP BY k) USING (k) WHERE doc_id > first
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(p, p + 50)))) AS g FROM hit GROUP BY doc_id
), cut AS (
  SELECT d.doc_id, len(w) AS n_words, list_sort(coalesce(g, [])) AS g, w FROM d LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, len(g)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN len(g) = 0 THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END, ' '), '')) AS kept_sha256
FROM cut
""",
    "op3_minhash_dedup": f"""
WITH RECURSIVE s AS MATERIALIZED (
  SELECT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents)
), x AS MATERIALIZED (SELECT doc_id, len(s) AS n, md5(unnest(s)) AS h FROM s),
links AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT p.doc_id AS a, q.doc_id AS b, any_value(p.n) AS m, any_value(q.n) AS n, count(*) AS c
    FROM x p JOIN x q USING (h) WHERE p.doc_id <> q.doc_id GROUP BY ALL)
  WHERE 100 * c >= 85 * (m + n - c)
), reach AS (
  SELECT doc_id, doc_id AS other FROM s UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN least USING (doc_id)
""",
    "op5_suffix_dedup": f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE doc_id IS NOT NULL),
win AS MATERIALIZED (
  SELECT doc_id, p, md5(array_to_string(w[p + 1:p + 50], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS p FROM d WHERE len(w) >= 50)
), hit AS (
  SELECT DISTINCT doc_id, p, CASE WHEN doc_id = low THEN high ELSE low END AS other
  FROM win JOIN (SELECT k, min(doc_id) AS low, max(doc_id) AS high FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)) USING (k)
), run AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p, other) AS r
  FROM (SELECT *, coalesce((p > lag(p) OVER (PARTITION BY doc_id ORDER BY p, other) + 50)::INTEGER, 1) AS new FROM hit)
)
SELECT doc_id, min(p)::INTEGER AS "start", (max(p) + 50)::INTEGER AS "end", min(other) AS other_id FROM run GROUP BY doc_id, r
""",
    "op6_decontamination": f"""
WITH s AS MATERIALIZED (
  SELECT doc_id, unnest({_SHINGLES}) AS h FROM (SELECT doc_id, {_WORDS.format("lower(text)")} AS w FROM documents)
), q AS MATERIALIZED (
  SELECT item_id, len(h) AS n_item, unnest(h) AS h
  FROM (SELECT item_id, {_SHINGLES} AS h FROM (SELECT item_id, {_WORDS.format("lower(text)")} AS w FROM benchmark))
), c AS (SELECT doc_id, item_id, any_value(n_item)::BIGINT AS n_item, count(*)::BIGINT AS n_shared FROM s JOIN q USING (h) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM c WHERE 100 * n_shared >= 80 * n_item
""",
    "op8_mixing": f"""
WITH w AS MATERIALIZED (SELECT doc_id, source, len({_WORDS.format("text")})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM w GROUP BY source),
p AS (SELECT *, ([5, 2, 1][place % 3 + 1])::DOUBLE AS weight, 2::DOUBLE * source_size AS lim FROM s),
l AS MATERIALIZED (SELECT *, lim / weight AS ratio,
    (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY lim / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM p),
t AS MATERIALIZED (SELECT source, place, source_size, coalesce(least(lim, (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, place LIMIT 1) * weight), lim) AS target,
    least(greatest(ceil(source_size / 262144::DOUBLE), 1), 65536)::BIGINT AS shards FROM l),
b AS (SELECT coalesce(greatest(1, least(16, floor(min(target) / 16))), 16)::BIGINT AS block FROM t WHERE target > 0),
q AS (SELECT place, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, place) AS r
  FROM (SELECT place, target, unnest(range(0, (2 * target / block)::BIGINT + 2)) AS j FROM t, b WHERE target > 0)),
seats AS (SELECT place, count(*) AS seats FROM q WHERE r <= (SELECT round_even(sum(target) / any_value(block), 0) FROM t, b) GROUP BY place),
d AS MATERIALIZED (SELECT doc_id, size, source_size, target, place, ('0x' || substr(md5(concat_ws('|', 0, doc_id)), 1, 15))::BIGINT % shards AS shard,
    ('0x' || substr(md5(concat_ws('|', 1, doc_id)), 1, 15))::BIGINT AS h FROM w JOIN t ON w.source IS NOT DISTINCT FROM t.source),
c AS MATERIALIZED (SELECT place, shard, sum(size)::BIGINT AS shard_size, greatest(ceil(sum(size) / any_value(block)::DOUBLE), 1)::BIGINT AS blocks FROM d, b GROUP BY ALL),
g AS (SELECT place, shard, count(*) FILTER (r <= seats) AS quota FROM (
    SELECT place, shard, row_number() OVER (PARTITION BY place ORDER BY shard_size::DOUBLE / (2 * j + 1) DESC, shard) AS r
    FROM (SELECT *, unnest(range(0, 2 * blocks)) AS j FROM c WHERE shard_size > 0)) JOIN seats USING (place) GROUP BY place, shard),
m AS (SELECT d.*, blocks, block, coalesce(quota, 0) AS quota, ('0x' || substr(md5(concat_ws('|', 2, place, shard)), 1, 15))::BIGINT % blocks AS off,
    (sum(size) OVER (PARTITION BY place, shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS finish
  FROM d JOIN c USING (place, shard) LEFT JOIN g USING (place, shard), b),
x AS (SELECT *, least(finish // block, blocks - 1) AS n1, least((finish - size) // block, blocks - 1) AS n0 FROM m)
SELECT doc_id, size, source_size, target, (
    block * ((n1 * quota + off) // blocks) + (((n1 + 1) * quota + off) // blocks - (n1 * quota + off) // blocks) * (finish - n1 * block)
  - block * ((n0 * quota + off) // blocks) - (((n0 + 1) * quota + off) // blocks - (n0 * quota + off) // blocks) * (finish - size - n0 * block))::BIGINT AS taken
FROM x
""",
    "op10_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * d.e[i]))::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.e) = len(d.e)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op12_spelling": """
WITH RECURSIVE step(i, c, b) AS (
  SELECT i, i, 0 FROM range(16) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b + 1 FROM step WHERE b < 4
), crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM step WHERE b = 4),
r AS MATERIALIZED (
  SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM (
    SELECT doc_id, run, count(*) AS n FROM (
      SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
      FROM documents) GROUP BY ALL)
), h AS MATERIALIZED (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x) + 1), lambda i:
      (strpos('0123456789ABCDEF', substr(x, CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END, 1)) - 1)::BIGINT)),
      lambda c, v: xor(c >> 4, t[(xor(c, v) & 15) + 1])), 4294967295) AS h
  FROM r, crc
), w AS MATERIALIZED (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM h GROUP BY word HAVING length(word) >= 6 AND sum(n) >= 5
), i AS MATERIALIZED (
  SELECT word, n, substr(word, 1, i) || '?' || substr(word, i + 2) AS hole, substr(word, 1, i) || substr(word, i + 2) AS less
  FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)
), near AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n FROM i a JOIN i b USING (hole) WHERE a.word <> b.word
  UNION SELECT i.word, w.word, w.n FROM i JOIN w ON i.less = w.word
  UNION SELECT w.word, i.word, i.n FROM i JOIN w ON i.less = w.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS most, (list(near ORDER BY n DESC, near))[1] AS near FROM near GROUP BY word
), f AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * w.n THEN near END AS form, CASE WHEN most >= 5 * w.n THEN most END AS form_n
  FROM w LEFT JOIN best USING (word)
), walk AS (
  SELECT word, coalesce(form, word) AS at FROM f UNION SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL
), root AS (SELECT walk.word, walk.at AS root FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM f JOIN root USING (word)
""",
    "op13_hard_negatives": """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id::BIGINT AS id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), a AS MATERIALIZED (SELECT row_number() OVER () AS a, * FROM (SELECT DISTINCT id, label, e FROM v WHERE id % 100 = 0)),
s AS MATERIALIZED (
  SELECT a.a, a.id AS anchor_id, v.id, v.label = a.label AS same, list_inner_product(a.e, v.e)::BIGINT AS score
  FROM a JOIN v ON v.id <> a.id AND len(v.e) = len(a.e)
), p AS (
  SELECT a, anchor_id, id AS positive_id, score AS positive_score, place
  FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS place FROM s WHERE same) WHERE place <= 5
), n AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.a, place ORDER BY s.score DESC, s.id)::INTEGER AS rank,
         s.id AS negative_id, positive_score, s.score AS negative_score
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
)
SELECT * FROM n WHERE rank <= 10
""",
}
