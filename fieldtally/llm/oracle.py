"""The queries that SQL can express, for DuckDB on the same tables."""

from __future__ import annotations

SHARD_BYTES = 16 << 20

NEIGHBOURS = """
WITH usable AS (
    SELECT vec_id, embedding::DOUBLE[] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
    FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

SHARDING = f"""
WITH sized AS (
    SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
           ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT AS h
    FROM documents
), levels AS (
    SELECT doc_id, n_bytes, depth, h >> (60 - depth) AS prefix
    FROM sized, (SELECT unnest(range(0, 61))::INTEGER AS depth)
), sums AS (
    SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs
    FROM levels GROUP BY depth, prefix
), fitting AS (
    SELECT doc_id, n_bytes, depth, prefix, shard_bytes, shard_docs,
           row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS nth
    FROM levels JOIN sums USING (depth, prefix)
    WHERE shard_bytes <= {SHARD_BYTES} OR shard_docs = 1
)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard,
       depth, shard_bytes, shard_docs
FROM fitting WHERE nth = 1
"""

LINES = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, source, text, coalesce(text, '') AS t FROM documents
), split AS (
    SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
    FROM docs
), windows AS (
    SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
    FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM split)
), repeated AS (
    SELECT r, count(DISTINCT j) AS n
    FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j
          FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS times FROM windows)
          WHERE times > 1)
    GROUP BY r
), counts AS (
    SELECT r, doc_id, source, text, len(w)::BIGINT AS n_words,
           length(array_to_string(w, ''))::BIGINT AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
           coalesce(n, 0)::BIGINT AS n_repeat_words
    FROM docs JOIN split USING (r) LEFT JOIN repeated USING (r)
), line AS (
    SELECT r, doc_id, source, text, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) AS x,
           len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n
    FROM (SELECT r, doc_id, source, text, unnest(l) AS x FROM docs JOIN split USING (r))
), hosts AS (
    SELECT source, count(DISTINCT text) AS all_docs FROM docs GROUP BY source
), above AS (
    SELECT f.source, f.x, f.first
    FROM (SELECT source, x, count(DISTINCT text) AS n, min(doc_id) AS first FROM line GROUP BY source, x) f
    JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source
                AND f.n > 5 AND f.n > 0.02 * h.all_docs
), removed AS (
    SELECT r, sum(n)::BIGINT AS n_removed_words
    FROM line l JOIN above a ON l.source IS NOT DISTINCT FROM a.source AND l.x = a.x
    WHERE l.doc_id IS NULL OR l.doc_id IS DISTINCT FROM a.first
    GROUP BY r
), judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
    FROM (SELECT c.*, coalesce(n_removed_words, 0)::BIGINT AS n_removed_words
          FROM counts c LEFT JOIN removed USING (r))
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_removed_words <= 0.7 * n_words AS kept, n_removed_words
FROM judged
"""

NEGATIVES = """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), anchors AS (
    SELECT DISTINCT * FROM usable WHERE vec_id % 100 = 0
), numbered AS (
    SELECT *, row_number() OVER () AS a FROM anchors
), scored AS (
    SELECT a, n.vec_id AS anchor_id, n.label AS own, u.vec_id, u.label,
           list_inner_product(n.v, u.v)::BIGINT AS score
    FROM numbered n JOIN usable u ON len(n.v) = len(u.v)
), positives AS (
    SELECT a, anchor_id, vec_id AS positive_id, score AS positive_score, p
    FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS p
          FROM scored WHERE label = own AND vec_id <> anchor_id)
    WHERE p <= 5
), ranked AS (
    SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, score AS negative_score,
           row_number() OVER (PARTITION BY a, p ORDER BY score DESC, s.vec_id)::INTEGER AS rank
    FROM positives p JOIN scored s USING (a)
    WHERE s.label <> s.own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""

COPIES = r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM docs WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id
    HAVING 100 * count(*) >= 85 * ((SELECT n FROM sizes WHERE doc_id = a.doc_id)
                                 + (SELECT n FROM sizes WHERE doc_id = b.doc_id) - count(*))
), reached AS (
    SELECT doc_id, doc_id AS other FROM docs
    UNION
    SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)
"""

TRIE = r"""
WITH turns AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT c, xor(4294967295, list_reduce(
               [4294967295] || list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT),
               lambda crc, byte: list_reduce(
                   [xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                   lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 4 AS cut
    FROM (SELECT DISTINCT c FROM turns)
), rebuilt AS (
    SELECT c.c, t.pos AS nth, role, text FROM convs c JOIN turns t ON t.c = c.c - c.c % 20 AND t.pos < c.cut
    UNION ALL
    SELECT c.c, 1000000 + t.pos, role, text FROM convs c JOIN turns t ON t.c = c.c AND t.pos >= c.cut
), placed AS (
    SELECT c, row_number() OVER (PARTITION BY c ORDER BY nth) AS depth, role, text,
           len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS words
    FROM rebuilt
), paths AS (
    SELECT c, 0 AS depth, []::VARCHAR[] AS k, 0::BIGINT AS words FROM convs
    UNION ALL
    SELECT c, depth, list(md5(len(role) || ':' || role || text)) OVER (PARTITION BY c ORDER BY depth), words FROM placed
), keyed AS (
    SELECT c, depth, md5(array_to_string(k, ' ')) AS k, depth = max(depth) OVER (PARTITION BY c) AS ended,
           words, lag(md5(array_to_string(k, ' '))) OVER (PARTITION BY c ORDER BY depth) AS up
    FROM paths
), nodes AS (
    SELECT depth, k, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
           sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '')) AS ends_sha256
    FROM keyed GROUP BY depth, k
), children AS (
    SELECT up AS k, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), counted AS (
    SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (k, depth)
), sums AS (
    SELECT p.k, p.depth, count(*) FILTER (w.n_children = 0) AS n_leaves,
           sum((w.n_convs - 1) * w.words)::BIGINT AS saved_tokens
    FROM counted w JOIN keyed p ON p.c = w.conv_id AND p.depth <= w.depth
    GROUP BY p.k, p.depth
)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM counted n JOIN sums USING (k, depth) LEFT JOIN nodes u ON n.up = u.k AND u.depth = n.depth - 1
"""

SQL = {
    "op7_lines": LINES,
    "op8_neighbours": NEIGHBOURS,
    "op9_sharding": SHARDING,
    "op11_hard_negatives": NEGATIVES,
    "op12_superminhash": COPIES,
    "op13_prefix_trie": TRIE,
}
