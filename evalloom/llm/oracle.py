"""SQL for the queries that SQL can express."""

from __future__ import annotations

#: the smallest node that each node reaches over ``links(u, v)``, both directions present
_REACH = """
reach AS (
  SELECT u AS node, u AS low FROM links
  UNION
  SELECT l.v, r.low FROM reach r JOIN links l ON l.u = r.node WHERE r.low < l.v
),
parts AS (SELECT node, min(low) AS component FROM reach GROUP BY node)
"""

MINHASH = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
    ELSE list_transform(range(1, len(w) - 3), lambda i: list_slice(w, i, i + 4)) END) AS s FROM words
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM common c JOIN sizes a ON a.doc_id = c.u JOIN sizes b ON b.doc_id = c.v WHERE 100 * c.n >= 85 * (a.n + b.n - c.n)
),
{_REACH}
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component, w.doc_id) AS component_id, coalesce(component, w.doc_id) = w.doc_id AS kept
FROM words w LEFT JOIN sizes s ON s.doc_id = w.doc_id LEFT JOIN parts p ON p.node = w.doc_id
"""

WINDOWS = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13),
windows AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY list_slice(w, i, i + 12)) < doc_id AS again FROM starts),
gone AS (SELECT DISTINCT doc_id, i + j AS spot FROM windows, range(13) t(j) WHERE again),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS spot FROM words),
kept AS (
  SELECT e.doc_id, count(g.spot) AS n_removed, string_agg(word, ' ' ORDER BY e.spot) FILTER (g.spot IS NULL) AS rest
  FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.spot = e.spot GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""

EMBEDDINGS = f"""
WITH RECURSIVE units AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM units a JOIN units b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95
),
{_REACH},
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(component, e.vec_id) AS component_id, coalesce(component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counts c ON c.u = e.vec_id LEFT JOIN parts p ON p.node = e.vec_id
"""

#: crc32 of a decimal text, bit by bit
_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1::UBIGINT)))), 4294967295::UBIGINT)"""

TRIE = f"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL
),
ids AS (SELECT conv_id AS c, CAST({_CRC.format("conv_id")} % 4 AS BIGINT) AS h FROM (SELECT DISTINCT conv_id FROM own)),
turns AS (
  SELECT c, i, r, t FROM ids JOIN own ON conv_id = c - c % 20 AND i < h
  UNION ALL
  SELECT c, i, r, t FROM ids JOIN own ON conv_id = c AND i >= h
),
listed AS (SELECT c, list(struct_pack(r := r, t := t) ORDER BY i) AS s FROM turns GROUP BY c),
rebuilt AS (SELECT c, coalesce(s, []) AS s FROM ids LEFT JOIN listed USING (c)),
prefix AS (SELECT c, d, len(s) AS n, sha256(CAST(to_json(list_slice(s, 1, d)) AS VARCHAR)) AS p, sha256(CAST(to_json(list_slice(s, 1, d - 1)) AS VARCHAR)) AS up,
    len(regexp_extract_all(coalesce(s[d].t, ''), '[^\\x20\\x09-\\x0D]+')) AS words
  FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)),
node AS (SELECT d, p, any_value(up) AS up, min(c) AS c, count(*) AS n, any_value(words) AS words, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d) AS ends FROM prefix GROUP BY d, p),
children AS (SELECT d - 1 AS d, up AS p, count(*) AS k FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN children USING (d, p)),
below AS (SELECT a.d, a.p, sum(CASE WHEN u.k = 0 THEN 1 ELSE 0 END) AS leaves, sum((u.n - 1) * u.words) AS saved
  FROM full_node u JOIN prefix a ON a.c = u.c AND a.d <= u.d GROUP BY a.d, a.p)
SELECT f.c AS conv_id, f.d AS depth, u.c AS parent_conv_id, f.n AS n_convs, CAST(f.k AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM full_node f JOIN below b USING (d, p) LEFT JOIN node u ON f.d > 0 AND u.d = f.d - 1 AND u.p = f.up
"""

PHRASES = """
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM cut),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
one AS (SELECT lang, w[i] AS p, count(*) AS f FROM spots GROUP BY ALL),
two AS (SELECT lang, w[i] || ' ' || w[i + 1] AS p, any_value(w[i]) AS p1, any_value(w[i + 1]) AS p2, count(*) AS f FROM spots WHERE i < len(w) GROUP BY lang, p HAVING count(*) >= 10),
three AS (SELECT lang, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS p, any_value(w[i]) AS p1, any_value(w[i + 2]) AS p3, any_value(w[i] || ' ' || w[i + 1]) AS p12, any_value(w[i + 1] || ' ' || w[i + 2]) AS p23, count(*) AS f
  FROM spots WHERE i < len(w) - 1 GROUP BY lang, p HAVING count(*) >= 10),
holds AS (SELECT lang, p, max(f) AS f FROM (SELECT lang, p12 AS p, f FROM three UNION ALL SELECT lang, p23, f FROM three) GROUP BY lang, p),
cuts AS (
  SELECT t.lang, t.p, 1 AS k, t.f AS a, x.f AS l, y.f AS r FROM two t JOIN one x ON x.lang = t.lang AND x.p = t.p1 JOIN one y ON y.lang = t.lang AND y.p = t.p2
    WHERE NOT EXISTS (SELECT 1 FROM holds h WHERE h.lang = t.lang AND h.p = t.p AND 100 * h.f >= 50 * t.f)
  UNION ALL SELECT t.lang, t.p, 1, t.f, x.f, y.f FROM three t JOIN one x ON x.lang = t.lang AND x.p = t.p1 JOIN two y ON y.lang = t.lang AND y.p = t.p23
  UNION ALL SELECT t.lang, t.p, 2, t.f, x.f, y.f FROM three t JOIN two x ON x.lang = t.lang AND x.p = t.p12 JOIN one y ON y.lang = t.lang AND y.p = t.p3
),
scored AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM lowest)
SELECT lang, rank, p AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN (SELECT lang, sum(f) AS n FROM one GROUP BY lang) USING (lang) WHERE rank <= 2000
"""

ORACLE = {"op11_phrase_mining": PHRASES, "op12_conversation_trie": TRIE, "op1_minhash_near_dedup": MINHASH, "op2_substring_dedup": WINDOWS, "op3_embedding_near_dedup": EMBEDDINGS}
