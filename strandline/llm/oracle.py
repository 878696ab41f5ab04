"""DuckDB SQL for the operators that SQL can express, over whole tables and texts: plain joins of all shingles and windows."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS x FROM d),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
 e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT doc_id AS f, doc_id AS t FROM d UNION SELECT r.f, e.b FROM r JOIN e ON e.a = r.t),
 m AS (SELECT f, min(t) AS c FROM r GROUP BY 1)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM d JOIN m ON m.f = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

OP6 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
 v AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda i: array_to_string(w[i:i + 9], ' '))) AS x FROM b WHERE len(w) > 0),
 k AS (SELECT DISTINCT n FROM v),
 g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, k WHERE len(w) >= n)),
 h AS (SELECT g.doc_id, g.n, g.i, v.item_id FROM g JOIN v ON v.n = g.n AND v.x = g.x),
 t AS (SELECT doc_id, count(DISTINCT i) AS c FROM (SELECT doc_id, unnest(range(i, i + n)) AS i FROM (SELECT DISTINCT doc_id, n, i FROM h)) GROUP BY 1),
 q AS (SELECT doc_id, list(item_id ORDER BY item_id) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY 1)
 SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(t.c, 0) AS n_hit, CAST(coalesce(len(q.l), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(q.l, ','), '')) AS items_sha256, coalesce(t.c, 0) > 0 AS contaminated FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN q ON q.doc_id = d.doc_id"""

OP10 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 g AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
 f AS (SELECT h, min(doc_id) AS m FROM g GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
 r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM g JOIN f ON f.h = g.h AND g.doc_id > f.m),
 x AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
 k AS (SELECT x.doc_id, list(x.w[x.i] ORDER BY x.i) AS w FROM x ANTI JOIN r ON r.doc_id = x.doc_id AND r.i = x.i GROUP BY 1)
 SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(len(k.w), 0) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k.w, ' '), '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""
