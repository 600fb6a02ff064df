"""DuckDB SQL of the training-data queries that SQL can express. Near
duplicates and top-k are stated by all pairs, which is for small tables."""

from __future__ import annotations

from . import divergence, warc_fixity, winnow

URL_FILTER = r"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                               ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(rh, rp, v)),
cut AS (SELECT page_id, url, html, CASE WHEN position('://' IN url) > 0
                                        THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, url, html,
                 translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_replace(rest, '^[^/?#]*', '') AS after FROM cut),
named AS (SELECT page_id, url, html, host, regexp_extract(after, '^[^?#]*') AS path,
                 CASE WHEN host <> '' THEN host || CASE WHEN regexp_extract(after, '^[^?#]*') = '' THEN '/'
                      ELSE regexp_extract(after, '^[^?#]*') END || regexp_extract(after, '^[^?#]*(\?[^#]*)?', 1) END AS node
          FROM parts),
-- canonical links to whole addresses
tags AS (SELECT node, unnest(regexp_extract_all(html, '(?i)<link\b[^>]*>')) AS tag FROM named WHERE html ILIKE '%canonical%'),
links AS (SELECT node, regexp_extract(tag, '(?i)\shref\s*=\s*["'']?[a-z]+://([^"''\s>]+)', 1) AS rest FROM tags
          WHERE regexp_matches(tag, '(?i)\srel\s*=\s*["'']?canonical\b')),
targets AS (SELECT node AS a, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
                   || CASE WHEN regexp_matches(rest, '^[^/?#]*/') THEN '' ELSE '/' END
                   || regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^#]*') AS b
            FROM links WHERE rest <> '' AND node IS NOT NULL),
edges AS (SELECT a, b FROM targets UNION SELECT b, a FROM targets),
reach AS (SELECT a AS start, a AS node FROM edges UNION SELECT r.start, e.b FROM reach r JOIN edges e ON r.node = e.a),
ruled AS (SELECT DISTINCT node, regexp_extract(node, '^[^/?]*') AS host, regexp_extract(node, '^[^/?]*([^?]*)', 1) AS path
          FROM reach),
decided AS (SELECT r.node, arg_max(v, length(rh || rp)) AS v FROM ruled r JOIN rules
            ON (r.host = rh OR ends_with(r.host, '.' || rh)) AND starts_with(r.path, rp) GROUP BY r.node),
aliased AS (SELECT reach.start AS node, min(d.v) AS v FROM reach JOIN decided d ON d.node = reach.node GROUP BY 1),
own AS (SELECT n.page_id, n.url, n.host, n.path, n.node, r.rh || r.rp AS rule, r.v,
               row_number() OVER (PARTITION BY n.page_id ORDER BY length(r.rh || r.rp) DESC) AS nth
        FROM named n LEFT JOIN rules r ON (n.host = r.rh OR ends_with(n.host, '.' || r.rh)) AND starts_with(n.path, r.rp))
SELECT o.page_id, o.host, o.path, o.rule, coalesce(o.v, a.v, 'allow') AS verdict
FROM own o LEFT JOIN aliased a ON a.node = o.node WHERE o.nth = 1
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
c AS (SELECT doc_id, g, count(*) AS c FROM s GROUP BY ALL),
t AS (SELECT doc_id, sum(c) AS t FROM c GROUP BY ALL),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.c, y.c)) AS o
      FROM c x JOIN c y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN t ta ON ta.doc_id = a JOIN t tb ON tb.doc_id = b WHERE 5 * o >= 4 * (ta.t + tb.t - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept FROM k
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
             vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

SQL = {"op2_url_filter": URL_FILTER, "op3_minhash_dedup": NEAR_DUPLICATES, "op4_line_dedup": winnow.ORACLE,
       "op5_warc_fixity": warc_fixity.ORACLE, "op9_exact_topk": TOP_K,
       "op12_divergence": divergence.ORACLE}
