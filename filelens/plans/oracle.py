"""DuckDB SQL with the same answer as each registered query.

The derived relations of ``filelens.tables`` are restated once as CTEs.
"""

from __future__ import annotations

FILES = """files AS (
  SELECT doc_id AS file_id,
         '/corpus/' || source || '/' || lang || '/doc_' || CAST(doc_id AS VARCHAR) || ext AS path,
         'doc_' || CAST(doc_id AS VARCHAR) || ext AS name,
         ext AS extension,
         CAST(1700000000 + (doc_id * 7919) % 100000 AS BIGINT) AS last_modified,
         text, lang, source
  FROM (SELECT *, CASE doc_id % 8 WHEN 0 THEN '.txt' WHEN 1 THEN '.pdf' WHEN 2 THEN '.png'
                   WHEN 3 THEN '.jpg' WHEN 4 THEN '.jpeg' WHEN 5 THEN '.md' WHEN 6 THEN '.TXT'
                   ELSE '' END AS ext
        FROM documents) d
)"""

OLD = """old AS (
  SELECT file_id, path, name, extension,
         CAST(last_modified + 1 - file_id % 3 AS BIGINT) AS last_modified
  FROM files WHERE file_id % 5 <> 0
)"""

INDEX = """idx AS (
  SELECT f.file_id, f.path, f.name, f.extension, f.last_modified, e.embedding
  FROM files f LEFT JOIN embeddings e ON f.file_id = e.vec_id
)"""


def cos(a: str, b: str) -> str:
    """Cosine with the engine's edge rules, rounded to 6 decimals."""
    return (f"CASE WHEN {a} IS NULL OR {b} IS NULL OR len({a}) <> len({b}) THEN 0.0 "
            f"WHEN list_inner_product({a}::DOUBLE[], {a}::DOUBLE[]) = 0 "
            f"OR list_inner_product({b}::DOUBLE[], {b}::DOUBLE[]) = 0 THEN 0.0 "
            f"ELSE round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 6) END")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


SQL: dict[str, str] = {}

SQL["search_topk"] = with_(FILES, INDEX, "q AS (SELECT embedding FROM embeddings WHERE vec_id = 0)") + f"""
SELECT idx.file_id, idx.path, idx.name, idx.extension, {cos('idx.embedding', 'q.embedding')} AS score
FROM idx, q ORDER BY score DESC, idx.file_id LIMIT 5"""

WORDS = r"regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}]+')"


def words(t: str) -> str:
    return WORDS.format(t=t)


def bucket(tok: str, n: str) -> str:
    return f"(('0x' || substr(md5({tok}), 1, 7))::BIGINT % {n})"


SQL["index_vectors"] = with_(FILES, INDEX) + """
SELECT file_id, path, name, extension, last_modified,
       CAST(coalesce(len(embedding), 0) AS BIGINT) AS dim,
       round(coalesce(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 0.0), 6) AS norm
FROM idx"""

SQL["cosine_scores"] = with_(FILES, INDEX, "q AS (SELECT embedding FROM embeddings WHERE vec_id = 0)") + f"""
SELECT idx.file_id, {cos('idx.embedding', 'q.embedding')} AS score FROM idx, q"""

_BATCH = with_(FILES, INDEX, "q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings)") + f""",
s AS (SELECT q.query_id, idx.file_id, idx.path, idx.name, idx.extension, {cos('idx.embedding', 'q.qv')} AS score
      FROM idx, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_id) AS rank FROM s {{where}})
SELECT query_id, rank, file_id, path, name, extension, score FROM r WHERE rank <= 5"""
SQL["search_batch"] = _BATCH.replace("{where}", "")
SQL["search_threshold"] = _BATCH.replace("{where}", "WHERE score >= 0.3")

SQL["cosine_pairs"] = f"""
SELECT a.vec_id AS id_a, b.vec_id AS id_b, {cos('a.embedding', 'b.embedding')} AS score
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE {cos('a.embedding', 'b.embedding')} >= 0.3"""

SQL["l2_normalize"] = """
WITH u AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos,
                  greatest(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 1e-12) AS ss
           FROM embeddings)
SELECT vec_id AS file_id, pos, round(x::DOUBLE / sqrt(ss), 6) AS value FROM u"""

SQL["centroids"] = """
WITH u AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings)
SELECT CAST(label AS BIGINT) AS label, pos, round(avg(x::DOUBLE), 6) AS value FROM u GROUP BY label, pos"""

DAMAGED = """damaged AS (
  SELECT vec_id, CASE vec_id % 11 WHEN 0 THEN NULL WHEN 1 THEN []::FLOAT[]
                      WHEN 2 THEN embedding[1:len(embedding) - 1]
                      WHEN 3 THEN list_transform(embedding, lambda x: CAST(x * 2 AS FLOAT))
                      WHEN 4 THEN list_concat(['nan'::FLOAT], embedding[2:]) ELSE embedding END AS embedding
  FROM embeddings)"""
STORED_DIM = """d AS (SELECT len(embedding) AS d FROM embeddings WHERE len(embedding) > 0
           AND vec_id IN (SELECT file_id FROM old) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""

SQL["vector_health"] = with_(FILES, OLD, DAMAGED, STORED_DIM) + """,
v AS (SELECT vec_id, embedding, CAST(coalesce(len(embedding), 0) AS BIGINT) AS dim,
             sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM damaged)
SELECT vec_id AS file_id, dim, CASE WHEN NOT isnan(n) THEN round(n, 6) END AS norm,
       CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) = 0 THEN 'empty'
            WHEN dim <> (SELECT d FROM d) THEN 'bad_dim'
            WHEN len(list_filter(embedding, lambda x: isnan(x))) > 0 THEN 'nan'
            WHEN abs(n - 1.0) > 1e-2 THEN 'not_unit' ELSE 'ok' END AS status
FROM v"""

_VOCAB = f"""vocab AS (
  SELECT tok, cnt, CAST(row_number() OVER (ORDER BY cnt DESC, tok) + 3 AS BIGINT) AS token_id
  FROM (SELECT tok, count(*) AS cnt FROM (SELECT unnest({words('text')}) AS tok FROM documents) GROUP BY tok)
)"""

SQL["vocab_build"] = with_(_VOCAB) + "SELECT tok, cnt, token_id FROM vocab"

SQL["encode_fixed"] = with_(_VOCAB) + f""",
w AS (SELECT doc_id, unnest(ws) AS tok, unnest(range(len(ws))) AS pos
      FROM (SELECT doc_id, {words('text')} AS ws FROM documents)),
t AS (SELECT w.doc_id, w.pos // 254 AS win, w.pos, v.token_id FROM w JOIN vocab v USING (tok)),
g AS (SELECT doc_id, win, list(token_id ORDER BY pos) AS ids FROM t GROUP BY doc_id, win
      UNION ALL
      SELECT doc_id, 0, []::BIGINT[] FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM t)),
f AS (SELECT doc_id, win, [1] || ids || [2] AS ids FROM g)
SELECT doc_id, CAST(win AS BIGINT) AS "window", CAST(least(len(ids), 256) AS BIGINT) AS n_real,
       array_to_string(list_concat(ids[1:256], list_transform(range(greatest(256 - len(ids), 0)), lambda x: 0)), ' ') AS ids
FROM f"""


def _sparse(table: str, id_col: str, alias: str, n: str = "384") -> str:
    return f"""{alias}_tf AS (
  SELECT {id_col} AS id, {bucket('tok', n)} AS bucket, count(*) AS tf
  FROM (SELECT {id_col}, unnest({words('text')}) AS tok FROM {table}) GROUP BY ALL),
{alias} AS (SELECT id, bucket, tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)) AS weight FROM {alias}_tf)"""


SQL["hashed_embed"] = with_(_sparse("documents", "doc_id", "dw")) + \
    "SELECT id AS doc_id, bucket, round(weight, 6) AS weight FROM dw"

SQL["text_search"] = with_(_sparse("documents", "doc_id", "dw"), _sparse("benchmark", "item_id", "qw")) + """,
s AS (SELECT q.id AS query_id, d.id AS doc_id, round(sum(q.weight * d.weight), 6) AS score
      FROM qw q JOIN dw d USING (bucket) GROUP BY q.id, d.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 5"""

SQL["masked_mean_pool"] = f"""
WITH n AS (SELECT count(*) AS n FROM embeddings),
t AS (SELECT doc_id, {bucket('tok', '(SELECT n FROM n)')} AS tid
      FROM (SELECT doc_id, unnest({words('text')}) AS tok FROM documents)),
c AS (SELECT doc_id, tid, count(*) AS c FROM t GROUP BY ALL),
nr AS (SELECT doc_id, sum(c) AS n_real FROM c GROUP BY ALL),
e AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
s AS (SELECT c.doc_id, e.pos, sum(c.c * e.x::DOUBLE) AS s FROM c JOIN e ON c.tid = e.vec_id GROUP BY ALL)
SELECT s.doc_id, s.pos, round(s.s / greatest(nr.n_real, 1), 6) AS value FROM s JOIN nr USING (doc_id)"""

SQL["pool_windows"] = with_(_VOCAB) + f""",
w AS (SELECT doc_id, unnest(ws) AS tok, unnest(range(len(ws))) AS pos
      FROM (SELECT doc_id, {words('text')} AS ws FROM documents)),
t AS (SELECT w.doc_id, w.pos // 254 AS win, v.token_id FROM w JOIN vocab v USING (tok)),
f AS (SELECT doc_id, CAST(win AS BIGINT) AS win, doc_id % 7 AS c FROM t GROUP BY doc_id, win
      UNION ALL SELECT doc_id, 0, doc_id % 7 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM t)),
n AS (SELECT count(*) AS n FROM embeddings),
-- a window's words, and the tokens that start and end it
ids AS (SELECT doc_id, win, token_id AS id FROM t
        UNION ALL SELECT doc_id, win, unnest([1, 2]) FROM f),
real AS (SELECT ids.* FROM ids JOIN f USING (doc_id, win) WHERE f.c NOT IN (4, 5, 6)),
size AS (SELECT doc_id, win, count(*) AS n_real FROM real GROUP BY ALL),
c AS (SELECT doc_id, win, id % (SELECT n FROM n) AS vec_id, count(*) AS c FROM real GROUP BY ALL),
e AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
s AS (SELECT c.doc_id, c.win, e.pos, sum(c.c * e.x::DOUBLE) AS s FROM c JOIN e USING (vec_id) GROUP BY ALL),
every AS (SELECT f.*, d.pos FROM f LEFT JOIN (SELECT DISTINCT pos FROM e) d ON f.c NOT IN (5, 6))
SELECT y.doc_id, y.win AS "window", CASE WHEN y.c IN (5, 6) THEN 'failed' ELSE 'ok' END AS status,
       CASE WHEN y.c = 4 THEN 0 WHEN y.c < 4 THEN size.n_real END AS n_real, CAST(y.pos AS BIGINT) AS pos,
       CASE WHEN y.c = 4 THEN 0.0 WHEN y.c < 4 THEN round(s.s / size.n_real, 6) END AS value
FROM every y LEFT JOIN size USING (doc_id, win)
LEFT JOIN s ON s.doc_id = y.doc_id AND s.win = y.win AND s.pos = y.pos"""

SCAN = """scan AS (SELECT * FROM files WHERE extension IN ('.txt', '.pdf', '.png', '.jpg', '.jpeg'))"""

CHANGES = """changes AS (
  SELECT s.file_id, s.path, s.name, s.extension, s.last_modified, s.text,
         o.last_modified AS stored_last_modified,
         CASE WHEN o.path IS NULL THEN 'insert'
              WHEN s.last_modified > coalesce(o.last_modified, 0) THEN 'update' ELSE 'skip' END AS action
  FROM scan s LEFT JOIN old o USING (path)
)"""

DELTA = """delta AS (
  SELECT c.*, e.embedding,
         CASE WHEN c.text IS NULL OR length(c.text) = 0 OR c.file_id % 13 = 6 THEN 'no_text'
              WHEN e.embedding IS NULL OR len(e.embedding) = 0 THEN 'embed_failed'
              ELSE c.action END AS status
  FROM changes c LEFT JOIN embeddings e ON c.file_id = e.vec_id
  WHERE c.action IN ('insert', 'update')
)"""

SQL["ext_allowlist"] = with_(FILES, SCAN) + "SELECT file_id, path, extension FROM scan"

SQL["change_detect"] = with_(FILES, OLD, SCAN, CHANGES) + \
    "SELECT file_id, path, extension, last_modified, stored_last_modified, action FROM changes"

SQL["index_upsert"] = with_(FILES, OLD, SCAN, CHANGES, DELTA) + """
SELECT o.file_id, o.path, o.name, o.extension, o.last_modified, 'stored' AS origin,
       CAST(coalesce(len(e.embedding), 0) AS BIGINT) AS dim
FROM old o LEFT JOIN embeddings e ON o.file_id = e.vec_id
WHERE o.path NOT IN (SELECT path FROM delta WHERE status IN ('insert', 'update'))
UNION ALL
SELECT file_id, path, name, extension, last_modified, status, CAST(len(embedding) AS BIGINT)
FROM delta WHERE status IN ('insert', 'update')"""

SQL["index_run"] = "SELECT * EXCLUDE origin, CAST(origin <> 'stored' AS BIGINT) AS version FROM (" + SQL["index_upsert"] + ")"

SQL["run_counters"] = with_(FILES, OLD, SCAN, CHANGES, DELTA) + """
SELECT (SELECT count(*) FROM files) AS discovered,
       (SELECT count(*) FROM changes) AS eligible,
       (SELECT count(*) FROM changes WHERE action = 'skip') AS skipped,
       (SELECT count(*) FROM delta) AS changed,
       (SELECT count(*) FROM delta WHERE status = 'no_text') AS no_text,
       (SELECT count(*) FROM delta WHERE status = 'embed_failed') AS embed_failed,
       (SELECT count(*) FROM delta WHERE status = 'insert') AS inserted,
       (SELECT count(*) FROM delta WHERE status = 'update') AS updated,
       (SELECT count(*) FROM delta WHERE status IN ('insert', 'update')) AS indexed"""

SQL["lookup_paths"] = with_(FILES, OLD) + """
SELECT f.path, CAST(coalesce(a.n, 0) AS BIGINT) AS n_stored, coalesce(a.n, 0) > 0 AS "exists",
       a.fid AS stored_file_id, a.lm AS stored_last_modified
FROM files f LEFT JOIN (SELECT path, count(*) AS n, min(file_id) AS fid, max(last_modified) AS lm
                        FROM old GROUP BY path) a USING (path)"""

SQL["orphan_vectors"] = with_(FILES) + """
SELECT vec_id AS file_id, CAST(coalesce(len(embedding), 0) AS BIGINT) AS dim
FROM embeddings WHERE vec_id NOT IN (SELECT file_id FROM files WHERE file_id % 9 <> 4)"""

SQL["vanished_files"] = with_(FILES, OLD, SCAN) + \
    "SELECT file_id, path FROM old WHERE path NOT IN (SELECT path FROM scan)"

SQL["cascade_delete"] = with_(FILES, OLD, SCAN) + """,
gone AS (SELECT file_id FROM old WHERE path NOT IN (SELECT path FROM scan)),
vl AS (SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT file_id FROM old)
       AND vec_id NOT IN (SELECT file_id FROM gone))
SELECT o.file_id, o.path, o.file_id IN (SELECT vec_id FROM vl) AS has_vector
FROM old o WHERE o.file_id NOT IN (SELECT file_id FROM gone)"""

_META = """meta_{n} AS (
  SELECT 'model_name' AS key, 'all-MiniLM-L6-v2-ONNX' AS value
  UNION ALL SELECT 'max_seq_len', '256'
  UNION ALL SELECT 'schema_version', '1'
  UNION ALL SELECT 'embedding_dim', (SELECT CAST(len(embedding) AS VARCHAR) FROM {src} WHERE len(embedding) > 0
                                     GROUP BY len(embedding) ORDER BY count(*) DESC LIMIT 1)
  UNION ALL SELECT 'n_files', (SELECT CAST(count(*) AS VARCHAR) FROM {src})
  UNION ALL SELECT 'n_vectors', (SELECT CAST(count(embedding) AS VARCHAR) FROM {src})
)"""

SQL["metadata_upsert"] = with_(FILES, INDEX, _META.format(n="new", src="idx")) + """,
meta_old AS (SELECT 'model_name' AS key, 'all-MiniLM-L6-v2-ONNX' AS value
             UNION ALL SELECT 'embedding_dim', '384' UNION ALL SELECT 'max_seq_len', '256')
SELECT key, value FROM meta_old WHERE key NOT IN (SELECT key FROM meta_new)
UNION ALL SELECT key, value FROM meta_new"""

SQL["model_reindex"] = with_(FILES, OLD, """sidx AS (
  SELECT o.file_id, o.path, e.embedding FROM old o LEFT JOIN embeddings e ON o.file_id = e.vec_id)""",
                             _META.format(n="st", src="sidx")) + """,
run AS (SELECT 'model_name' AS key, 'all-MiniLM-L6-v2-ONNX' AS run_value
        UNION ALL SELECT 'embedding_dim', '384' UNION ALL SELECT 'max_seq_len', '256'),
d AS (SELECT count(*) FILTER (WHERE m.value <> r.run_value) AS n_diff FROM meta_st m JOIN run r USING (key)),
r AS (SELECT file_id, path,
             CASE WHEN (SELECT n_diff FROM d) > 0 THEN 'model_changed'
                  WHEN embedding IS NULL THEN 'missing_vector'
                  WHEN CAST(len(embedding) AS VARCHAR) <> '384' THEN 'bad_dim' END AS reason
      FROM sidx)
SELECT file_id, path, reason FROM r WHERE reason IS NOT NULL"""

SQL["model_reindex_partial"] = with_(FILES, OLD, DAMAGED, STORED_DIM) + """,
r AS (SELECT o.file_id, o.path, CASE WHEN e.embedding IS NULL THEN 'missing_vector'
                                     WHEN len(e.embedding) <> (SELECT d FROM d) THEN 'bad_dim' END AS reason
      FROM old o LEFT JOIN damaged e ON o.file_id = e.vec_id)
SELECT file_id, path, reason FROM r WHERE reason IS NOT NULL"""

SQL["quarantine"] = with_(FILES, OLD, SCAN, CHANGES, DELTA) + """
SELECT file_id, path, action, status,
       CASE status WHEN 'no_text' THEN 'no text was extracted: register an extractor for this extension or check the file'
                   ELSE 'the embedder returned no vector: re-run embedding for this file' END AS reason,
       CAST(1 AS INTEGER) AS attempts
FROM delta WHERE status IN ('no_text', 'embed_failed')"""

SQL["retry_quarantined"] = with_(FILES, OLD, SCAN, CHANGES, DELTA) + """,
again AS (SELECT q.file_id, q.path,
                 CASE WHEN q.status = 'no_text' THEN 'no_text'
                      WHEN e.embedding IS NULL OR len(e.embedding) = 0 THEN 'embed_failed' ELSE q.action END AS status
          FROM delta q LEFT JOIN embeddings e ON q.file_id = e.vec_id * 2 + 1
          WHERE q.status IN ('no_text', 'embed_failed'))
SELECT file_id, path, status, CAST(CASE WHEN status IN ('no_text', 'embed_failed') THEN 2 ELSE 1 END AS INTEGER) AS attempts
FROM again"""

SQL["stable_path_ids"] = with_(FILES, OLD) + """
SELECT f.path, o.file_id + 1000000 AS stored_id, o.path IS NOT NULL AS kept FROM files f LEFT JOIN old o USING (path)"""

SQL["hash_change"] = with_(FILES, SCAN) + """,
st AS (SELECT path, sha256(CASE WHEN file_id % 3 = 2 THEN text || ' ' ELSE text END) AS h
       FROM files WHERE file_id % 5 <> 0)
SELECT s.file_id, s.path,
       CASE WHEN st.path IS NULL THEN 'insert' WHEN st.h IS NULL OR st.h <> sha256(s.text) THEN 'update'
            ELSE 'skip' END AS action
FROM scan s LEFT JOIN st USING (path)"""

SQL["latest_per_key"] = """
SELECT user_id, event_id, floor(epoch_us(ts) / 1000000)::BIGINT AS mtime, value
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id ASC) AS rn FROM events)
WHERE rn = 1"""

SQL["mtime_seconds"] = "SELECT event_id, floor(epoch_us(ts) / 1000000)::BIGINT AS mtime FROM events"

SQL["list_recent"] = with_(FILES) + """
SELECT file_id, path, name, extension, last_modified FROM files
ORDER BY last_modified DESC NULLS LAST, path LIMIT 200"""

SQL["list_filter"] = with_(FILES) + """,
recent AS (SELECT file_id, path, name, extension, last_modified FROM files
           ORDER BY last_modified DESC NULLS LAST, path LIMIT 200)
SELECT * FROM recent WHERE contains(name || ' ' || path, '.txt /corpus/src1')"""

SQL["list_counts"] = with_(FILES) + """,
recent AS (SELECT name, path FROM files ORDER BY last_modified DESC NULLS LAST, path LIMIT 200)
SELECT 'loaded' AS list, count(*) AS n FROM recent
UNION ALL SELECT 'shown', count(*) FROM recent WHERE contains(name || ' ' || path, '.txt /corpus/src1')"""

SQL["index_stats"] = with_(FILES, INDEX) + """
SELECT extension, count(*) AS n_files, count(embedding) AS n_vectors,
       CAST(min(CASE WHEN len(embedding) > 0 THEN len(embedding) END) AS BIGINT) AS min_dim,
       CAST(max(coalesce(len(embedding), 0)) AS BIGINT) AS max_dim,
       round(min(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS min_norm,
       round(max(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS max_norm
FROM idx GROUP BY extension"""

SQL["file_tags"] = with_(FILES) + """,
tags AS (SELECT doc_id AS file_id, 'labeled' AS tag FROM labels
         UNION ALL SELECT doc_id, 'quality' FROM labels WHERE quality = 1
         UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1),
pf AS (SELECT file_id, array_to_string(list_sort(list_distinct(list(tag))), ',') AS tags FROM tags GROUP BY file_id)
SELECT f.file_id, f.path, coalesce(pf.tags, '') AS tags FROM files f LEFT JOIN pf USING (file_id)"""

SQL["file_features"] = with_(FILES) + """
SELECT file_id, CAST(strlen(text) AS BIGINT) AS size_bytes, trim(split_part(text, chr(10), 1)) AS title,
       sha256(text) AS content_hash
FROM files"""

_BM25 = f"""w AS (SELECT doc_id AS doc, unnest({words('text')}) AS tok FROM documents),
post AS (SELECT tok, doc, count(*) AS tf FROM w GROUP BY ALL),
dl AS (SELECT doc_id AS doc, len({words('text')}) AS dl FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
dfq AS (SELECT tok, count(*) AS df FROM post GROUP BY tok),
qw AS (SELECT DISTINCT query_id, tok FROM (SELECT item_id AS query_id, unnest({words('text')}) AS tok FROM benchmark)),
qi AS (SELECT qw.query_id, qw.tok, ln(1 + (st.n_docs - dfq.df + 0.5) / (dfq.df + 0.5)) AS idf, st.avgdl
       FROM qw JOIN dfq USING (tok) CROSS JOIN st),
bs AS (SELECT qi.query_id, p.doc AS doc_id,
              round(sum(qi.idf * p.tf * CAST(2.2 AS DOUBLE) /
                        (p.tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl.dl / qi.avgdl))), 6) AS score
       FROM qi JOIN post p USING (tok) JOIN dl ON p.doc = dl.doc GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bs)"""

SQL["bm25_topk"] = with_(_BM25) + "SELECT query_id, rank, doc_id, score FROM bm WHERE rank <= 5"

SQL["hybrid_topk"] = with_(_BM25, _sparse("documents", "doc_id", "dw"), _sparse("benchmark", "item_id", "qw2")) + """,
ss AS (SELECT q.id AS query_id, d.id AS doc_id, round(sum(q.weight * d.weight), 6) AS score
       FROM qw2 q JOIN dw d USING (bucket) GROUP BY q.id, d.id),
sem AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ss),
a AS (SELECT query_id, doc_id, rank AS ra FROM sem ),
b AS (SELECT query_id, doc_id, rank AS rb FROM bm),
f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id,
             round(coalesce(1e0 / (60 + ra), 0.0) + coalesce(1e0 / (60 + rb), 0.0), 6) AS score
      FROM a FULL OUTER JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f)
SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 5"""

_CHUNKS = """ch AS (
  SELECT doc_id, i AS chunk_no, i * 800 AS start, substring(text, CAST(i * 800 + 1 AS INTEGER), 1000) AS chunk
  FROM (SELECT doc_id, text, unnest(range(CAST(greatest(ceil((length(text) - 200) / 800.0), 1) AS BIGINT))) AS i
        FROM documents))"""

SQL["chunk_docs"] = with_(_CHUNKS) + """
SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(start AS BIGINT) AS start,
       CAST(length(chunk) AS BIGINT) AS n_chars, sha256(chunk) AS chunk_hash FROM ch"""

SQL["chunk_search"] = with_(_CHUNKS, """chunks AS (SELECT struct_pack(doc_id := doc_id, chunk_no := chunk_no) AS chunk_id, chunk AS text FROM ch)""",
                            _sparse("chunks", "chunk_id", "cw"), _sparse("benchmark", "item_id", "qw")) + """,
s AS (SELECT q.id AS query_id, c.id AS chunk_id, round(sum(q.weight * c.weight), 6) AS score
      FROM qw q JOIN cw c USING (bucket) GROUP BY q.id, c.id),
b AS (SELECT query_id, chunk_id.doc_id AS doc_id, CAST(chunk_id.chunk_no AS BIGINT) AS chunk_no, score,
             row_number() OVER (PARTITION BY query_id, chunk_id.doc_id ORDER BY score DESC, chunk_id.chunk_no) AS rn
      FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b WHERE rn = 1)
SELECT query_id, rank, doc_id, chunk_no, score FROM r WHERE rank <= 5"""

# LSH: planes from md5('band-bit-dim'), 64 bands x 8 bits over the vector width.
_LSH = """pl AS (
  SELECT b AS band, t AS bit, d AS dim,
         ('0x' || substr(md5(CAST(b AS VARCHAR) || '-' || CAST(t AS VARCHAR) || '-' || CAST(d AS VARCHAR)), 1, 8))::BIGINT
           / 2147483648.0 - 1.0 AS p
  FROM range(64) r1(b), range(8) r2(t),
       range((SELECT len(embedding) FROM embeddings GROUP BY 1 ORDER BY count(*) DESC LIMIT 1)) r3(d)),
ev AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM embeddings),
pr AS (SELECT ev.id, pl.band, pl.bit, sum(ev.x * pl.p) AS s FROM ev JOIN pl USING (dim) GROUP BY ALL),
bk AS (SELECT id, band, sum(CASE WHEN s > 0 THEN (1 << bit) ELSE 0 END) AS key FROM pr GROUP BY ALL)"""

SQL["lsh_candidates"] = with_(_LSH) + f""",
c AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM bk a JOIN bk b ON a.band = b.band AND a.key = b.key AND a.id < b.id),
s AS (SELECT c.id_a, c.id_b, {cos('ea.embedding', 'eb.embedding')} AS score
      FROM c JOIN embeddings ea ON ea.vec_id = c.id_a JOIN embeddings eb ON eb.vec_id = c.id_b)
SELECT id_a, id_b, score FROM s WHERE score >= 0.3"""

_ANN = _LSH + f""",
cand AS (SELECT DISTINCT q.id AS query_id, c.id AS file_id FROM bk q JOIN bk c ON q.band = c.band AND q.key = c.key
         WHERE c.id IN (SELECT doc_id FROM documents)),
sc AS (SELECT cand.query_id, cand.file_id, {cos('e.embedding', 'q.embedding')} AS score
       FROM cand JOIN embeddings e ON e.vec_id = cand.file_id JOIN embeddings q ON q.vec_id = cand.query_id),
ann AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_id) AS rank FROM sc)"""

SQL["ann_topk"] = with_(_ANN) + "SELECT query_id, rank, file_id, score FROM ann WHERE rank <= 5"

SQL["ann_recall"] = with_(_ANN) + f""",
ex0 AS (SELECT q.vec_id AS query_id, e.vec_id AS file_id, {cos('e.embedding', 'q.embedding')} AS score
        FROM embeddings e, embeddings q WHERE e.vec_id IN (SELECT doc_id FROM documents)),
ex AS (SELECT query_id, file_id FROM
       (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_id) AS rank FROM ex0)
       WHERE rank <= 5)
SELECT ex.query_id, round(sum(CASE WHEN a.file_id IS NULL THEN 0 ELSE 1 END) / CAST(count(*) AS DOUBLE), 6) AS recall
FROM ex LEFT JOIN (SELECT query_id, file_id FROM ann WHERE rank <= 5) a USING (query_id, file_id)
GROUP BY ex.query_id"""

SQL["exact_dups"] = """
WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS n_copies FROM h GROUP BY h HAVING count(*) > 1)
SELECT h.doc_id, g.keep_id, g.n_copies, h.h AS content_hash FROM h JOIN g USING (h) WHERE h.doc_id <> g.keep_id"""

SQL["scan_inventory"] = """
SELECT doc_id, source, lang, '.txt' AS extension, CAST(strlen(text) + 1 AS BIGINT) AS size_bytes FROM documents"""

SQL["extract_text"] = """
SELECT doc_id, 'ok' AS status, CAST(length(text) + 1 AS BIGINT) AS n_chars, sha256(text || chr(10)) AS content_hash
FROM documents"""

SQL["extract_dispatch"] = with_(FILES) + """
SELECT file_id, extension,
       CASE WHEN extension = '.txt' THEN (CASE WHEN length(text) = 0 THEN 'no_text' ELSE 'ok' END)
            WHEN extension IN ('.pdf', '.png', '.jpg', '.jpeg') THEN 'no_extractor'
            ELSE 'unsupported' END AS status,
       CASE WHEN extension = '.txt' THEN CAST(length(text) AS BIGINT) END AS n_chars
FROM files"""

MIXED_TREE = r"""tree AS (
  SELECT doc_id, 'd' || (doc_id % 20) || '/' AS top, doc_id % 6 AS c, CASE WHEN doc_id % 6 = 4 THEN '' ELSE coalesce(text, '') END AS body
  FROM documents),
placed AS (
  SELECT doc_id, body, CASE c WHEN 0 THEN top || 'doc_' || doc_id || '.txt' WHEN 1 THEN top || '.hidden/doc_' || doc_id || '.txt'
         WHEN 2 THEN top || '_parts/a/b/.doc_' || doc_id || '.txt' WHEN 3 THEN '_doc_' || doc_id || '.MD'
         WHEN 4 THEN top || 'empty/doc_' || doc_id ELSE top || 'we[ird]/sp ace_' || doc_id || '.pdf' END AS path FROM tree)"""

SQL["scan_tree"] = "WITH " + MIXED_TREE + r"""
SELECT doc_id, path, split_part(path, '/', -1) AS name, regexp_extract(split_part(path, '/', -1), '^.+(\.[^.]*)$', 1) AS extension,
       CAST(strlen(body) AS BIGINT) AS size_bytes
FROM placed"""

# a character is of the piece that its first byte lies in
SQL["text_pieces"] = "WITH " + MIXED_TREE + r""",
chars AS (SELECT doc_id, unnest(string_split(body, '')) AS ch, generate_subscripts(string_split(body, ''), 1) AS i
          FROM placed WHERE path LIKE '%.txt' AND body <> ''),
bytes AS (SELECT *, CAST(sum(strlen(ch)) OVER (PARTITION BY doc_id ORDER BY i) - strlen(ch) AS BIGINT) AS first_byte FROM chars),
pieces AS (SELECT doc_id, first_byte // 1000 AS piece, min(first_byte) AS "offset", string_agg(ch, '' ORDER BY i) AS text
           FROM bytes GROUP BY doc_id, first_byte // 1000
           UNION ALL SELECT doc_id, 0, 0, '' FROM placed WHERE path LIKE '%.txt' AND body = '')
SELECT doc_id, CAST(piece AS BIGINT) AS piece, CAST("offset" AS BIGINT) AS "offset",
       CASE WHEN text = '' THEN 'no_text' ELSE 'ok' END AS status, CAST(length(text) AS BIGINT) AS n_chars,
       sha256(text) AS content_hash
FROM pieces"""

SQL["extract_plugged"] = with_(FILES) + """
SELECT file_id, extension,
       CASE WHEN extension IN ('.txt', '.pdf') THEN (CASE WHEN length(text) = 0 THEN 'no_text' ELSE 'ok' END)
            WHEN extension = '.png' THEN 'no_text' WHEN extension IN ('.jpg', '.jpeg') THEN 'no_extractor'
            ELSE 'unsupported' END AS status,
       CASE extension WHEN '.txt' THEN sha256(text) WHEN '.png' THEN sha256('')
            WHEN '.pdf' THEN sha256(array_to_string(list_reverse(string_split(text, '')), '')) END AS content_hash
FROM files"""

SQL["path_parts"] = r"""
WITH n AS (SELECT page_id, split_part(regexp_replace(url, '[?#].*$', ''), '/', -1) AS name FROM pages)
SELECT page_id, name, regexp_extract(name, '^.+(\.[^.]*)$', 1) AS extension FROM n"""

SQL["path_normalize"] = r"""
WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS p FROM pages),
r AS (SELECT page_id, CASE page_id % 4 WHEN 1 THEN '//.' || p || '/./b/../c' WHEN 2 THEN '..' || p || '//../x'
                           WHEN 3 THEN '/../' || p || '/a/..//b/' ELSE p END AS p FROM u),
s AS (SELECT page_id, p, starts_with(p, '/') AS abs,
             list_filter(string_split(p, '/'), lambda x: x <> '' AND x <> '.') AS parts FROM r),
t AS (SELECT page_id, p, abs,
             list_reduce(parts, lambda acc, x:
                 CASE WHEN x <> '..' THEN list_append(acc, x)
                      WHEN len(acc) > 0 AND acc[-1] <> '..' THEN acc[1:len(acc) - 1]
                      WHEN abs THEN acc
                      ELSE list_append(acc, x) END, []::VARCHAR[]) AS st FROM s)
SELECT page_id, CASE WHEN abs THEN '/' || array_to_string(st, '/')
                     WHEN array_to_string(st, '/') = '' THEN '.' ELSE array_to_string(st, '/') END AS path
FROM t"""

SQL["stream_latest"] = SQL["latest_per_key"]

SQL["stream_counters"] = """
WITH a AS (SELECT user_id, ts, least(event_id * 4 // ((SELECT max(event_id) FROM events) + 1), 3) AS i FROM events),
b AS (SELECT i, user_id, count(*) AS n, max(ts) AS ts FROM a GROUP BY ALL),
s AS (SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b)
SELECT CAST(i AS BIGINT) AS batch_id, CAST(sum(n) AS BIGINT) AS arrived, count(*) AS keys,
       count(*) FILTER (WHERE before IS NULL) AS inserted, count(*) FILTER (WHERE ts > before) AS updated FROM s GROUP BY i"""

SQL["stream_index"] = """
SELECT doc_id, '.txt' AS extension, CAST(strlen(text) + 1 AS BIGINT) AS size_bytes, CAST(384 AS BIGINT) AS dim
FROM documents"""

SQL["blob_roundtrip"] = """
SELECT vec_id AS file_id, CAST(len(embedding) * 4 AS BIGINT) AS n_bytes,
       CASE WHEN len(embedding) = 0 THEN 'empty' ELSE 'ok' END AS blob_status, true AS same
FROM embeddings"""
