"""Index maintenance: change detection, upsert, lookups, integrity, deletes.

The store is keyed by ``path`` (Spark enforces no UNIQUE constraint, so the
jobs do: one row per path after every upsert). The change test runs *before*
extraction and embedding, so unchanged files cost one join and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filelens.functions import vectors as V
from filelens.operators.common import checkpointed, materialized
from filelens.schema import ALLOWED_EXTENSIONS, METADATA_DEFAULTS, SCHEMA_VERSION


def ext_allowlist(files: DataFrame, allowed=ALLOWED_EXTENSIONS) -> DataFrame:
    """Exact, case-sensitive extension filter (pushed into the scan)."""
    return files.where(F.col("extension").isin(list(allowed)))


def latest_per_key(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """One row per key: the greatest ``ts``; among equal ``ts`` the smallest
    ``tie`` (first arrival wins, later equal arrivals are not newer).

    Written as a ``max_by`` aggregate rather than a window: the aggregate is
    partial on the map side, so a key holding a third of all rows is reduced
    in every map task before the shuffle instead of sorted in one task."""
    cols = [c for c in df.columns if c != key]
    order = F.struct(F.col(ts), (-F.col(tie)).alias("_neg_tie"))
    packed = F.struct(*[F.col(c) for c in cols])
    return (df.groupBy(key).agg(F.max_by(packed, order).alias("_r"))
              .select(key, *[F.col("_r")[c].alias(c) for c in cols]))


def change_detect(scan: DataFrame, stored: DataFrame) -> DataFrame:
    """Status of every scanned file against the stored index.

    insert: path not stored; update: current mtime > stored (NULL stored
    reads as 0); skip: equal or older. A path scanned twice is settled first
    (latest mtime wins). The stored side contributes only (path, mtime, id)."""
    # only narrow columns are settled and joined; bodies are fetched later, for
    # changed files
    scan = latest_per_key(scan.drop("text", "content", "embedding"), "path", "last_modified", "file_id")
    st = stored.select("path", F.col("last_modified").alias("stored_last_modified"),
                       F.col("file_id").alias("stored_file_id"), F.lit(True).alias("_present"))
    j = scan.join(st, "path", "left")
    action = (F.when(F.col("_present").isNull(), "insert")
              .when(F.col("last_modified") > F.coalesce(F.col("stored_last_modified"), F.lit(0)), "update")
              .otherwise("skip"))
    # J6: an update keeps the stored id; an insert takes the scanned one
    fid = F.coalesce(F.col("stored_file_id"), F.col("file_id"))
    return j.select(fid.alias("file_id"), *[c for c in scan.columns if c not in ("file_id",)],
                    "stored_last_modified", action.alias("action"))


def embed_delta(changes: DataFrame, vecs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Changed files with their new vector; status says why a file is not
    indexed (no_text / embed_failed) -- failures go to quarantine, not the
    index. ``texts`` (path, has_text) says which files have text; without it
    a ``text`` column of ``changes`` does. ``vecs`` is any (file_id, embedding) relation: precomputed
    vectors, or the output of an embedder over the extracted text."""
    d = changes.where(F.col("action").isin("insert", "update"))
    d = d.join(vecs.select("file_id", "embedding"), "file_id", "left")
    if texts is not None:
        d = d.join(texts.select("path", "has_text"), "path", "left")
        has_text = F.coalesce(F.col("has_text"), F.lit(False))
    else:
        has_text = F.col("text").isNotNull() & (F.length("text") > 0) if "text" in d.columns else F.lit(True)
    status = (F.when(~has_text, "no_text")
              .when(F.col("embedding").isNull() | (F.size("embedding") == 0), "embed_failed")
              .otherwise(F.col("action")))
    return d.withColumn("status", status)


# Actionable messages for rows a run could not index (fixed wording).
QUARANTINE_REASONS = {
    "no_text": "no text was extracted: register an extractor for this extension or check the file",
    "embed_failed": "the embedder returned no vector: re-run embedding for this file",
}


def quarantine(delta: DataFrame) -> DataFrame:
    """Rows of a run that were not indexed, with the reason and the number
    of attempts so far: (file_id, path, extension, last_modified, action,
    status, reason, attempts). They stay out of the index; a retry job reads
    them (:func:`retry_quarantined`)."""
    ok = F.col("status").isin("insert", "update", "skip")
    reason = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in QUARANTINE_REASONS.items() for x in kv]),
                                     F.col("status")),
                        F.concat(F.lit("not indexed: "), F.col("status")))
    return delta.where(~ok).select("file_id", "path", "extension", "last_modified", "action", "status",
                                   reason.alias("reason"), F.lit(1).alias("attempts"))


def retry_quarantined(quarantined: DataFrame, changes: DataFrame, vecs: DataFrame,
                      texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Retry once: rows quarantined on their first attempt go through the
    embed step again (``vecs`` and ``texts`` as in :func:`embed_delta`). Returns (recovered
    delta rows, ready for :func:`index_upsert`; rows still failing, now with
    attempts = 2, which are not retried again)."""
    first = quarantined.where(F.col("attempts") == 1).select("file_id")
    again = embed_delta(changes.join(first, "file_id", "left_semi"), vecs, texts)
    recovered = again.where(F.col("status").isin("insert", "update"))
    still = quarantine(again).withColumn("attempts", F.lit(2))
    return recovered, still


def _path_hash(c, salt: int):
    return F.xxhash64(c) if salt == 0 else F.xxhash64(c, F.lit(salt))


def path_ids(new: DataFrame, existing: DataFrame | None, key: str = "path", id_col: str = "file_id",
             hash_fn=_path_hash, max_rounds: int = 16) -> DataFrame:
    """(key, id) for the distinct keys of ``new``: a key already in
    ``existing`` keeps its stored id (stable on update); a new key gets
    ``hash_fn(key, 0)`` (xxhash64 of the path), and when that id is held by
    another key -- a stored one, or another new key (the smallest key keeps
    it) -- it is rehashed with salt 1, 2, ... until no id is shared. A
    collision is rare (64-bit ids), so this is one check per batch."""
    n = new.select(key).distinct()
    if existing is not None:
        ex = existing.select(key, id_col)
        kept = n.join(ex, key, "inner")
        fresh = n.join(ex.select(key), key, "left_anti")
    else:
        ex, kept, fresh = None, None, n
    fresh = fresh.withColumn(id_col, hash_fn(F.col(key), 0))
    for salt in range(1, max_rounds + 1):
        w = Window.partitionBy(id_col).orderBy(key)
        clash = fresh.withColumn("_r", F.row_number().over(w)).where(F.col("_r") > 1).select(key)
        if ex is not None:
            held = ex.select(F.col(id_col), F.col(key).alias("_other"))
            clash = clash.unionByName(fresh.join(held, id_col).where(F.col("_other") != F.col(key)).select(key))
        if clash.isEmpty():
            break
        fresh = (fresh.join(clash.withColumn("_c", F.lit(True)), key, "left")
                 .withColumn(id_col, F.when(F.col("_c"), hash_fn(F.col(key), salt)).otherwise(F.col(id_col)))
                 .drop("_c"))
        fresh = checkpointed(fresh)  # cut the lineage of a rehash round (rare)
    else:
        raise RuntimeError("path ids still collide after %d rehashes" % max_rounds)
    return fresh if kept is None else kept.select(key, id_col).unionByName(fresh)


def index_upsert(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """Insert-or-replace by path: stored rows not in the delta, plus the
    delta rows (the delta carries the stored id for updates)."""
    cols = ["file_id", "path", "name", "extension", "last_modified", "embedding"]
    # both branches read the delta: it is evaluated once
    ok = materialized(delta.where(F.col("status").isin("insert", "update")).select(*cols, "status"), "index-delta")
    new_rows = ok.select(*cols, F.col("status").alias("origin"))
    kept = stored.join(ok.select("path"), "path", "left_anti") \
        .select(*cols, F.lit("stored").alias("origin"))
    return kept.unionByName(new_rows)


_STORED = ["file_id", "path", "name", "extension", "last_modified", "embedding"]


def store_rows(rows: DataFrame) -> DataFrame:
    """The columns of the stored index."""
    return rows.select(*_STORED)


def index_run(scan: DataFrame, vecs: DataFrame, texts: DataFrame, root: str, version: int) -> bool:
    """One run that ends in the index stored under ``root``: files that are
    new or strictly newer than their stored row are embedded and written as a
    delta by path. A second run over the same files writes no rows. Returns
    False when ``version`` is already committed."""
    from filelens.sources import store
    spark = scan.sparkSession
    stored = store.read_current(spark, root)
    delta = embed_delta(change_detect(scan, stored), vecs, texts)
    return store.commit_delta(store_rows(delta.where(F.col("status").isin("insert", "update"))), root, version, "path")


def run_counters(all_files: DataFrame, delta: DataFrame, changes: DataFrame) -> DataFrame:
    """One-row report: discovered (before the allow-list), changed, no_text,
    embed_failed, inserted, updated, skipped, indexed = inserted + updated."""
    disc = all_files.agg(F.count(F.lit(1)).alias("discovered"))
    ch = changes.agg(F.count(F.lit(1)).alias("eligible"),
                     F.count_if(F.col("action") == "skip").alias("skipped"))
    de = delta.agg(F.count(F.lit(1)).alias("changed"),
                   F.count_if(F.col("status") == "no_text").alias("no_text"),
                   F.count_if(F.col("status") == "embed_failed").alias("embed_failed"),
                   F.count_if(F.col("status") == "insert").alias("inserted"),
                   F.count_if(F.col("status") == "update").alias("updated"))
    # three one-row aggregates side by side, each a scalar subquery (a
    # struct of its counts), evaluated once: no join of any kind
    aggs = [disc, ch, de]
    row = all_files.sparkSession.range(1).select(
        *[a.select(F.struct(*a.columns)).scalar().alias(f"_a{i}") for i, a in enumerate(aggs)])
    out = row.select(*[F.col(f"_a{i}.{c}").alias(c) for i, a in enumerate(aggs) for c in a.columns])
    return out.withColumn("indexed", F.col("inserted") + F.col("updated"))


def lookup_paths(paths: DataFrame, stored: DataFrame) -> DataFrame:
    """Bulk point lookup: for each asked path, whether it is stored, how many
    rows carry it (COUNT per key) and its id and mtime."""
    agg = stored.groupBy("path").agg(F.count(F.lit(1)).alias("n_stored"),
                                     F.min("file_id").alias("stored_file_id"),
                                     F.max("last_modified").alias("stored_last_modified"))
    j = paths.select("path").join(agg, "path", "left")
    return j.select("path", F.coalesce("n_stored", F.lit(0)).cast("bigint").alias("n_stored"),
                    (F.coalesce("n_stored", F.lit(0)) > 0).alias("exists"),
                    "stored_file_id", "stored_last_modified")


def orphan_vectors(vecs: DataFrame, files: DataFrame) -> DataFrame:
    """Vectors whose file row is gone (the foreign key check)."""
    return vecs.join(files.select("file_id"), "file_id", "left_anti")


def cascade_delete(files: DataFrame, vecs: DataFrame, deleted: DataFrame):
    """Delete files by id and cascade to their vectors: two anti-joins."""
    ids = deleted.select("file_id").distinct()
    return files.join(ids, "file_id", "left_anti"), vecs.join(ids, "file_id", "left_anti")


def vanished_files(stored: DataFrame, scan: DataFrame) -> DataFrame:
    """Stored paths the current scan no longer sees."""
    return stored.join(scan.select("path"), "path", "left_anti")


def metadata_rows(index_vectors: DataFrame) -> DataFrame:
    """Metadata derived from the index: fixed model rows plus the observed
    vector dimension, file and vector counts and the schema version."""
    spark = index_vectors.sparkSession
    stats = index_vectors.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count("embedding").alias("n_vectors"),
        F.mode(F.when(F.size("embedding") > 0, F.size("embedding"))).alias("dim"))
    fixed = spark.createDataFrame([(k, v) for k, v in METADATA_DEFAULTS if k != "embedding_dim"] +
                                  [("schema_version", SCHEMA_VERSION)], "key string, value string")
    obs = stats.select(F.explode(F.array(
        F.struct(F.lit("embedding_dim").alias("key"), F.col("dim").cast("string").alias("value")),
        F.struct(F.lit("n_files").alias("key"), F.col("n_files").cast("string").alias("value")),
        F.struct(F.lit("n_vectors").alias("key"), F.col("n_vectors").cast("string").alias("value")),
    )).alias("kv")).select("kv.key", "kv.value")
    return fixed.unionByName(obs)


def metadata_upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Replace by key: stored keys not in ``new`` survive; both tables are a
    handful of rows, so the anti-join is broadcast."""
    return stored.join(F.broadcast(new.select("key")), "key", "left_anti").unionByName(new)


def model_reindex(index_vectors: DataFrame, stored_meta: DataFrame, run_meta: dict) -> DataFrame:
    """Files to re-embed: all of them when the stored model settings differ
    from the run's (vectors must share one space), else those whose vector
    is missing or of the wrong dimension."""
    spark = index_vectors.sparkSession
    run = spark.createDataFrame(list(run_meta.items()), "key string, run_value string")
    # one number for the whole run: a scalar subquery, evaluated once
    n_diff = (stored_meta.join(F.broadcast(run), "key", "inner")
              .agg(F.count_if(F.col("value") != F.col("run_value"))).scalar())
    dim = str(run_meta.get("embedding_dim", ""))
    j = index_vectors
    reason = (F.when(n_diff > 0, "model_changed")
              .when(F.col("embedding").isNull(), "missing_vector")
              .when(V.vector_dim("embedding").cast("string") != F.lit(dim), "bad_dim"))
    return j.select("file_id", "path", reason.alias("reason")).where(F.col("reason").isNotNull())


def hash_change(scan: DataFrame, stored: DataFrame) -> DataFrame:
    """Change test by content hash: insert when the path is not stored,
    update when the hash differs (or the stored one is NULL), else skip."""
    st = stored.select("path", F.col("content_hash").alias("stored_hash"), F.lit(True).alias("_present"))
    j = scan.join(st, "path", "left")
    action = (F.when(F.col("_present").isNull(), "insert")
              .when(F.col("stored_hash").isNull() | (F.col("stored_hash") != F.col("content_hash")), "update")
              .otherwise("skip"))
    return j.select("file_id", "path", action.alias("action"))
