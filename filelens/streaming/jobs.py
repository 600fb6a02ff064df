"""Incremental jobs on Structured Streaming.

Both jobs use ``foreachBatch``: each micro-batch settles duplicates inside
the batch, reads the stored rows of the key parts that it touches, and commits
what is new or strictly newer as a delta of the state table: a trigger writes
the size of its batch, not of the state. The version number is derived from
the batch id, so a replayed batch (after a failure) finds its version already
committed and does nothing: the sink is idempotent. Every trigger keeps its
counters beside the state.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens.operators.common import (BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS, few_rows_at_once, global_rank, materialized, recorded_tables,
                                       remove_tables, row_bytes)
from filelens.operators.index import latest_per_key, path_ids
from filelens.session import scratch_path
from filelens.sources import listing, store

# Fixed schema of Spark's binaryFile source (a stream needs it up front), and
# of a listing without the bodies.
LISTED_SCHEMA = "path string, modificationTime timestamp, length bigint"
BINARY_FILE_SCHEMA = f"{LISTED_SCHEMA}, content binary"


def upsert_newer(state: DataFrame | None, batch: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """State after a batch: per key the stored row unless the batch has a
    strictly newer one (older or equal arrivals are dropped).

    Only keys that occur in the batch can change. When the batch's keys fit
    the broadcast bounds, the rest of the state passes through a map-side
    anti-join untouched and only the touched keys are merged, so a trigger
    shuffles the size of the batch, not of the state. Otherwise one
    aggregate over state and batch settles every key."""
    b = latest_per_key(batch, key, ts, tie)
    if state is None:
        return b
    s = state.select(*b.columns)
    keys = b.select(F.col(key).alias("_k"))
    n_keys = keys.count()
    if n_keys <= BROADCAST_MAX_ROWS and n_keys * row_bytes(keys.schema) <= BROADCAST_MAX_BYTES:
        kb = F.broadcast(keys)
        hit = s[key].eqNullSafe(kb["_k"])
        untouched = s.join(kb, hit, "left_anti")
        return untouched.unionByName(_merge_newer(s.join(kb, hit, "left_semi"), b, key, ts, tie))
    return _merge_newer(s, b, key, ts, tie)


def _merge_newer(s: DataFrame, b: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    st = s.withColumn("_from_state", F.lit(1))
    nb = b.withColumn("_from_state", F.lit(0))
    both = st.unionByName(nb)
    # strictly newer wins; on equal ts the stored row (from_state=1) stays
    order = F.struct(F.col(ts), F.col("_from_state"), (-F.col(tie)).alias("_neg"))
    cols = [c for c in b.columns if c != key]
    packed = F.struct(*[F.col(c) for c in cols])
    return (both.groupBy(key).agg(F.max_by(packed, order).alias("_r"))
                .select(key, *[F.col("_r")[c].alias(c) for c in cols]))


def newer_rows(state: DataFrame | None, batch: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The rows of a batch that change the state, one per key (duplicates in
    the batch are settled first): those of new keys and those strictly newer
    than the stored row, with ``_stored``, whether there was one."""
    b = latest_per_key(batch, key, ts, tie)
    if state is None:
        return b.withColumn("_stored", F.lit(False))
    s = state.select(F.col(key).alias("_key"), F.col(ts).alias("_at"), F.lit(True).alias("_stored"))
    newer = F.col("_stored").isNull() | (F.col(ts) > F.col("_at")) | (F.col("_at").isNull() & F.col(ts).isNotNull())
    return b.join(s, b[key].eqNullSafe(s["_key"]), "left").where(newer) \
        .select(*b.columns, F.coalesce("_stored", F.lit(False)).alias("_stored"))


def touched_parts(batch: DataFrame, key: str) -> list[int]:
    """The key parts of a batch: ``store.PARTS`` numbers at most."""
    return [r["p"] for r in batch.select(store.part_of(key).alias("p")).distinct().collect()]


def counters_root(state_root: str) -> str:
    """Where a stream keeps one row of counters per trigger."""
    return state_root.rstrip("/") + "-counters"


def commit_newer(batch: DataFrame, batch_id: int, root: str, key: str, ts: str, tie: str) -> None:
    """One trigger: the delta of the batch against the state under ``root``,
    and its counters (a replayed trigger writes them anew only with it)."""
    spark = batch.sparkSession
    state = store.read_current(spark, root, parts=touched_parts(batch, key))
    new = materialized(newer_rows(state, batch, key, ts, tie), "stream-delta")
    told = batch.agg(F.count(F.lit(1)).alias("arrived"), F.count_distinct(F.struct(key)).alias("keys"))
    made = new.agg(F.count_if(~F.col("_stored")).alias("inserted"), F.count_if("_stored").alias("updated"))
    if (batch_id + 1) not in store.versions(spark, root):
        row = spark.range(1).select(F.lit(batch_id).cast("bigint").alias("batch_id"),
                                    *[a.select(F.struct(*a.columns)).scalar().alias(n) for n, a in (("t", told), ("m", made))])
        row.select("batch_id", "t.*", "m.*").write.mode("overwrite").parquet(f"{counters_root(root)}/trigger={batch_id}")
    store.commit_delta(new.drop("_stored"), root, batch_id + 1, key)


def read_counters(spark: SparkSession, root: str) -> DataFrame:
    """(batch_id, arrived, keys, inserted, updated) of every trigger."""
    return spark.read.schema("batch_id bigint, arrived bigint, keys bigint, inserted bigint, updated bigint") \
        .option("recursiveFileLookup", "true").parquet(counters_root(root))


def stream_latest(spark: SparkSession, source_dir: str, glob: str, schema, key: str, ts: str, tie: str,
                  state_root: str | None = None, max_files_per_trigger: int | None = None) -> str:
    """Run the keep-latest upsert stream over Parquet files arriving in
    ``source_dir`` until all available input is processed; returns the
    state root (read it with :func:`filelens.sources.store.read_current`)."""
    state_root = state_root or scratch_path(spark, "state-latest")
    ckpt = scratch_path(spark, "stream-ckpt")
    r = spark.readStream.format("parquet").schema(schema).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    src = r.load(source_dir)

    def each(batch: DataFrame, batch_id: int):
        batch = batch.persist()  # read more than once; recomputed from the files if lost
        commit_newer(batch, batch_id, state_root, key, ts, tie)
        batch.unpersist()

    q = (src.writeStream.foreachBatch(each).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return state_root


@contextmanager
def _many_files(spark: SparkSession) -> Iterator[None]:
    """Settings for the time that a stream over files runs: small files are
    dealt to tasks by their bytes (by default each counts as 4 MB), and a
    batch's files are looked up by a few tasks per slot (by default up to
    10,000)."""
    slots = spark.sparkContext.defaultParallelism
    wanted = {"spark.sql.files.openCostInBytes": str(64 << 10),
              "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(8 * slots)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _arrivals(files: DataFrame, per_trigger: int | None) -> str:
    """The folder in which listed files are rows of a few Parquet files, for a
    stream to take. With ``per_trigger`` a Parquet file has the rows of one
    trigger, the oldest files in the first."""
    spark = files.sparkSession
    path = scratch_path(spark, "arrivals")
    if not per_trigger:
        files.write.parquet(path)
        return path
    slots = spark.sparkContext.defaultParallelism
    ranked = global_rank(files, ["modificationTime", "path"])
    ranked.select(*files.columns, F.floor((F.col("rank") - 1) / per_trigger).cast("bigint").alias("trigger")) \
        .repartition(4 * slots, "trigger").write.partitionBy("trigger").option("maxRecordsPerFile", 0).parquet(path)
    # a file stream takes its files in the order of their times (where a store
    # does not let them be set, the triggers come in any order)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    top = hadoop.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = {int(f.getPath().getName().split("=")[1]): f.getPath() for f in fs.listStatus(top) if f.isDirectory()}
    first = int(time.time() * 1000) - len(folders)
    for n, folder in folders.items():
        for part in fs.listStatus(folder):
            fs.setTimes(part.getPath(), first + n, -1)
    return path


def _with_ids(files: DataFrame, index: DataFrame | None) -> DataFrame:
    """``files`` with their ``file_id``: stored paths keep theirs, new paths get
    a collision-checked hash. Only ids that are not the plain hash of their path
    are joined, so that the texts stay where they are as a rule."""
    plain = F.xxhash64("path")
    other = materialized(path_ids(files, index).where(F.col("file_id") != plain).withColumnRenamed("file_id", "_id"), "index-ids")
    return files.join(other, "path", "left").withColumn("file_id", F.coalesce("_id", plain)).drop("_id")


def quarantine_root(index_root: str) -> str:
    """Where :func:`stream_index` keeps the files that it could not index."""
    return index_root.rstrip("/") + "-quarantine"


def stream_index(spark: SparkSession, root: str, embed_fn, index_root: str | None = None,
                 glob: str | None = None, max_files_per_trigger: int | None = None) -> str:
    """Index files as they arrive below ``root``: each micro-batch lists new
    files (path, mtime, bytes), extracts text, embeds it with ``embed_fn``
    (DataFrame (file_id, text) -> (file_id, embedding)) and upserts by path
    with the strictly-newer rule; files that cannot be indexed go to
    :func:`quarantine_root`. New paths only: a file changed in place is
    not re-emitted by the file source -- run the batch change job for that.

    Below a local root the stream's rows are the listing, made and written by
    tasks, and a trigger's bodies are read by path: a stream over the files
    themselves keeps every one of them in the driver."""
    from filelens.functions import paths as P
    from filelens.sources.files import MAX_CONTENT_BYTES, extract, with_path_parts

    index_root = index_root or scratch_path(spark, "index-stream")
    ckpt = scratch_path(spark, "stream-ckpt")
    roots = listing.local_roots(spark, root)
    r = spark.readStream.option("recursiveFileLookup", "true")
    if roots is not None:
        source = _arrivals(listing.listed(spark, roots, glob), max_files_per_trigger)
        r = r.format("parquet").schema(LISTED_SCHEMA)
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", 1)
    else:
        source = root
        r = r.format("binaryFile").schema(BINARY_FILE_SCHEMA)
        if glob:
            r = r.option("pathGlobFilter", glob)
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    # per-trigger counters, reported in StreamingQueryProgress.observedMetrics
    src = r.load(source).observe("index_counters", F.count(F.lit(1)).alias("files_seen"),
                               F.sum("length").alias("bytes_seen"))

    def each(batch: DataFrame, batch_id: int):
        with recorded_tables([]) as used:
            with recorded_tables([]) as texts:
                meta, vec = embedded(batch, batch_id)
            # written once: the merge reads the batch more than once
            rows = materialized(meta.join(vec, "file_id"), "index-batch")
            remove_tables(spark, texts)
            commit_newer(rows, batch_id, index_root, "path", "last_modified", "file_id")
        remove_tables(spark, used)

    def embedded(batch: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
        if roots is not None:
            # read once, as the counters count each time that it is
            arrived = materialized(batch, "index-files")
            batch = listing.with_bodies(arrived, MAX_CONTENT_BYTES, listing.total_bytes(arrived))
        b = with_path_parts(batch.select(P.strip_uri("path").alias("path"),
                                         F.unix_timestamp("modificationTime").cast("bigint").alias("last_modified"),
                                         F.col("length").cast("bigint").alias("size_bytes"), "content"))
        # the files are read once: a plan over the batch reads all bodies again
        # each time it runs, also where it needs paths only
        b = materialized(extract(b).drop("content"), "index-texts")
        cur = store.read_current(batch.sparkSession, index_root)
        found = _with_ids(b, cur)
        good = F.col("status").isin("ok", "repaired")
        # rows that cannot be indexed are kept with their reason, one folder per
        # trigger (a replayed trigger writes it anew)
        found.where(~good).select("file_id", "path", "extension", "last_modified", "size_bytes", "status") \
            .write.mode("overwrite").parquet(f"{quarantine_root(index_root)}/batch={batch_id}")
        ex = found.where(good)
        return ex.select("file_id", "path", "name", "extension", "last_modified", "size_bytes"), embed_fn(ex.select("file_id", "text"))

    with _many_files(spark), few_rows_at_once(spark):
        q = (src.writeStream.foreachBatch(each).option("checkpointLocation", ckpt)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return index_root
