"""Small plan helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filelens.session import checkpoint_dir, scratch_path

# Largest side we are willing to broadcast after counting it: a row bound
# and a byte bound (rows x estimated row width).
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 256 * 1024 * 1024
# Width assumed for a variable-length value when the caller gives none.
_VAR_BYTES = {"string": 64, "binary": 64}
_ARRAY_BYTES = 1024


def row_bytes(schema) -> int:
    """Conservative width of one row: fixed-size types by their size,
    strings 64 bytes, arrays/maps/structs of unknown length 1 KiB."""
    total = 0
    for f in schema.fields:
        t = f.dataType.typeName()
        if t in ("byte", "boolean"):
            total += 1
        elif t in ("short",):
            total += 2
        elif t in ("integer", "float", "date"):
            total += 4
        elif t in ("long", "double", "timestamp", "timestamp_ntz", "decimal"):
            total += 8
        else:
            total += _VAR_BYTES.get(t, _ARRAY_BYTES)
    return total + 8


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the session's shared checkpoint folder:
    cuts lineage and pins non-deterministic ids (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Shuffle files of a write are of no use once its table is there. Spark's own
# setting removes them when the job ends, not when the driver's JVM happens to
# collect its garbage.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_recording: list[list[str]] = []


@contextmanager
def recorded_tables(paths: list[str]) -> Iterator[list[str]]:
    """Paths of the intermediate tables written inside go to ``paths``, for
    :func:`remove_tables` once nothing reads them any more."""
    _recording.append(paths)
    try:
        yield paths
    finally:
        _recording.pop()


def remove_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes recorded intermediate tables and empties the list."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    while paths:
        path = hadoop.Path(paths.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialized(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table under the shared checkpoint folder
    and read it back: an intermediate that several branches of a plan read
    is computed once (columnar, compressed, pruned on read), and the lineage
    is cut, so a lost executor re-reads the table instead of recomputing it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if _recording:
        _recording[-1].append(path)
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        # intermediates are mostly text and hashes: zstd keeps the shared folder small
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)
    return spark.read.parquet(path)


@contextmanager
def few_rows_at_once(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """For the time of jobs that hand whole texts to Python: fewer rows in an
    Arrow batch, which the JVM and the worker both hold (by default 10,000)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def maybe_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, rows: int | None = None,
                    width: int | None = None, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``df`` only when its counted rows are under ``max_rows`` and
    rows x ``width`` (bytes per row; estimated from the schema when not
    given) under ``max_bytes``; otherwise leave the join to a shuffle join
    (AQE splits skewed parts)."""
    n = df.count() if rows is None else rows
    w = row_bytes(df.schema) if width is None else width
    return F.broadcast(df) if n <= max_rows and n * w <= max_bytes else df


def global_rank(df: DataFrame, order_cols: list, name: str = "rank") -> DataFrame:
    """Dense 1-based position of every row under a total order, without
    moving all rows into one partition.

    A range-partitioned sort puts contiguous slices of the order in each
    partition; ``monotonically_increasing_id`` numbers rows inside each slice
    (partition id in the upper bits). Per-partition counts -- one row per
    partition -- give the offsets. The numbered sort is checkpointed so both
    uses see the same partitioning."""
    numbered = checkpointed(df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("_pid", F.shiftright("_mid", 33)) \
        .withColumn("_loc", F.col("_mid") - F.shiftleft(F.col("_pid"), 33))
    counts = numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0))).select("_pid", "_off")
    # one row per partition: bounded by the partition count
    out = numbered.join(F.broadcast(offsets), "_pid")
    return out.withColumn(name, (F.col("_off") + F.col("_loc") + 1).cast("bigint")) \
        .drop("_mid", "_pid", "_loc", "_off")


# Logical operators that keep their child's partitioning.
_NARROW = {"Project", "Filter", "Generate", "MapInArrow", "MapInPandas", "SubqueryAlias",
           "SerializeFromObject", "DeserializeToObject", "MapPartitions"}


def _first_exchange(df: DataFrame):
    """(name, partitions) of the first operator below the narrow top of the
    optimized plan that decides the partitioning (partitions None unless it
    is an explicit repartition)."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.getClass().getSimpleName() in _NARROW and node.children().size() == 1:
        node = node.children().apply(0)
    name = node.getClass().getSimpleName()
    if name in ("Repartition", "RepartitionByExpression"):
        try:
            return name, int(node.numPartitions())
        except Exception:  # noqa: BLE001 -- no explicit count
            return name, None
    return name, None


def _input_bytes(df: DataFrame) -> int:
    """Sum of the size estimates of the plan's leaf relations (what the job
    reads); unlike a join's own estimate this is not a product of sides."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Spread CPU-heavy per-row work (regex, hashing, matrix products) over
    all task slots when the input is small next to the cluster -- e.g. a file
    written as one row group, or a join output that AQE coalesces into a
    few partitions. At scale the input is many times the slots' worth of
    advisory partitions and this is a no-op (no extra shuffle).

    The decision reads the plan only: asking an adaptive plan's RDD for its
    partition count would run its shuffles on the spot."""
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().executedPlan().getClass().getSimpleName()
    if plan != "AdaptiveSparkPlanExec":  # no exchange: the scan's splits decide
        if df.rdd.getNumPartitions() >= slots:
            return df
    else:
        name, n = _first_exchange(df)
        if n is not None and n >= slots:
            return df  # already repartitioned over the slots
        advisory = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
        limit = slots * _bytes(advisory)
        if _input_bytes(df) >= limit:
            return df
    return df.repartition(slots, key) if key else df.repartition(slots)


def _bytes(v: str) -> int:
    v = v.strip().lower().rstrip("b")
    mult = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    return int(float(v[:-1]) * mult[v[-1]]) if v and v[-1] in mult else int(v)
