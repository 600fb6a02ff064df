"""Versioned Parquet table with deltas.

A commit writes a folder of its own beside the others: ``v=<n>`` holds all
rows, ``v=<n>-by=<key>`` only the rows that the version changes, one per key,
and marks of the deleted ones. A folder is visible once Spark's ``_SUCCESS``
marker exists, so a reader never sees a half-written version and a writer
never overwrites what is being read.

The state is the last whole version with the later deltas over it, the newest
row of a key winning. Rows carry a part of their key's hash and are stored by
it, so a merge reads the parts that its batch touches, and a commit writes the
batch, not the state. After ``MAX_DELTAS`` deltas they are compacted
(``v=<n>-base``), and versions before the last but ``keep`` whole ones go.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 256       # hash parts of the keys
MAX_DELTAS = 8
_NAME = re.compile(r"v=(\d+)(?:-(base)|-by=(.+))?")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), p, jvm


def _entries(spark: SparkSession, root: str) -> list[tuple[int, bool, str | None, str]]:
    """(version, whole, key, folder) of the committed folders in order; a
    compacted version comes after its delta."""
    fs, p, jvm = _fs(spark, root)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        m = _NAME.fullmatch(name)
        if m and st.isDirectory() and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append((int(m[1]), m[3] is None, m[3], name))
    return sorted(out, key=lambda e: (e[0], e[1]))


def versions(spark: SparkSession, root: str) -> list[int]:
    return sorted({n for n, *_ in _entries(spark, root)})


def current_version(spark: SparkSession, root: str) -> int | None:
    v = versions(spark, root)
    return v[-1] if v else None


def part_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def read_current(spark: SparkSession, root: str, schema=None, *, parts: list[int] | None = None,
                 with_version: bool = False) -> DataFrame | None:
    """The table as last committed (``parts``: only the rows of these hash
    parts of the key); ``with_version`` adds the version that wrote a row."""
    entries = _entries(spark, root)
    if not entries:
        return None if schema is None else spark.createDataFrame([], schema)
    at = max((i for i, e in enumerate(entries) if e[1]), default=0)
    live = entries[at:]
    key = next((e[2] for e in reversed(live) if e[2]), None)
    frames = []
    for n, _, _, name in live:
        f = spark.read.parquet(f"{root.rstrip('/')}/{name}")
        if parts is not None and key is not None:
            f = f.where((F.col("_part") if "_part" in f.columns else part_of(key)).isin(parts))
        f = f if "_deleted" in f.columns else f.withColumn("_deleted", F.lit(False))
        f = f if "_version" in f.columns else f.withColumn("_version", F.lit(n).cast("bigint"))
        frames.append(f.drop("_part"))
    out = frames[0]
    if len(frames) > 1:
        for f in frames[1:]:
            out = out.unionByName(f)
        rest = [c for c in out.columns if c != key]
        # partial on the map side; one row per key and version
        out = out.groupBy(key).agg(F.max_by(F.struct(*rest), F.col("_version")).alias("_r")) \
            .select(key, *[F.col("_r")[c].alias(c) for c in rest])
        out = out.select(*frames[0].columns)
    out = out.where(~F.col("_deleted")).drop("_deleted")
    return out.withColumnRenamed("_version", "version") if with_version else out.drop("_version")


def ensure_table(spark: SparkSession, root: str, schema) -> bool:
    """Create the table when absent: an empty version 0 with the declared
    schema, so readers always find a typed table. A no-op once any version
    is committed (idempotent). Returns True when created."""
    if current_version(spark, root) is not None:
        return False
    return commit(spark.createDataFrame([], schema), root, 0)


def commit(df: DataFrame, root: str, version: int, keep: int = 3) -> bool:
    """Write ``df`` as the whole of ``version``; a no-op when it is already
    committed (replayed micro-batch). Returns True when written."""
    spark = df.sparkSession
    if version in versions(spark, root):
        return False
    df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/v={version}")
    prune(spark, root, keep)
    return True


def commit_delta(changes: DataFrame, root: str, version: int, key: str, *, deleted: DataFrame | None = None,
                 keep: int = 3) -> bool:
    """Write what ``version`` changes: rows of ``changes``, one per ``key``,
    replace or follow those stored; keys of ``deleted`` go. What is written
    grows with the changes, not with the table. A no-op when the version is
    already committed. Returns True when written."""
    spark = changes.sparkSession
    if version in versions(spark, root):
        return False
    rows = changes.withColumn("_deleted", F.lit(False))
    if deleted is not None:
        gone = deleted.select(key).distinct().withColumn("_deleted", F.lit(True))
        rows = rows.unionByName(gone, allowMissingColumns=True)
    _write(rows, f"{root.rstrip('/')}/v={version}-by={key}", key)
    if sum(not whole for _, whole, *_ in _entries(spark, root)[-MAX_DELTAS:]) >= MAX_DELTAS:
        compact(spark, root, keep)
    return True


def _write(rows: DataFrame, path: str, key: str) -> None:
    # by size, so neither many small files nor a part in one task
    rows.withColumn("_part", part_of(key)).hint("rebalance", F.col("_part")) \
        .sortWithinPartitions("_part").write.mode("overwrite").parquet(path)


def compact(spark: SparkSession, root: str, keep: int = 3) -> bool:
    """Write the state with its deltas merged beside the last delta; readers
    take it from then on. Returns False where there is no delta."""
    entries = _entries(spark, root)
    if not entries or entries[-1][1]:
        return False
    n, _, key, _ = entries[-1]
    merged = read_current(spark, root, with_version=True).withColumnRenamed("version", "_version")
    _write(merged.withColumn("_deleted", F.lit(False)), f"{root.rstrip('/')}/v={n}-base", key)
    prune(spark, root, keep)
    return True


def prune(spark: SparkSession, root: str, keep: int) -> None:
    """Removes what is before the last ``keep`` whole versions."""
    entries = _entries(spark, root)
    whole = [i for i, e in enumerate(entries) if e[1]]
    fs, p, jvm = _fs(spark, root)
    for *_, name in entries[:whole[-keep]] if 0 < keep < len(whole) else []:
        fs.delete(jvm.org.apache.hadoop.fs.Path(p, name), True)
