"""What Spark's file source sees below a folder, as rows that tasks list and read.

Spark's file source holds the status of every file in the driver, for a batch
as for a stream, so that the driver's memory bounds the number of files. Here
folders are rows: a round lists the names in the folders of the round before
in tasks, the status of the names is taken by all tasks, and bodies are read
by path. The driver holds a count of rounds, whatever the number of files.

The rules are the file source's: names starting with ``.`` or ``_`` (files and
folders; a ``=`` makes ``_`` a partition's), ``*._COPYING_`` and zero-length
files are left out, links are followed, a missing root is an error. Folders on
the local file system are listed so (all executors mount them); of others, and
of the output of a stream's file sink, Spark's own source has the listing. A
name that is not UTF-8 is left out, as the JVM cannot open it; checksum files
that Hadoop may have put beside a file are not compared.
"""

from __future__ import annotations

import errno
import os
import stat
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens.functions import paths as P
from filelens.operators.common import materialized

# Bytes of bodies that a task reads, in as many files as that takes, and of
# those that it hands over at once.
SCAN_BYTES = 64 << 20
_BATCH_BYTES = 4 << 20
_BATCH_ROWS = 1000
_NAMES = pa.schema([("path", pa.string()), ("folder", pa.bool_())])
_STATUS = pa.schema([("path", pa.string()), ("ms", pa.int64()), ("length", pa.int64())])
_BODIES = _STATUS.append(pa.field("content", pa.binary()))
# What a path gives that leads nowhere: links that are broken or go in circles.
_NOWHERE = (errno.ENOENT, errno.ENOTDIR, errno.ELOOP, errno.ENAMETOOLONG)


def local_roots(spark: SparkSession, root: str) -> list[str] | None:
    """The local folders (or files) that ``root``, maybe a glob, stands for;
    None when Spark's own source has to list it, or to say that it is missing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(root)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.getUri().getScheme() != "file":
        return None
    path = fs.makeQualified(path)
    if any(c in root for c in "{}[]*?\\"):
        roots = [s.getPath().toUri().getPath() for s in fs.globStatus(path) or []]
    elif fs.exists(hadoop.Path(path, "_spark_metadata")):
        return None
    else:
        roots = [path.toUri().getPath()] if fs.exists(path) else []
    return roots or None


def _hidden(name: str, folder: bool) -> bool:
    listed = name.startswith(("_metadata", "_common_metadata"))
    marked = name.startswith(".") or name.startswith("_") and "=" not in name
    return marked and not (folder and listed) or name.endswith("._COPYING_") and not listed


def _utf8(name: str) -> bool:
    try:
        name.encode()
    except UnicodeEncodeError:
        return False
    return True


def _entries(path: str, root: bool) -> Iterator[tuple[str, bool]]:
    """(path, folder) of what is directly in a folder; of a file, itself. A
    folder that went since it was found is empty, but a root has to be there."""
    try:
        names = os.scandir(path)
    except NotADirectoryError:
        if not _hidden(path.rsplit("/", 1)[-1], False):
            yield path, False
        return
    except FileNotFoundError:
        if root:
            raise
        return
    with names:
        for e in names:
            try:
                folder = e.is_dir()
            except OSError as x:
                if x.errno not in _NOWHERE:
                    raise
                continue
            if not _hidden(e.name, folder) and _utf8(e.name):
                yield f"{path.rstrip('/')}/{e.name}", folder


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, size_of=None) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    for r in rows:
        held.append(r)
        size += size_of(r) if size_of else 0
        if len(held) == _BATCH_ROWS or size >= _BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _paths(batches) -> Iterator[str]:
    for b in batches:
        yield from b.column(0).to_pylist()


def _list_roots(batches):
    return _in_batches((e for path in _paths(batches) for e in _entries(path, True)), _NAMES)


def _list(batches):
    return _in_batches((e for path in _paths(batches) for e in _entries(path, False)), _NAMES)


def _status(batches):
    def rows():
        for path in _paths(batches):
            try:
                s = os.stat(path)
            except OSError as x:
                if x.errno not in _NOWHERE:
                    raise
                continue
            if s.st_size and not stat.S_ISDIR(s.st_mode):
                yield path, s.st_mtime_ns // 1_000_000, s.st_size

    return _in_batches(rows(), _STATUS)


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.string(): "string", pa.bool_(): "boolean", pa.int64(): "bigint", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _file_columns() -> list[Column]:
    return [F.col("path"), F.timestamp_millis("ms").alias("modificationTime"), F.col("length")]


def _matches(spark: SparkSession, glob: str) -> Column:
    """Whether the name of ``path`` matches ``glob``, by Hadoop's own rules."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
    return P.file_name("path").rlike(rf"(?s)\A(?:{pattern})\z")


def listed(spark: SparkSession, roots: list[str], glob: str | None = None) -> DataFrame:
    """(path, modificationTime, length) of the files below ``roots``, written
    once; columns are named as in Spark's binary source, paths have no scheme."""
    tasks = 4 * spark.sparkContext.defaultParallelism
    frontier = spark.createDataFrame([(r,) for r in dict.fromkeys(roots)], "path string")
    files: list[DataFrame] = []
    while True:
        found = frontier.repartition(tasks).mapInArrow(_list if files else _list_roots, _ddl(_NAMES))
        level = materialized(found, "listed-names")
        files.append(level.where(~F.col("folder")).select("path"))
        frontier = level.where("folder").select("path")
        if frontier.isEmpty():
            break
    found = reduce(DataFrame.unionByName, files)
    if glob:
        found = found.where(_matches(spark, glob))
    if len(roots) > 1:  # a glob may name a folder and one below it
        found = found.distinct()
    # a folder's names come from one task, their status from all
    return materialized(found.repartition(tasks).mapInArrow(_status, _ddl(_STATUS)).select(*_file_columns()), "listed-files")


def with_bodies(files: DataFrame, max_bytes: int, total: int) -> DataFrame:
    """(path, modificationTime, length, content) of :func:`listed` files, all as
    they are when read; ``total`` bytes, or about so many, decide the tasks.
    A body that grew over ``max_bytes`` is null. A file that went is an error,
    unless ``spark.sql.files.ignoreMissingFiles`` is set (or ``ignoreCorruptFiles``,
    for any that cannot be read)."""
    spark = files.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-total // SCAN_BYTES))

    def on(name: str) -> bool:
        return spark.conf.get(f"spark.sql.files.{name}", "false").lower() == "true"

    ignored = OSError if on("ignoreCorruptFiles") else FileNotFoundError if on("ignoreMissingFiles") else ()

    def read(batches):
        def rows():
            for path in _paths(batches):
                try:
                    with open(path, "rb") as f:
                        s = os.fstat(f.fileno())
                        body = f.read() if s.st_size <= max_bytes else None
                except ignored:
                    continue
                yield path, s.st_mtime_ns // 1_000_000, s.st_size, body

        return _in_batches(rows(), _BODIES, lambda r: len(r[3] or b""))

    return files.select("path").repartition(tasks).mapInArrow(read, _ddl(_BODIES)).select(*_file_columns(), "content")


def total_bytes(files: DataFrame) -> int:
    return files.agg(F.sum("length")).first()[0] or 0
