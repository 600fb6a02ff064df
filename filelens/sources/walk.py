"""Exact directory walk and split reading of large bodies.

Spark's file source hides names that start with ``.`` or ``_`` and empty
files, follows links to folders, and holds a body in one row. Here folders
are rows: each round lists the frontier's folders in tasks and writes what it
finds; the folders among it are the next frontier, so the number of rounds is
the depth of the tree. A body is read as byte ranges, in tasks again.

Paths are local ones (``/a/b`` or ``file:`` URIs, for a folder that all
executors mount) or URIs that ``pyarrow.fs`` opens (hdfs, s3, gs, abfs). The
root is taken as given; paths below it start with it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens.functions import paths as P
from filelens.functions import text as X
from filelens.operators.common import materialized
from filelens.sources.files import with_path_parts

# Bytes of a piece of a body, of the rows that a task hands over at once, and
# of the pieces that a task reads in all.
PIECE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
TASK_BYTES = 256 << 20
_BATCH_ROWS = 1000
_WRITE_ROWS = 100
_ENTRY = "path string, folder boolean, size_bytes bigint, last_modified bigint"


def _local(path: str) -> str | None:
    m = re.match(r"^(?:file:(?://)?)?(/.*)$", path)
    return m and m.group(1)


def _store(uri: str):
    """(file system, path inside, prefix of the URI) of another store."""
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(uri)
    return system, inside, uri[:uri.rindex(inside.rstrip("/"))]


def _printable(name: str) -> str:
    return name.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def _entries(folder: str) -> Iterator[tuple]:
    """The files and folders directly in ``folder``. A link to a file is a
    file; links to folders, broken links and devices are neither. A folder
    that went since it was found is empty; one that may not be read fails."""
    base = _local(folder)
    if base is None:
        from pyarrow import fs

        system, inside, prefix = _store(folder)
        for e in system.get_file_info(fs.FileSelector(inside, allow_not_found=True)):
            if e.type in (fs.FileType.File, fs.FileType.Directory):
                yield (prefix + e.path, e.type == fs.FileType.Directory, e.size or 0,
                       int(e.mtime.timestamp()) if e.mtime else None)
        return
    try:
        listing = os.scandir(base)
    except FileNotFoundError:
        return
    with listing:
        for e in listing:
            path = f"{base.rstrip('/')}/{_printable(e.name)}"
            if e.is_dir(follow_symlinks=False):
                yield path, True, 0, None
            elif e.is_file():
                try:
                    s = e.stat()
                except FileNotFoundError:
                    continue
                yield path, False, s.st_size, int(s.st_mtime)


def _list(batches):
    columns = ["path", "folder", "size_bytes", "last_modified"]

    def frame(rows):
        return pd.DataFrame(rows, columns=columns).astype({"size_bytes": "int64", "last_modified": "Int64"})

    for b in batches:
        held = []
        for folder in b["path"]:
            for e in _entries(folder):
                held.append(e)
                if len(held) == _BATCH_ROWS:
                    yield frame(held)
                    held = []
        if held:
            yield frame(held)


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, last_modified, size_bytes, name, extension) of every regular file
    below ``root``: hidden, ``_`` and empty ones too, links to folders not
    followed. No body is read. A missing or empty root gives no rows; a name
    that is not UTF-8 is listed with U+FFFD for its bad bytes."""
    tasks = 4 * spark.sparkContext.defaultParallelism
    frontier = spark.createDataFrame([(root,)], "path string")
    files = []
    while True:
        level = materialized(frontier.repartition(tasks).mapInPandas(_list, _ENTRY), "walk-level")
        files.append(level.where(~F.col("folder")))
        frontier = level.where("folder").select("path")
        if frontier.isEmpty():
            break
    found = reduce(DataFrame.unionByName, files)
    return with_path_parts(found.select(P.strip_uri("path").alias("path"), "last_modified", "size_bytes"))


# ---------------------------------------------------------------------------
# split reading
# ---------------------------------------------------------------------------
def _lead(body: bytes) -> int:
    """Bytes at the start that belong to a character begun before: 3 at most."""
    n = 0
    while n < min(3, len(body)) and body[n] & 0xC0 == 0x80:
        n += 1
    return n


def _read_range(path: str, offset: int, length: int) -> bytes | None:
    base = _local(path)
    try:
        if base is not None:
            with open(base, "rb") as f:
                f.seek(offset)
                return f.read(length)
        system, inside, _ = _store(path)
        with system.open_input_file(inside) as f:
            f.seek(offset)
            return f.read(length)
    except OSError:
        return None


def _recut(path: str, offset: int, length: int) -> tuple[int, bytes | None]:
    """The range moved to borders of UTF-8 characters: both ends go past what
    continues a character, by a rule of the bytes behind them alone, so that
    neighbouring ranges agree."""
    body = _read_range(path, offset, length + 3)
    if body is None:
        return offset, None
    begin = _lead(body) if offset else 0
    return offset + begin, body[begin:length + _lead(body[length:])]


def _read_pieces(batches):
    for b in batches:
        held, size = [], 0
        for path, piece, offset, length in b[["path", "piece", "offset", "length"]].itertuples(index=False):
            at, body = _recut(path, offset, length)
            if body is None and piece or body == b"" and offset:
                continue  # one row tells it; nothing begins in this range
            held.append((path, piece, at, body))
            size += len(body or b"")
            if size >= BATCH_BYTES or len(held) == _BATCH_ROWS:
                yield pd.DataFrame(held, columns=["path", "piece", "offset", "content"])
                held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=["path", "piece", "offset", "content"])


def read_pieces(files: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(path, piece, offset, content) of the bodies of ``files`` (path,
    size_bytes): every byte in exactly one piece, pieces numbered from 0 per
    path in the order of their offsets, cut at borders of UTF-8 characters
    (bytes that are not UTF-8 stay as they are). No row is larger than
    ``piece_bytes`` + 3. An empty file is one empty piece; a file that cannot
    be opened is one piece with a null content."""
    spark = files.sparkSession
    pieces = F.greatest(F.lit(1), F.ceil(F.col("size_bytes") / piece_bytes)).cast("bigint")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)).alias("piece")) \
        .withColumn("offset", F.col("piece") * piece_bytes).withColumn("length", F.lit(piece_bytes).cast("bigint"))
    total = files.agg(F.sum("size_bytes")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    return ranges.repartition(int(tasks), "path", "piece").mapInPandas(
        _read_pieces, "path string, piece bigint, offset bigint, content binary")


def text_pieces(files: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(path, piece, offset, status, text) of the ``.txt`` files among ``files``
    (path, extension, size_bytes), whatever their size. status: ok | repaired
    (bytes that are not UTF-8 replaced) | no_text (empty or not to be opened).
    A text is its pieces joined in order."""
    got = read_pieces(files.where(F.col("extension") == ".txt"), piece_bytes)
    text = X.repaired_text("content")
    status = F.when(F.coalesce(F.length("content"), F.lit(0)) == 0, "no_text") \
        .when(~X.is_valid_utf8("content"), "repaired").otherwise("ok")
    return got.select("path", "piece", "offset", status.alias("status"), text.alias("text"))


# ---------------------------------------------------------------------------
# a tree of files from rows
# ---------------------------------------------------------------------------
def _write_file(path: str, body: bytes) -> None:
    base = _local(path)
    if base is None:
        system, inside, _ = _store(path)
        system.create_dir(inside.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(inside) as f:
            f.write(body)
        return
    os.makedirs(os.path.dirname(base), exist_ok=True)
    part = f"{base}.{os.getpid()}.part"
    with open(part, "wb") as f:
        f.write(body)
    os.replace(part, base)  # whole or not at all; a second attempt replaces it


def write_files(rows: DataFrame, root: str) -> int:
    """Writes ``content`` (binary) of every row as the file ``path`` below
    ``root``, in tasks; returns the number of rows. Paths must be distinct."""
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, _WRITE_ROWS):
                part = b.slice(i, _WRITE_ROWS)
                for path, body in zip(part.column("path").to_pylist(), part.column("content").to_pylist()):
                    _write_file(f"{root.rstrip('/')}/{path}", body)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    return rows.select("path", "content").mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0
