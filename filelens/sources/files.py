"""File inventory and text extraction by the rules of Spark's file source.

Differences from a plain directory walk (documented, not hidden): the file
source skips names starting with '.' or '_' (files and directories), skips
zero-length files, follows directory symlinks and returns ``file:`` URIs
(stripped here). Local trees are listed and read in tasks by the same rules
(``sources.listing``), other stores by Spark's binaryFile source, whose driver
holds the status of every file. ``sources.walk`` lists a tree exactly and reads
bodies of any size in pieces; for an inventory from another listing, pass a
DataFrame of path strings to :func:`inventory_from_paths`.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens.functions import paths as P
from filelens.functions import text as X
from filelens.operators.common import few_rows_at_once, materialized, spread
from filelens.schema import ALLOWED_EXTENSIONS, IMAGE_EXTENSIONS
from filelens.sources import listing

# A row of Spark's binary reader holds at most 2 GiB. Larger texts come whole
# from ``walk.text_pieces``; only bodies for extractors are quarantined.
MAX_CONTENT_BYTES = 2_000_000_000


def _load(spark: SparkSession, root: str, glob: str | None) -> DataFrame:
    """The files below ``root`` by Spark's own source. Spark deals small files as if each were 4 MB
    (about 32 to a task); they are dealt by their own bytes instead, over all
    task slots."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return by_bytes(r.load(root))


def by_bytes(files: DataFrame) -> DataFrame:
    """A scan of many small files in tasks of about ``listing.SCAN_BYTES``; no
    file moves between tasks."""
    size = int(files._jdf.queryExecution().analyzed().stats().sizeInBytes())
    return files.coalesce(max(4 * files.sparkSession.sparkContext.defaultParallelism, -(-size // listing.SCAN_BYTES)))


def inventory(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, name, extension, last_modified, size_bytes) for every regular
    file below ``root``. No file body is read -- only the listing, which tasks
    make and write."""
    roots = listing.local_roots(spark, root)
    df = _load(spark, root, glob) if roots is None else listing.listed(spark, roots, glob)
    return with_path_parts(df.select(P.strip_uri("path").alias("path"),
                                     F.unix_timestamp("modificationTime").cast("bigint").alias("last_modified"),
                                     F.col("length").cast("bigint").alias("size_bytes")))


def with_path_parts(df: DataFrame, path_col: str = "path") -> DataFrame:
    name = P.file_name(path_col)
    return df.withColumn("name", name).withColumn("extension", P.extension(F.col("name")))


def inventory_from_paths(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Inventory rows from path strings of another listing (names with
    leading '.', '_' or empty files are kept)."""
    return with_path_parts(paths.select(P.normalize_path(path_col).alias("path"), *[
        c for c in paths.columns if c != path_col]))


def read_content(spark: SparkSession, root: str, wanted: DataFrame | None = None,
                 glob: str | None = None, max_bytes: int = MAX_CONTENT_BYTES) -> DataFrame:
    """(path, content, size_bytes, last_modified) for files below ``root``;
    restricted to the paths of ``wanted`` (a semi-join) when given. Files
    over ``max_bytes`` keep a NULL content and are never read."""
    roots = listing.local_roots(spark, root)
    src = _load(spark, root, glob) if roots is None else listing.listed(spark, roots, glob)
    meta = [P.strip_uri("path").alias("path"), F.col("length").cast("bigint").alias("size_bytes"),
            F.unix_timestamp("modificationTime").cast("bigint").alias("last_modified")]
    total = 0 if roots is None else listing.total_bytes(src.where(F.col("length") <= max_bytes))
    if wanted is not None and roots is not None:  # only their bodies are read
        src = src.join(wanted.select("path"), "path", "left_semi")
    # the length filter is pushed into the binaryFile reader or the scan of the
    # listing, so a body is read only for files under the limit; larger files
    # are listed without their body (reading one over the source's own maximum
    # would fail the job)
    small = src.where(F.col("length") <= max_bytes)
    if roots is not None:
        small = listing.with_bodies(small, max_bytes, total)
    large = src.where(F.col("length") > max_bytes).select(*meta, F.lit(None).cast("binary").alias("content"))
    df = small.select(*meta, "content").unionByName(large)
    if wanted is not None and roots is None:
        df = df.join(wanted.select("path"), "path", "left_semi")
    return df


# ---------------------------------------------------------------------------
# extraction dispatch
# ---------------------------------------------------------------------------
Extractor = Callable[[pd.Series], pd.Series]  # bytes -> text ('' = nothing)
_EXTRACTORS: dict[str, Extractor] = {}


def register_extractor(extensions: list[str], fn: Extractor) -> None:
    """Plug an extractor (e.g. PDF text or OCR) for some extensions. It runs
    inside Spark tasks on Arrow batches of file bodies."""
    for e in extensions:
        _EXTRACTORS[e] = fn


def registered_extractors() -> dict[str, Extractor]:
    return dict(_EXTRACTORS)


def extract(files: DataFrame, strict_reference: bool = False,
            extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """Text and status for every file row (needs extension and content), with
    the plugged ``extractors`` by extension (default: the registered ones).

    status: ok | repaired (invalid UTF-8 replaced) | no_text (empty result)
    | too_large (content NULL) | no_extractor (pdf/image without a plugged
    extractor) | unsupported. ``.txt`` is read as UTF-8 in the JVM; the
    extension test is exact and case-sensitive. With ``strict_reference``
    '.jpeg' counts as unsupported (the original dispatch compared it
    without its dot)."""
    images = [e for e in IMAGE_EXTENSIONS if not (strict_reference and e == ".jpeg")]
    plugged = dict(_EXTRACTORS if extractors is None else extractors)
    ext = F.col("extension")
    txt = X.repaired_text("content")
    base = files.withColumn("_kind", F.when(ext == ".txt", "txt")
                            .when(ext.isin(list(plugged)), "plugin")
                            .when(ext.isin([".pdf"] + images), "no_extractor")
                            .otherwise("unsupported"))
    base = base.withColumn("text", F.when(F.col("_kind") == "txt", txt))
    if plugged:
        base = _run_plugins(base, plugged)
    valid = X.is_valid_utf8("content")
    status = (F.when(F.col("_kind").isin("no_extractor", "unsupported"), F.col("_kind"))
              .when(F.col("content").isNull(), "too_large")
              .when(F.col("text").isNull() | (F.length("text") == 0), "no_text")
              .when((F.col("_kind") == "txt") & ~valid, "repaired")
              .otherwise("ok"))
    return base.withColumn("status", status).drop("_kind")


# Files of a batch whose bodies are handed to extractors at once.
_PLUGIN_FILES = 200


def _run_plugins(df: DataFrame, plugged: dict[str, Extractor]) -> DataFrame:
    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            for i in range(0, b.num_rows, _PLUGIN_FILES):
                part = b.slice(i, _PLUGIN_FILES)
                # of a file, its body and text alone become Python objects
                pdf = part.select(["extension", "content", "text"]).to_pandas()
                for e, fn in plugged.items():
                    m = (pdf["extension"] == e) & pdf["content"].notna()
                    if m.any():
                        pdf.loc[m, "text"] = fn(pdf.loc[m, "content"]).values
                yield part.set_column(at, part.schema.field(at), pa.array(pdf["text"], part.schema.field(at).type, from_pandas=True))

    return df.mapInArrow(run, df.schema)


def eligible(inv: DataFrame, allowed=ALLOWED_EXTENSIONS) -> DataFrame:
    return inv.where(F.col("extension").isin(list(allowed)))


# Characters that a folder's name holds escaped, as Spark's writer has them.
_ESCAPED = re.compile("[\x00-\x1f\x7f\"#%'*/:=?\\\\{}\\[\\]^]")


def _folder(key: str, value: str | None) -> str:
    """``key=value`` as the folders of Spark's partitioned writer are named."""
    return f"{key}=" + (_ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", value) if value else "__HIVE_DEFAULT_PARTITION__")


def write_corpus(docs: DataFrame, root: str, id_col: str = "doc_id") -> None:
    """Materialise a text table as a file tree: one file per document,
    source=/lang=/doc_<id>.txt, which holds the text and a final newline (rows
    of one source, language and id are the lines of one file). Tasks write the
    files: Spark's writer of partitions takes far longer over the folder and
    the commit of each file than over its text. Only texts that share a file
    move between tasks."""
    from filelens.sources.walk import write_files

    line = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"))
    keys = {"source": F.col("source").cast("string"), "lang": F.col("lang").cast("string"),
            "name": F.concat(F.lit("doc_"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(".txt"))}
    named = [c.alias(k) for k, c in keys.items()]
    shared = materialized(docs.select(*named).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                          .select(*[F.col(k).alias(f"_{k}") for k in keys]), "corpus-shared")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    lines = spread(docs.select(*named, line.alias("line")))
    alone = lines.join(shared, same, "left_anti").withColumn("line", F.col("line").cast("binary"))
    # an explicit partition count: AQE would coalesce a small shuffle into one
    # task that then creates all of these files alone
    n = 4 * docs.sparkSession.sparkContext.defaultParallelism
    joined = lines.join(shared, same, "left_semi").repartition(n, *keys) \
        .groupBy(*keys).agg(F.array_join(F.collect_list("line"), "").cast("binary").alias("line"))

    def paths(batches):
        for b in batches:
            yield pd.DataFrame({"path": [f"{_folder('source', x)}/{_folder('lang', y)}/{z}" for x, y, z in
                                         zip(b["source"], b["lang"], b["name"])], "content": b["line"]})

    with few_rows_at_once(docs.sparkSession):
        write_files(alone.unionByName(joined).mapInPandas(paths, "path string, content binary"), root)
