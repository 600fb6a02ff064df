"""Browse and report operators: recent list, substring filter, statistics,
tags and per-file features. None of them reads the vector column unless it
reports on it, so Parquet prunes it from the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelens.functions import text as X
from filelens.functions import vectors as V
from filelens.schema import DEFAULT_LIST_LIMIT

LIGHT_COLUMNS = ["file_id", "path", "name", "extension", "last_modified"]


def list_recent(index: DataFrame, limit: int = DEFAULT_LIST_LIMIT) -> DataFrame:
    """Most recently modified first (NULL mtimes last, ties by path); the
    limit applies only when > 0. Plan: TakeOrderedAndProject over the light
    columns -- each task keeps ``limit`` rows, the driver merges them."""
    res = index.select(*LIGHT_COLUMNS).orderBy(F.desc_nulls_last("last_modified"), F.asc("path"))
    return res.limit(limit) if limit > 0 else res


def list_filter(index: DataFrame, needle: str, limit: int = DEFAULT_LIST_LIMIT) -> DataFrame:
    """Case-sensitive substring of ``name + ' ' + path`` applied *after* the
    recent-list limit (the browse view filters what it has loaded); an
    empty needle keeps all."""
    recent = list_recent(index, limit)
    if not needle:
        return recent
    return recent.where(F.concat(F.col("name"), F.lit(" "), F.col("path")).contains(needle))


def index_stats(index: DataFrame) -> DataFrame:
    """Per extension: files, files with a vector, dimension and norm range."""
    d = V.vector_dim("embedding")
    n = V.norm("embedding")
    return (index.select("extension", "embedding", d.alias("dim"), n.alias("nrm"))
            .groupBy("extension")
            .agg(F.count(F.lit(1)).alias("n_files"),
                 F.count("embedding").alias("n_vectors"),
                 F.min(F.when(F.col("dim") > 0, F.col("dim"))).alias("min_dim"),
                 F.max("dim").alias("max_dim"),
                 F.round(F.min("nrm"), 6).alias("min_norm"),
                 F.round(F.max("nrm"), 6).alias("max_norm")))


def label_tags(labels: DataFrame) -> DataFrame:
    """(file_id, tag) rows from the 0/1 label columns (unpivot + filter)."""
    return (labels.select(F.col("doc_id").alias("file_id"),
                          F.explode(F.array(
                              F.when(F.col("quality") == 1, F.lit("quality")),
                              F.when(F.col("toxic") == 1, F.lit("toxic")),
                              F.lit("labeled"))).alias("tag"))
            .where(F.col("tag").isNotNull()))


def file_tags(files: DataFrame, tags: DataFrame) -> DataFrame:
    """File <-> tag many-to-many: each file with its sorted distinct tags
    joined as one string ('' when untagged). Tags per file are a handful,
    so the per-file set is bounded."""
    per_file = tags.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    return files.select("file_id", "path").join(per_file, "file_id", "left") \
        .select("file_id", "path", F.coalesce("tags", F.lit("")).alias("tags"))


def file_features(files_with_text: DataFrame) -> DataFrame:
    """size_bytes (UTF-8 bytes of the text), title (first line, trimmed),
    content_hash (SHA-256)."""
    t = F.col("text")
    return files_with_text.select(
        "file_id",
        F.octet_length(t).cast("bigint").alias("size_bytes"),
        F.trim(F.split_part(t, F.lit("\n"), F.lit(1))).alias("title"),
        X.content_hash(t).alias("content_hash"))
