"""Readers for the driver tables and the relations derived from them.

The driver's ``documents`` table stands in for a file store: ``doc_id`` is
the file id; extension, mtime, name and path follow fixed rules so that the
same relation can be written in any SQL engine. ``old`` is the stored index
state the upsert jobs start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed rules of the derived file relation (same text in the oracle SQL).
EXTENSION_BY_MOD8 = [".txt", ".pdf", ".png", ".jpg", ".jpeg", ".md", ".TXT", ""]
MTIME_BASE = 1700000000
MTIME_MULT = 7919
MTIME_SPAN = 100000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    """files(file_id, path, name, extension, last_modified[, text, lang, source])."""
    d = read(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSION_BY_MOD8]),
                       (F.col("doc_id") % 8 + 1).cast("int"))
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), ext)
    cols = [
        F.col("doc_id").alias("file_id"),
        F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), name).alias("path"),
        name.alias("name"),
        ext.alias("extension"),
        (F.lit(MTIME_BASE) + (F.col("doc_id") * MTIME_MULT) % MTIME_SPAN).cast("bigint").alias("last_modified"),
    ]
    if with_text:
        cols += [F.col("text"), F.col("lang"), F.col("source")]
    return d.select(*cols)


def stored_index(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    """The index as stored before this run: files with doc_id % 5 <> 0 whose
    stored mtime is newer (+1), equal, or older (-1) than the file's."""
    f = files(spark, sf_dir, with_text=with_text)
    return (f.where(F.col("file_id") % 5 != 0)
             .withColumn("last_modified",
                         (F.col("last_modified") + 1 - F.col("file_id") % 3).cast("bigint")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vectors(file_id, embedding, label)."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("file_id"), "embedding", "label")


def damaged_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors with one damage for ids of each of five remainders by 11:
    missing, empty, one component short, twice as long, not a number."""
    case, v = F.col("file_id") % 11, F.col("embedding")
    nan = F.concat(F.array(F.lit(float("nan")).cast("float")), F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))))
    bad = F.when(case == 1, F.array().cast("array<float>")) \
        .when(case == 2, F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0)))) \
        .when(case == 3, F.transform(v, lambda x: x * F.lit(2.0).cast("float"))).when(case == 4, nan).when(case > 4, v)
    return vectors(spark, sf_dir).withColumn("embedding", bad)


def scanned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, has_text) of a scan in which every thirteenth file has lost its
    text; the texts stay in the scanning tasks."""
    text = F.when(F.col("file_id") % 13 == 6, F.lit("")).otherwise(F.col("text"))
    return files(spark, sf_dir, with_text=True).select("path", (F.length(text) > 0).alias("has_text"))


def damaged_encodings(windows: DataFrame) -> DataFrame:
    """Encoded windows with one fault for ids of each of four remainders by 7:
    no mask, a mask of zeros, a mask one entry short, an id too many."""
    case, ids, mask = F.col("doc_id") % 7, F.col("input_ids"), F.col("attention_mask")
    bad_mask = F.when(case == 4, F.transform(mask, lambda m: m * 0)) \
        .when(case == 5, F.slice(mask, 1, F.greatest(F.size(mask) - 1, F.lit(0)))).when(case != 3, mask)
    return windows.withColumn("attention_mask", bad_mask) \
        .withColumn("input_ids", F.when(case == 6, F.concat(ids, F.array(F.lit(0).cast("bigint")))).otherwise(ids))


def token_vectors(spark: SparkSession, sf_dir: str, vocab: DataFrame) -> DataFrame:
    """(token_id, embedding): the stored vectors in turn for the reserved ids and
    those of ``vocab``."""
    emb = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    ids = spark.range(4).select(F.col("id").alias("token_id")).unionByName(vocab.select("token_id"))
    n = emb.agg(F.count(F.lit(1)).alias("n"))
    return ids.join(F.broadcast(n), F.lit(True)).withColumn("vec_id", F.col("token_id") % F.col("n")) \
        .join(emb, "vec_id").select("token_id", "embedding")
