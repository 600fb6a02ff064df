"""The registered training-data queries: name -> (spark, sf_dir) -> DataFrame,
and the DuckDB SQL of those that SQL can express.

Each query applies one operator with its production parameters to its whole
table and derives the contract's columns from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens.tables import read

from . import (bagminhash, concat_pack, conversation_repair, divergence, html_mincut, lm_xent, oracle, piece_table,
               quality_mcd, source_mix, url_alias, va_topk, warc_fixity, winnow)

QUERIES = {}
ORACLE: dict[str, str] = oracle.SQL


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_mincut.extract(read(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@_query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_alias.judge(read(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@_query
def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(read(spark, sf_dir, "documents"))


@_query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.dedup(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_deleted_lines")


@_query
def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_fixity.audit_pages(read(spark, sf_dir, "pages"))


@_query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_mcd.judge(read(spark, sf_dir, "documents"))
    return judged.select("doc_id", *[F.col("stats")[s].alias(s) for s in quality_mcd.STATS],
                         "base_failed", "kept", "mcd_distance")


@_query
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_xent.score(read(spark, sf_dir, "documents"), good)


@_query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concat_pack.pack(read(spark, sf_dir, "documents"))


@_query
def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_topk.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@_query
def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


@_query
def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = piece_table.decode(piece_table.encode(read(spark, sf_dir, "documents")))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("text", 256).alias("decoded_sha256"))


@_query
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents")).select("lang", "source", "part", "item", "value", "rank")


@_query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "conversations")
    return conversation_repair.audit(conversation_repair.damage(given), given)
