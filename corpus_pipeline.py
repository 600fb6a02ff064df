"""Corpus pipeline: documents to packed training sequences.

Five stages, each one operator of ``filelens.llm`` over all rows that the
stage before it kept. A stage's result is written as Parquet under the shared
folder and read again as the next one's ``docs``.

1. quality rules: documents that fail the base rules or are robust outliers go;
2. line dedup: later repeated runs of 50 words or more are deleted, and
   documents without any words left go;
3. near-duplicates: one document of each group stays;
4. source mix: whole documents, as often as the schedule takes them;
5. packing: pieces of sequences of 2,048 tokens.

A stage's result must be written before the next stage is called, as ``run``
does: what a stage wrote on its way goes when the next one starts.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from filelens.llm import bagminhash, concat_pack, quality_mcd, source_mix, winnow
from filelens.operators.common import materialized, recorded_tables, remove_tables
from filelens.tables import read

_used: list[str] = []  # intermediate tables of the stage before


def _stage(fn):
    @wraps(fn)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove_tables(spark, _used)
        with recorded_tables(_used):
            return fn(spark, docs, sf_dir)
    return stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_mcd.keep_good(docs)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnow.drop_repeats(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.keep_first(docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    remove_tables(spark, _used)  # its own are part of the pipeline's result
    return concat_pack.pack(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

# Robust scatter, BagMinHash signatures and byte-level BPE are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        with recorded_tables([]) as written:
            docs = materialized(docs, f"pipeline-{name}")
        remove_tables(spark, before)
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
