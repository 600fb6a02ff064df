"""Plan-shape tests: the physical operators the design relies on are the
ones Spark actually plans (top-k operators, pruned scans, pushed filters,
no cross product)."""

import pytest
from pyspark.sql import functions as F

from filelens import tables
from filelens.operators import browse, dense, embed, inverted, lexical, search

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.fixture(scope="module")
def index(spark):
    return search.index_vectors(tables.files(spark, SF), tables.vectors(spark, SF))


def test_list_recent_prunes_vectors(index):
    p = _formatted(browse.list_recent(index, 200))
    assert "TakeOrderedAndProject" in p
    read_schemas = [ln for ln in p.splitlines() if ln.startswith("ReadSchema")]
    assert read_schemas and not any("embedding" in ln for ln in read_schemas)


def test_batch_topk_window_group_limit(spark):
    docs = embed.hashed_embed(tables.read(spark, SF, "documents"))
    qs = embed.hashed_embed(tables.read(spark, SF, "benchmark").withColumnRenamed("item_id", "query_id"),
                            id_col="query_id")
    out = dense.dense_search(docs, qs, 5, id_col="doc_id", qid_col="query_id")
    p = _plan(out)
    assert "WindowGroupLimit" in p
    # exact search without a cross product of corpus and queries
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_bm25_reads_narrow_bounds_and_no_texts(spark):
    docs = tables.read(spark, SF, "documents")
    qs = tables.read(spark, SF, "benchmark").withColumnRenamed("item_id", "query_id")
    index = inverted.build(docs)
    heads = _formatted(index.postings.select("bucket", "term", "block", "n", "max_tf").where("bucket = 3"))
    schema = [ln for ln in heads.splitlines() if ln.startswith("ReadSchema")][0]
    assert "tfs" not in schema and "PartitionFilters: [isnotnull(bucket" in heads
    p = _formatted(lexical.bm25_search(index, qs, 5))
    assert "documents.parquet" not in p and "WindowGroupLimit" in p
    assert "CartesianProduct" not in p and "NestedLoop" not in p


def test_lookup_filter_reaches_scan(spark):
    v = tables.read(spark, SF, "embeddings").where(F.col("vec_id") == 3).select("vec_id")
    p = _formatted(v)
    assert "EqualTo(vec_id,3)" in p
    assert "embedding" not in [ln for ln in p.splitlines() if ln.startswith("ReadSchema")][0]
