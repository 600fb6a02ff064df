"""Keyword ranking (BM25 over the inverted index) and hybrid rank fusion."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filelens.functions import text as X
from filelens.operators import inverted
from filelens.operators.common import materialized
from filelens.operators.inverted import BM25_B, BM25_K1

# Least length to which hybrid ranking makes each list
LIST_DEPTH = 256
RRF_K = 60           # fixed reciprocal-rank-fusion constant
_ROUNDING = 1e-6     # fused scores have six decimals


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 5, *, id_col: str = "doc_id",
              qid_col: str = "query_id", text_col: str = "text",
              k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """Top-k documents per query by BM25 over the distinct query words.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)); doc length = word count;
    a document scores for a query when it holds at least one of its words;
    ties by id. ``k`` < 0: no cut.

    The documents are indexed (:mod:`inverted`) for the words of the queries
    and searched with block bounds; to search more than once, build a whole
    index once."""
    index = _index_for(docs, queries, id_col, text_col, k1, b)
    return bm25_search(index, queries, k, id_col=id_col, qid_col=qid_col, text_col=text_col)


def _index_for(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, k1: float, b: float,
               dim: int | None = None) -> inverted.InvertedIndex:
    made = inverted.build(docs, id_col=id_col, text_col=text_col, dim=dim,
                          only=queries.select(F.explode(X.words(text_col)).alias("term")))
    return inverted.InvertedIndex(docs.sparkSession, made.root, k1, b)


def bm25_search(index: inverted.InvertedIndex, queries: DataFrame, k: int = 5, *, id_col: str = "doc_id",
                qid_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """:func:`bm25_topk` on a stored index."""
    cut = None if k is None or k < 0 else k
    found = index.query(queries, qid_col=qid_col, text_col=text_col).top(cut)
    return found.select("query_id", "rank", F.col("doc").alias(id_col), "score")


def settled_depth(k: int, c: int = RRF_K) -> int | None:
    """Length of both lists from which no document outside of them can be
    among the k best of their fusion. The k-th of either list has at least
    1 / (c + k), a document in neither at most 2 / (c + depth + 1). ``None``
    where the rounding of fused scores leaves no such length (k over 499,000)."""
    least = 1.0 / (c + max(k, 1)) - 2 * _ROUNDING
    return max(LIST_DEPTH, math.ceil(2.0 / least) - c) if least > 0 else None


def hybrid_topk(docs: DataFrame, queries: DataFrame, k: int = 5, depth: int | None = None, *,
                id_col: str = "doc_id", qid_col: str = "query_id", text_col: str = "text",
                dim: int | None = None, c: int = RRF_K,
                k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """Hybrid keyword + semantic rank: reciprocal rank fusion (constant
    ``c``) of the whole BM25 list and the whole cosine list over hashed-term
    vectors, cut to k per query.

    A rank join: both lists are made to ``depth`` only (at least
    :func:`settled_depth`, so that nothing outside of both can be among the k
    best). Documents of one list that could still get among them by their rank
    in the other have that rank counted: how many documents score better, as
    one partial sum per task and candidate. The answer is that of the whole
    lists, and no list longer than ``depth`` is made. The texts are read and
    split once: the index keeps their vectors beside the postings."""
    from filelens.operators import embed
    from filelens.operators.dense import dense_ranks, dense_search
    dim = dim or embed.EMBEDDING_DIM
    enough = settled_depth(k, c)
    depth = None if enough is None else max(depth or 0, enough)
    texts = queries.select(F.col(qid_col).cast("bigint").alias("query_id"), F.col(text_col).alias("text"))
    qs = materialized(embed.hashed_embed(texts, dim=dim, id_col="query_id"), "hybrid-queries")
    index = _index_for(docs, texts.withColumnRenamed("text", text_col), id_col, text_col, k1, b, dim)
    vecs, asked = index.vectors, index.query(texts)
    kept = {"id_col": "doc", "vec_col": "vec", "qid_col": "query_id", "dim": dim, "vectorize": embed.counts_vectorizer(dim)}
    sem = materialized(dense_search(vecs, qs, depth, **kept)
                       .select("query_id", "doc", F.col("rank").alias("ra")), "hybrid-semantic")
    kw = materialized(asked.top(depth).select("query_id", "doc", F.col("rank").alias("rb")), "hybrid-keyword")
    if depth is None:
        return rrf_fuse(sem.withColumnRenamed("ra", "rank"), kw.withColumnRenamed("rb", "rank"), k, "doc", c) \
            .withColumnRenamed("doc", id_col)
    open_ = materialized(_open_candidates(sem, kw, depth, k, c), "hybrid-candidates")
    more_a = dense_ranks(vecs, qs, open_.where("ra is null and whole_a = 0").select("query_id", "doc"), **kept)
    more_b = asked.ranks(open_.where("rb is null and whole_b = 0").select("query_id", "doc"))
    full = open_.join(more_a.withColumnRenamed("rank", "xa"), ["query_id", "doc"], "left") \
        .join(more_b.withColumnRenamed("rank", "xb"), ["query_id", "doc"], "left")
    score = _part(F.coalesce("ra", "xa"), c) + _part(F.coalesce("rb", "xb"), c)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc"))
    return full.select("query_id", "doc", F.round(score, 6).alias("score")) \
        .withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k) \
        .select("query_id", "rank", F.col("doc").alias(id_col), "score")


def _part(rank, c: int):
    return F.coalesce(F.lit(1.0) / (F.lit(c) + rank), F.lit(0.0))


def _open_candidates(sem: DataFrame, kw: DataFrame, depth: int, k: int, c: int) -> DataFrame:
    """(query_id, doc, ra, rb, whole_a, whole_b): the documents of either list
    that can be among the k best of the whole lists' fusion. A list shorter
    than ``depth`` is whole, and a document outside of it has no rank there."""
    sizes = [x.groupBy("query_id").agg((F.count(F.lit(1)) < depth).cast("int").alias(n))
             for x, n in ((sem, "whole_a"), (kw, "whole_b"))]
    known = sem.join(kw, ["query_id", "doc"], "full")
    for s in sizes:
        known = known.join(s, "query_id", "left")
    known = known.withColumn("whole_a", F.coalesce("whole_a", F.lit(1))).withColumn("whole_b", F.coalesce("whole_b", F.lit(1)))
    low = _part(F.col("ra"), c) + _part(F.col("rb"), c)
    beyond = F.lit(1.0) / (c + depth + 1)
    high = low + F.when(F.col("ra").isNull() & (F.col("whole_a") == 0), beyond).otherwise(0.0) \
        + F.when(F.col("rb").isNull() & (F.col("whole_b") == 0), beyond).otherwise(0.0)
    w = Window.partitionBy("query_id").orderBy(F.desc("low"), F.asc("doc"))
    known = known.withColumn("low", low).withColumn("high", high).withColumn("nth", F.row_number().over(w))
    cut = F.coalesce(F.max(F.when(F.col("nth") == k, F.col("low"))).over(Window.partitionBy("query_id")), F.lit(0.0))
    return known.withColumn("cut", cut).where(F.col("high") >= F.col("cut") - 2 * _ROUNDING) \
        .select("query_id", "doc", "ra", "rb", "whole_a", "whole_b")


def rrf_fuse(a: DataFrame, b: DataFrame, k: int = 5, id_col: str = "doc_id", c: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query_id, rank, id):
    score = sum over lists of 1 / (c + rank); a document missing from a list
    adds nothing (full outer join). Top k per query, ties by id."""
    x = a.select("query_id", id_col, F.col("rank").alias("ra"))
    y = b.select("query_id", id_col, F.col("rank").alias("rb"))
    j = x.join(y, ["query_id", id_col], "full")
    s = (F.coalesce(F.lit(1.0) / (F.lit(c) + F.col("ra")), F.lit(0.0)) +
         F.coalesce(F.lit(1.0) / (F.lit(c) + F.col("rb")), F.lit(0.0)))
    fused = j.select("query_id", id_col, F.round(s, 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col))
    return (fused.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
            .select("query_id", "rank", id_col, "score"))
