"""Search operators: index scan, cosine scores, top-k, batch search,
similarity threshold and the similarity self-join."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from filelens.functions import vectors as V
from filelens.operators.dense import dense_matrix, dense_search, float32_slack, infer_dim, pair_scores, unit_rows
from filelens.schema import DEFAULT_K


def index_vectors(files: DataFrame, vecs: DataFrame) -> DataFrame:
    """files LEFT JOIN vectors on file_id: files without a vector keep a NULL
    embedding (read as an empty vector, scoring 0.0)."""
    return files.join(vecs.select("file_id", "embedding"), "file_id", "left")


def _query_literal(vec) -> tuple:
    arr = None if vec is None else [float(x) for x in vec]
    return arr


def cosine_scores(index: DataFrame, query_vec, decimals: int = 6) -> DataFrame:
    """Every index row scored against one query vector (no pruning)."""
    q = _query_literal(query_vec)
    qcol = F.lit(None).cast("array<double>") if q is None else F.array(*[F.lit(x) for x in q])
    qnorm = F.lit(0.0) if q is None else F.lit(float(np.sqrt(np.dot(q, q))))
    score = V.cosine(F.col("embedding"), qcol, b_norm=qnorm, decimals=decimals)
    return index.withColumn("score", score)


def search_topk(index: DataFrame, query_vec, k: int = DEFAULT_K,
                drop_unscored: bool = False) -> DataFrame:
    """One query: full scoring, order by (score desc, file_id), keep k.

    k = 0 -> empty; k < 0 -> no cut; fewer than k rows -> all of them.
    Missing vectors score 0.0 and rank above negative scores unless
    ``drop_unscored``. The plan is a TakeOrderedAndProject (per-partition
    top-k, then a merge of k rows per partition)."""
    scored = cosine_scores(index, query_vec)
    if drop_unscored:
        scored = scored.where(F.col("embedding").isNotNull())
    res = scored.select("file_id", "path", "name", "extension", "score")
    res = res.orderBy(F.desc("score"), F.asc("file_id"))
    if k >= 0:
        res = res.limit(k)
    return res


def search_batch(index: DataFrame, queries: DataFrame, k: int = DEFAULT_K,
                 threshold: float | None = None, **kw) -> DataFrame:
    """Many queries at once: query_id, rank, file_id, path, name, extension, score."""
    return dense_search(index, queries, k, id_col="file_id", vec_col="embedding",
                        qid_col="query_id", qvec_col="embedding",
                        payload=["path", "name", "extension"], threshold=threshold, **kw)


# Rows of a block that are scored against the other block at once.
PAIR_ROWS = 512

_PAIR_SCHEMA = T.StructType([
    T.StructField("id_a", T.LongType()), T.StructField("id_b", T.LongType()),
    T.StructField("score", T.DoubleType())])


def cosine_pairs(vecs: DataFrame, threshold: float, id_col: str = "file_id",
                 vec_col: str = "embedding", block_rows: int = 4096) -> DataFrame:
    """All pairs (id_a < id_b) with cosine >= threshold, exactly.

    Rows are hashed into B blocks of about ``block_rows``; each unordered
    block pair (i <= j) is one group holding the two blocks (bounded size),
    scored by one matrix product; only pairs over the threshold leave the
    task. Every row is replicated B times, so B grows with n -- exact all
    pairs is quadratic by nature; for large n use :func:`filelens.operators.ann`."""
    n = vecs.count()
    dim = infer_dim(vecs, vec_col)
    nb = max(1, math.ceil(n / block_rows))
    base = vecs.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v"),
                       F.pmod(F.xxhash64(id_col), F.lit(nb)).alias("blk"))
    other = F.explode(F.sequence(F.lit(0), F.lit(nb - 1)).cast("array<bigint>"))
    rep = (base.withColumn("x", other)
               .withColumn("lo", F.least("blk", "x")).withColumn("hi", F.greatest("blk", "x"))
               .drop("x"))

    slack = float32_slack(dim)

    def score_group(rows: pa.Table) -> pa.Table:
        blk, ids = rows.column("blk").to_numpy(), rows.column("id").to_numpy()
        lo, hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
        mat, valid = dense_matrix(rows.column("v"), dim)
        mat[~valid] = 0.0
        unit, norms = unit_rows(mat)
        left, right = np.flatnonzero(blk == lo), np.flatnonzero(blk == hi)
        across = unit[right].T
        out = []
        for i in range(0, len(left), PAIR_ROWS):  # a tile of scores at a time
            tile = left[i:i + PAIR_ROWS]
            near = unit[tile] @ across >= threshold - slack
            if lo == hi:
                near &= ids[tile][:, None] < ids[right][None, :]
            r, c = np.nonzero(near)
            a, b = tile[r], right[c]
            score = pair_scores(mat, norms, mat, norms, a, b)
            over = score >= threshold
            a, b = ids[a[over]], ids[b[over]]
            out.append(pa.table([np.minimum(a, b), np.maximum(a, b), score[over]], names=_PAIR_SCHEMA.names))
        return pa.concat_tables(out) if out else pa.table([[], [], []], schema=to_arrow_schema(_PAIR_SCHEMA))

    return rep.groupBy("lo", "hi").applyInArrow(score_group, _PAIR_SCHEMA)


def pa_list(series: pd.Series, dim: int):
    arr = pa.array(series.tolist(), type=pa.list_(pa.float64()))
    return dense_matrix(arr, dim)
