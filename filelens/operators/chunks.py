"""Chunking of whole texts and best-chunk-per-file search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelens.operators.common import spread
from filelens.operators.dense import dense_search

# Fixed chunk geometry: 1000 characters, a new chunk every 800 (200 overlap).
CHUNK_SIZE = 1000
CHUNK_STEP = 800


def chunk_docs(docs: DataFrame, size: int = CHUNK_SIZE, step: int = CHUNK_STEP,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text cut into overlapping windows that cover it whole:
    chunk i starts at i*step, n = max(ceil((len - (size-step)) / step), 1).
    Narrow (explode inside each scan task): no shuffle."""
    if size > 2 * step:
        raise ValueError("a chunk reaches over one step at most")
    # each text is cut once into pieces of ``step``; a chunk is its piece and
    # the start of the next one, so the work is linear in the text
    t = F.coalesce(F.col(text_col), F.lit(""))
    n = F.greatest(F.ceil((F.length(t) - (size - step)) / F.lit(float(step))), F.lit(1)).cast("int")
    # never empty: a text without characters is one empty piece
    pieces = F.when(t == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)))
    rest = F.slice(F.concat(pieces, F.array(F.lit(""))), F.lit(2), F.size(pieces))
    both = F.zip_with(pieces, rest, lambda p, q: F.concat(p, F.substring(q, 1, size - step)))
    ex = spread(docs, id_col).select(
        id_col, F.col(text_col).isNull().alias("_null"), F.posexplode(F.slice(both, F.lit(1), n)).alias("chunk_no", "chunk"))
    return ex.select(id_col, F.col("chunk_no").cast("bigint").alias("chunk_no"),
                     (F.col("chunk_no").cast("bigint") * step).alias("start"),
                     F.when(~F.col("_null"), F.col("chunk")).alias("chunk"))


def chunk_search(chunk_vecs: DataFrame, queries: DataFrame, k: int = 5, *, id_col: str = "doc_id",
                 qid_col: str = "query_id", dim: int | None = None, vec_col: str = "embedding",
                 vectorize=None) -> DataFrame:
    """Top-k files per query, each represented by its best chunk (score desc,
    then lowest chunk number). ``chunk_vecs`` has doc id, chunk_no (together the
    key of a chunk, so ids of any size do) and embedding (or, with ``vectorize``, the column it turns into vectors
    inside the task). The dense kernel keeps per task the k best *files* by
    their best chunk, so the result is exact without emitting all chunks."""
    return dense_search(chunk_vecs, queries, k, id_col="chunk_no", vec_col=vec_col, vectorize=vectorize,
                        qid_col=qid_col, qvec_col="embedding", payload=[id_col],
                        group_col=id_col, dim=dim)
