"""Approximate candidate search: sign-random-projection LSH bands, exact
re-rank of the candidates, recall against exact search, exact duplicates.

Hyperplanes are derived from md5 of "band-bit-dim" strings, so no model
state is stored and any engine can rebuild the same planes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filelens.functions import vectors as V
from filelens.operators.common import maybe_broadcast, spread
from filelens.operators.dense import dense_matrix

DEFAULT_BANDS = 64
DEFAULT_BITS = 8


def plane_value(band: int, bit: int, d: int) -> float:
    """Plane coordinate in [-1, 1): first 8 hex digits of md5 scaled."""
    h = int(hashlib.md5(f"{band}-{bit}-{d}".encode()).hexdigest()[:8], 16)
    return h / 2147483648.0 - 1.0


def planes(bands: int, bits: int, dim: int) -> np.ndarray:
    """(bands*bits) x dim matrix; row band*bits + bit."""
    return np.array([[plane_value(b, t, d) for d in range(dim)]
                     for b in range(bands) for t in range(bits)], dtype=np.float64).reshape(bands * bits, dim)


def band_keys(vecs: DataFrame, dim: int, bands: int = DEFAULT_BANDS, bits: int = DEFAULT_BITS,
              id_col: str = "file_id", vec_col: str = "embedding", with_vectors: bool = False) -> DataFrame:
    """(id, band, key): key packs the sign bits of one band (bit t has
    weight 2^t, set when the projection is > 0). One matrix product per
    Arrow batch; vectors that are NULL or of another length get no keys.
    With ``with_vectors`` each row also carries its vector ``v``, so a
    consumer needs no join back to the vectors."""
    P = planes(bands, bits, dim)
    weights = (1 << np.arange(bits)).astype(np.int64)
    sc = vecs.sparkSession.sparkContext
    bc = sc.broadcast(P)
    src = spread(vecs.select(id_col, vec_col))
    fields = [T.StructField("id", T.LongType()), T.StructField("band", T.IntegerType()),
              T.StructField("key", T.LongType())]
    if with_vectors:
        fields.append(T.StructField("v", src.schema[vec_col].dataType))
    schema = T.StructType(fields)

    def run(batches):
        Pm = bc.value
        for rb in batches:
            if rb.num_rows == 0:
                continue
            mat, valid = dense_matrix(rb.column(vec_col), dim)
            pos = np.flatnonzero(valid)
            ids = rb.column(id_col).to_numpy()[pos]
            proj = (mat[pos] @ Pm.T) > 0  # n x (bands*bits)
            keys = proj.reshape(len(ids), bands, bits).astype(np.int64) @ weights  # n x bands
            cols = [pa.array(np.repeat(ids, bands)).cast(pa.int64()),
                    pa.array(np.tile(np.arange(bands, dtype=np.int32), len(ids))),
                    pa.array(keys.reshape(-1).astype(np.int64))]
            names = ["id", "band", "key"]
            if with_vectors:
                cols.append(rb.column(vec_col).take(pa.array(np.repeat(pos, bands))))
                names.append("v")
            yield pa.RecordBatch.from_arrays(cols, names)

    return src.mapInArrow(run, schema)


def _keys_np(mat: np.ndarray, valid: np.ndarray, P: np.ndarray, bands: int, bits: int) -> np.ndarray:
    """n x bands int64 band keys; rows that are not valid get -1 (match nothing)."""
    weights = (1 << np.arange(bits)).astype(np.int64)
    keys = ((mat @ P.T) > 0).reshape(len(mat), bands, bits).astype(np.int64) @ weights
    keys[~valid] = -1
    return keys


def _match_pairs(rkeys: np.ndarray, qkeys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, query) index pairs sharing a key in any band, found by
    sorted search per band (no n x q comparison matrix)."""
    n, bands = rkeys.shape
    nq = qkeys.shape[0]
    codes = []
    for b in range(bands):
        qk = qkeys[:, b]
        order = np.argsort(qk, kind="stable")
        sk = qk[order]
        rk = rkeys[:, b]
        lo = np.searchsorted(sk, rk, "left")
        hi = np.searchsorted(sk, rk, "right")
        cnt = np.where(rk >= 0, hi - lo, 0)
        tot = int(cnt.sum())
        if tot == 0:
            continue
        rows = np.repeat(np.arange(n, dtype=np.int64), cnt)
        offs = np.arange(tot) - np.repeat(np.cumsum(cnt) - cnt, cnt)
        qs = order[np.repeat(lo, cnt) + offs]
        codes.append(rows * nq + qs)
    if not codes:
        e = np.zeros(0, dtype=np.int64)
        return e, e
    u = np.unique(np.concatenate(codes))
    return u // nq, u % nq


def _ann_kernel(bc, k: int, id_col: str, vec_col: str, dim: int, bands: int, bits: int):
    from filelens.operators.dense import TILE_BYTES, _merge, cosine_matrix

    def run(batches):
        qids, qmat, qnorm, qkeys, P = bc.value
        best = None
        step = max(1, TILE_BYTES // (8 * max(1, len(qids))))

        def named(rows: pa.Table):
            ids_ = pa.array(qids[rows.column("_q").to_numpy()])
            return rows.drop_columns(["_q"]).append_column("query_id", ids_).to_batches()

        for rb in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            if len(qids) == 0:
                continue
            mat, valid = dense_matrix(rb.column(vec_col), dim)
            rkeys = _keys_np(mat, valid, P, bands, bits)
            rows, qs = _match_pairs(rkeys, qkeys)
            if len(rows) == 0:
                continue
            # only rows and queries of some pair are scored, as one product
            ur, ri = np.unique(rows, return_inverse=True)
            uq, qi = np.unique(qs, return_inverse=True)
            sc = cosine_matrix(mat[ur], valid[ur], qmat[uq], qnorm[uq])[ri, qi]
            cand = pa.Table.from_batches([rb.select([id_col]).take(pa.array(rows))]) \
                .append_column("_q", pa.array(qs.astype(np.int32))).append_column("score", pa.array(sc))
            if k is None:  # no cut: nothing is held back
                yield from named(cand)
                continue
            best = cand if best is None else pa.concat_tables([best, cand])
            best = _merge(best, k, id_col, None)
        if best is not None and best.num_rows:
            yield from named(best)
    return run


def ann_topk(corpus: DataFrame, queries: DataFrame, k: int = 5, dim: int | None = None,
             bands: int = DEFAULT_BANDS, bits: int = DEFAULT_BITS, *, id_col: str = "file_id",
             vec_col: str = "embedding", qid_col: str = "query_id", qvec_col: str = "embedding") -> DataFrame:
    """Top-k per query among LSH candidates (rows sharing a band key with the
    query), ranked by exact cosine.

    The query batch -- vectors and band keys, in byte-bounded blocks -- is
    broadcast; each corpus batch computes its own band keys, and of the pairs
    that can still be among a query's k best (:func:`dense._topk_kernel`) those
    that share a key are scored exactly, keeping a running top-k per query. The corpus is scanned once and never shuffled; only
    k rows per query and task reach the final window. Not exact: see
    :func:`ann_recall`."""
    from filelens.operators.dense import DEFAULT_BLOCK_BYTES, _topk_kernel, blockwise, infer_dim, scored_rows
    if dim is None:
        dim = infer_dim(queries, qvec_col)
    if k is not None and k < 0:
        k = None
    P = planes(bands, bits, dim)
    spark = corpus.sparkSession
    corpus = corpus.select(id_col, vec_col)
    source = scored_rows(corpus, id_col, vec_col, dim, 0)  # a row without a vector has no key
    schema = T.StructType([corpus.schema[id_col], T.StructField("score", T.DoubleType()),
                           T.StructField("query_id", T.LongType())])

    def per_block(ids, qmat, qnorm, several=False):
        qkeys = _keys_np(qmat, qnorm > 0, P, bands, bits)
        if k is None:
            bc = spark.sparkContext.broadcast((ids, qmat, qnorm, qkeys, P))
            kernel = _ann_kernel(bc, k, id_col, vec_col, dim, bands, bits)
        else:
            kind = np.int16 if bits < 15 else np.int64
            bc = spark.sparkContext.broadcast((ids, qmat, qnorm, qkeys.astype(kind)))

            def keys(mat, valid):
                return _keys_np(mat, valid, P, bands, bits).astype(kind)

            kernel = _topk_kernel(bc, k, None, id_col, vec_col, [], dim, keys=keys)
        res = source(several).mapInArrow(kernel, schema)
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col))
        ranked = res.withColumn("rank", F.row_number().over(w).cast("bigint"))
        if k is not None:
            ranked = ranked.where(F.col("rank") <= k)
        return ranked.select("query_id", "rank", id_col, "score"), bc

    empty = spark.createDataFrame([], schema).select("query_id", F.lit(0).cast("bigint").alias("rank"),
                                                     id_col, "score")
    return blockwise(queries, qid_col, qvec_col, dim, DEFAULT_BLOCK_BYTES, per_block, empty)


_PAIRS = T.StructType([T.StructField("id_a", T.LongType()), T.StructField("id_b", T.LongType()),
                       T.StructField("score", T.DoubleType())])


def lsh_pairs(vecs: DataFrame, dim: int, threshold: float, bands: int = DEFAULT_BANDS,
              bits: int = DEFAULT_BITS, id_col: str = "file_id", vec_col: str = "embedding",
              max_group_rows: int = 4096) -> DataFrame:
    """Approximate similarity self-join: pairs (id_a < id_b) that share a key
    in at least one band and whose exact cosine is >= ``threshold``.

    Rows are grouped by (band, key). A bucket larger than ``max_group_rows``
    (e.g. near copies, or one source holding a third of the rows) is salted:
    its rows are hashed into s blocks and each unordered block pair is its
    own group, so no group exceeds two blocks. Inside a group one matrix
    product scores the pairs and only those over the threshold are emitted;
    a pair found in several bands is kept once."""
    from filelens.operators.dense import cosine_matrix
    # bucket sizes from the keys alone; the rows to score carry their vector
    # (the keys are recomputed there: one matrix product per batch, cheaper
    # than shuffling keys and vectors to join them back)
    sizes = band_keys(vecs, dim, bands, bits, id_col, vec_col).groupBy("band", "key") \
        .agg(F.count(F.lit(1)).alias("n"))
    rows = band_keys(vecs, dim, bands, bits, id_col, vec_col, with_vectors=True)
    hot = sizes.where(F.col("n") > max_group_rows) \
        .select("band", "key", F.ceil(F.col("n") / F.lit(float(max_group_rows))).cast("int").alias("s"))
    rows = rows.join(maybe_broadcast(hot), ["band", "key"], "left").withColumn("s", F.coalesce("s", F.lit(1)))
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("s")).cast("int"))
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    rows = rows.withColumn("lo", F.least("blk", "x")).withColumn("hi", F.greatest("blk", "x")).drop("x")
    # many buckets share a group: about max_group_rows rows of a band per group
    n = vecs.count()
    parts = max(1, math.ceil(n / max_group_rows))
    rows = rows.withColumn("kp", F.pmod(F.col("key"), F.lit(parts)))

    def score(tbl: pa.Table) -> pa.Table:
        blk = tbl.column("blk").to_numpy()
        key = tbl.column("key").to_numpy()
        lo = int(tbl.column("lo")[0].as_py())
        hi = int(tbl.column("hi")[0].as_py())
        ids = tbl.column("id").to_numpy()
        mat, valid = dense_matrix(tbl.column("v"), dim)
        norms = np.sqrt(np.einsum("ij,ij->i", mat, mat))
        norms[~valid] = 0.0
        order = np.argsort(key, kind="stable")
        bounds = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1], True])
        out_a, out_b, out_s = [], [], []
        for i in range(len(bounds) - 1):
            seg = order[bounds[i]:bounds[i + 1]]
            left = seg[blk[seg] == lo]
            right = seg[blk[seg] == hi]
            if len(left) == 0 or len(right) == 0:
                continue
            s = cosine_matrix(mat[left], valid[left], mat[right], norms[right])
            m = s >= threshold
            li, ri = ids[left], ids[right]
            if lo == hi:
                m &= li[:, None] < ri[None, :]
            r, c = np.nonzero(m)
            a, b = li[r], ri[c]
            out_a.append(np.minimum(a, b))
            out_b.append(np.maximum(a, b))
            out_s.append(s[r, c])
        if not out_a:
            return pa.table({"id_a": pa.array([], pa.int64()), "id_b": pa.array([], pa.int64()),
                             "score": pa.array([], pa.float64())})
        return pa.table({"id_a": np.concatenate(out_a), "id_b": np.concatenate(out_b),
                         "score": np.concatenate(out_s)})

    pairs = rows.groupBy("band", "kp", "lo", "hi").applyInArrow(score, _PAIRS)
    return pairs.groupBy("id_a", "id_b").agg(F.max("score").alias("score"))


def ann_recall(approx: DataFrame, exact: DataFrame, k: int, id_col: str = "file_id") -> DataFrame:
    """Per query: share of the exact top-k ids (there may be fewer than k) the
    approximate list found."""
    e = exact.where(F.col("rank") <= k).select("query_id", id_col)
    a = approx.where(F.col("rank") <= k).select("query_id", id_col, F.lit(1).alias("hit"))
    j = e.join(a, ["query_id", id_col], "left")
    return j.groupBy("query_id").agg(
        F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1)).cast("double"), 6).alias("recall"))


def exact_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document whose content (SHA-256) also occurs in a lower id:
    (doc_id, keep_id, n_copies). Groups are reduced by partial min/count
    aggregates, never collected, so a copy group of any size is fine."""
    h = docs.select(id_col, F.sha2(text_col, 256).alias("h"))
    g = h.groupBy("h").agg(F.min(id_col).alias("keep_id"), F.count(F.lit(1)).alias("n_copies")) \
        .where(F.col("n_copies") > 1)
    return h.join(g, "h").where(F.col(id_col) != F.col("keep_id")).select(id_col, "keep_id", "n_copies", "h") \
        .withColumnRenamed("h", "content_hash")
