"""Exact dense scoring of a corpus against a batch of query vectors.

Plan shape (no cross join, no all-pairs output):

1. The query set is split into blocks whose float64 matrix fits a checked
   byte budget; each block is broadcast once.
2. The corpus is scanned once per block with ``mapInArrow``. Inside a task
   each Arrow batch becomes one NumPy matrix product against the block; a
   running top-k per query (order: rounded score desc, id asc -- a total
   order) is merged batch by batch and emitted when the partition ends.
   So a task emits at most ``k * queries`` rows (plus exact ties at the cut).
3. A final ``row_number`` window per query cuts to k. Because the order is
   total and every partition kept its own best k, the result is exact.

Payload columns (path, name, ...) ride along in the Arrow batches and are
only materialised for kept candidates, so no join back to the corpus.
"""

from __future__ import annotations

import itertools
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filelens.schema import SCORE_DECIMALS

# Budget for one broadcast query block (float64 matrix bytes).
DEFAULT_BLOCK_BYTES = 8 * 1024 * 1024
# Budget for one task's tile of scores (rows x queries, float64): a batch is
# scored in tiles of so many rows, whatever the number of queries.
TILE_BYTES = 32 * 1024 * 1024
# Rows of a batch that are made into vectors at once.
SLICE_ROWS = 2048


def round_half_up(x: np.ndarray, decimals: int = SCORE_DECIMALS) -> np.ndarray:
    """Decimal rounding that matches SQL ROUND (half away from zero)."""
    f = 10.0 ** decimals
    return np.sign(x) * np.floor(np.abs(x) * f + 0.5) / f


def dense_matrix(arr: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Arrow list<float> column -> (n x dim float64 matrix, valid mask).

    Rows that are NULL or whose length is not ``dim`` are left as zeros and
    flagged invalid (they score 0.0 by the cosine rules)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    lengths = arr.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    valid = lengths == dim
    mat = np.zeros((n, dim), dtype=np.float64)
    nv = int(valid.sum())
    if nv:
        sub = arr if nv == n else arr.filter(pa.array(valid))
        vals = sub.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        mat[valid] = vals.reshape(nv, dim)
    return mat, valid


def cosine_matrix(mat: np.ndarray, valid: np.ndarray, qmat: np.ndarray, qnorm: np.ndarray) -> np.ndarray:
    """n x q cosine scores with the zero-norm / invalid / NaN rules, rounded."""
    norms = np.sqrt(np.einsum("ij,ij->i", mat, mat))
    norms[~valid] = 0.0
    with np.errstate(invalid="ignore", divide="ignore"):
        s = mat @ qmat.T
        denom = norms[:, None] * qnorm[None, :]
        s = np.where(denom > 0, s / np.where(denom > 0, denom, 1.0), 0.0)
    s = np.nan_to_num(s, nan=0.0, posinf=0.0, neginf=0.0)
    return round_half_up(s)


def _topk_rows(qidx: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k rows per query under (score desc, id asc)."""
    order = np.lexsort((ids, -score, qidx))
    q_sorted = qidx[order]
    starts = np.r_[0, np.flatnonzero(np.diff(q_sorted)) + 1]
    group_start = np.repeat(starts, np.diff(np.r_[starts, len(q_sorted)]))
    rank = np.arange(len(q_sorted)) - group_start
    return order[rank < k]


def _first_per_run(keys: list[np.ndarray]) -> np.ndarray:
    """Positions (in the given row order) where any of ``keys`` changes."""
    n = len(keys[0])
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    change = np.zeros(n, dtype=bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def _merge(best: pa.Table, k, id_col: str, group_col: str | None) -> pa.Table:
    """Keep, per query, the k best rows (or k best groups by their best row)."""
    q = best.column("_q").to_numpy()
    s = best.column("score").to_numpy()
    ids = best.column(id_col).to_numpy()
    if group_col is not None:
        g = best.column(group_col).to_numpy()
        order = np.lexsort((ids, -s, g, q))
        keep = order[_first_per_run([q[order], g[order]])]
        best = best.take(pa.array(keep))
        if k is None:
            return best
        q, s, g = q[keep], s[keep], g[keep]
        return best.take(pa.array(_topk_rows(q, s, g, k)))
    if k is None:
        return best
    return best.take(pa.array(_topk_rows(q, s, ids, k)))


def _select(s: np.ndarray, k, threshold) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) pairs that can still be in a query's top k of this batch."""
    n = s.shape[0]
    if k is not None and n > k:
        kth = np.partition(s, n - k, axis=0)[n - k]
        keep = s >= kth[None, :]
    else:
        keep = np.ones_like(s, dtype=bool)
    if threshold is not None:
        keep &= np.isfinite(s)
    return np.nonzero(keep)


def float32_slack(dim: int) -> float:
    """How far the product of two unit vectors in float32, by any order of its
    sums, may be from a score rounded to six decimals."""
    return (dim + 8) * 2.0 ** -23 + 10.0 ** -SCORE_DECIMALS


def unit_rows(mat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(float32 rows of length 1, float64 norms); a row without a finite norm
    over 0, whose scores are all 0.0, is zeros with norm 0."""
    with np.errstate(invalid="ignore", over="ignore"):
        norms = np.sqrt(np.einsum("ij,ij->i", mat, mat))
    norms[~np.isfinite(norms)] = 0.0
    good = norms > 0
    unit = np.zeros(mat.shape, dtype=np.float32)
    unit[good] = mat[good] / norms[good, None]
    return unit, norms


def pair_scores(mat: np.ndarray, norms: np.ndarray, qmat: np.ndarray, qnorm: np.ndarray,
                rows: np.ndarray, qs: np.ndarray, chunk: int = 1 << 14) -> np.ndarray:
    """Rounded float64 cosines of the pairs (rows[i], qs[i]) alone."""
    out = np.zeros(len(rows))
    for a in range(0, len(rows), chunk):
        r, q = rows[a:a + chunk], qs[a:a + chunk]
        denom = norms[r] * qnorm[q]
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            out[a:a + chunk] = np.where(denom > 0, np.einsum("ij,ij->i", mat[r], qmat[q]) / np.where(denom > 0, denom, 1.0), 0.0)
    return round_half_up(np.nan_to_num(out, nan=0.0, posinf=0.0, neginf=0.0))


def _topk_kernel(bc, k: int, threshold, id_col: str, vec_col: str, payload: list[str], dim: int,
                 vectorize=None, keys=None):
    """The k best rows per query of a task. A product in float32 tells which
    pairs can still be among them (all others are below the query's k-th score
    so far by more than the product's error); only those are scored in float64,
    so that a pair costs its product and one comparison. ``keys`` (of rows):
    only pairs that share a key in any place count."""
    slack = float32_slack(dim)

    def run(batches):
        qids, qmat, qnorm, *qkeys = bc.value
        nq = len(qids)
        qunit, qnorm = unit_rows(np.where((qnorm > 0)[:, None], qmat, 0.0))
        zero_q = np.flatnonzero(qnorm == 0)  # all rows score 0.0: the k least ids
        floor = np.full(nq, -np.inf if threshold is None else threshold - slack, dtype=np.float32)
        floor[zero_q] = np.inf
        best, held, n_held, lowest, rows_seen = None, [], 0, None, 0
        most = max(1, TILE_BYTES // (4 * max(1, nq)))

        def merged():
            nonlocal best, held, n_held
            best = _merge(pa.concat_tables(([] if best is None else [best]) + held), k, id_col, None)
            held, n_held = [], 0
            q, sc = best.column("_q").to_numpy(), best.column("score").to_numpy()
            last = np.flatnonzero(np.r_[q[1:] != q[:-1], True])
            full = last[np.diff(np.r_[-1, last]) == k]
            floor[q[full]] = np.nextafter((sc[full] - slack).astype(np.float32), np.float32(-np.inf))

        def hold(rb, rows, qs, score):
            nonlocal n_held
            cand = pa.Table.from_batches([rb.select([id_col] + payload).take(pa.array(rows))])
            held.append(cand.append_column("_q", pa.array(qs.astype(np.int32))).append_column("score", pa.array(score)))
            n_held += len(rows)

        def tiles():
            size = 32  # grows: the first rows settle what can still be among the best
            for b in batches:
                at = 0
                while at < b.num_rows:
                    yield b.slice(at, min(size, most, SLICE_ROWS))
                    at += min(size, most, SLICE_ROWS)
                    size = min(2 * size, max(most, SLICE_ROWS))

        for rb in tiles():
            if nq == 0:
                continue
            mat, valid = dense_matrix(rb.column(vec_col), dim) if vectorize is None else vectorize(rb.column(vec_col))
            unit, norms = unit_rows(np.where(valid[:, None], mat, 0.0))
            if keys is None:
                # rows that score 0.0 everywhere count by their ids alone
                zero = np.flatnonzero(norms == 0)
                low = rb.select([id_col] + payload)
                low = pa.Table.from_batches([low]).append_column("_zero", pa.array(norms == 0))
                low = low if len(zero_q) else low.take(pa.array(zero))
                if low.num_rows:
                    lowest = _lowest(low if lowest is None else pa.concat_tables([lowest, low]), k, id_col)
                live = np.flatnonzero(norms > 0)
            else:
                rkeys, live = keys(mat, valid), np.flatnonzero(valid)
            for a in range(0, len(live), most):
                part = live[a:a + most]
                r, qs = np.nonzero(unit[part] @ qunit.T >= floor[None, :])
                r = part[r]
                if keys is not None and len(r):
                    same = np.concatenate([(rkeys[r[i:i + 65536]] == qkeys[0][qs[i:i + 65536]]).any(axis=1)
                                           for i in range(0, len(r), 65536)])
                    r, qs = r[same], qs[same]
                if not len(r):
                    continue
                score = pair_scores(mat, norms, qmat, qnorm, r, qs)
                if threshold is not None:
                    over = score >= threshold
                    r, qs, score = r[over], qs[over], score[over]
                for i in range(0, len(r), 1 << 20):
                    hold(rb, r[i:i + (1 << 20)], qs[i:i + (1 << 20)], score[i:i + (1 << 20)])
                    if rows_seen < 4096 or n_held >= max(65536, k * nq):
                        merged()
            rows_seen += rb.num_rows
        if lowest is not None and (threshold is None or threshold <= 0):
            rows = lowest.combine_chunks().to_batches()[0]
            zero = np.flatnonzero(rows.column("_zero").to_numpy(zero_copy_only=False))
            open_q = np.flatnonzero(floor <= 0)
            for of, qs in ((np.arange(rows.num_rows), zero_q), (zero[:k], open_q)):
                if len(of) and len(qs):
                    of = _k_least(rows, of, k, id_col)
                    hold(rows, np.tile(of, len(qs)), np.repeat(qs, len(of)), np.zeros(len(of) * len(qs)))
        if held:
            merged()
        if best is not None and best.num_rows:
            ids_ = pa.array(qids[best.column("_q").to_numpy()])
            yield from best.drop_columns(["_q"]).append_column("query_id", ids_).to_batches(max_chunksize=SLICE_ROWS)
    return run


def _k_least(rows, of: np.ndarray, k: int, id_col: str) -> np.ndarray:
    ids = rows.column(id_col).to_numpy(zero_copy_only=False)
    return of[np.argsort(ids[of], kind="stable")[:k]]


def _lowest(rows: pa.Table, k: int, id_col: str) -> pa.Table:
    """The k least ids, and the k least of those that score 0.0 everywhere."""
    zero = rows.column("_zero").to_numpy(zero_copy_only=False) if not isinstance(rows.column("_zero"), pa.ChunkedArray) \
        else rows.column("_zero").combine_chunks().to_numpy(zero_copy_only=False)
    of = np.union1d(_k_least(rows, np.arange(rows.num_rows), k, id_col), _k_least(rows, np.flatnonzero(zero), k, id_col))
    return rows.take(pa.array(of))


def _kernel(bc, k, threshold, id_col: str, vec_col: str, payload: list[str], dim: int,
            group_col: str | None = None, vectorize=None):
    def run(batches):
        qids, qmat, qnorm = bc.value
        nq = len(qids)
        best = None  # pa.Table: id, payload..., _q (query index), score
        step = min(SLICE_ROWS, max(1, TILE_BYTES // (8 * max(1, nq))))

        def named(rows: pa.Table):
            ids_ = pa.array(qids[rows.column("_q").to_numpy()])
            return rows.drop_columns(["_q"]).append_column("query_id", ids_).to_batches()

        for rb in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            n = rb.num_rows
            if n == 0 or nq == 0:
                continue
            if vectorize is None:
                mat, valid = dense_matrix(rb.column(vec_col), dim)
            else:
                mat, valid = vectorize(rb.column(vec_col))
            s = cosine_matrix(mat, valid, qmat, qnorm)  # n x nq
            if threshold is not None:
                s = np.where(s >= threshold, s, -np.inf)
            if group_col is None:
                rows, qs = _select(s, k, threshold)
            else:
                # best row per group (score desc, id asc), then groups compete
                ids = rb.column(id_col).to_numpy()
                g = rb.column(group_col).to_numpy()
                order = np.lexsort((ids, g))
                so, go = s[order], g[order]
                starts = _first_per_run([go])
                gm = np.maximum.reduceat(so, starts, axis=0)
                seglen = np.diff(np.r_[starts, n])
                is_max = so == np.repeat(gm, seglen, axis=0)
                pos = np.where(is_max, np.arange(n)[:, None], n)
                first = np.minimum.reduceat(pos, starts, axis=0)
                grows, qs = _select(gm, k, threshold)
                rows = order[first[grows, qs]]
            if len(rows) == 0:
                continue
            cand = rb.select([id_col] + payload).take(pa.array(rows))
            cand = pa.Table.from_batches([cand]).append_column("_q", pa.array(qs.astype(np.int32))) \
                .append_column("score", pa.array(s[rows, qs]))
            if k is None:  # no cut: nothing is held back
                yield from named(cand)
                continue
            best = cand if best is None else pa.concat_tables([best, cand])
            best = _merge(best, k, id_col, group_col)
        if best is not None and best.num_rows:
            yield from named(best)
    return run


def _query_blocks(queries: DataFrame, qid_col: str, qvec_col: str, dim: int, block_bytes: int):
    """Yield bounded blocks of (ids, matrix, norms) from the query DataFrame.

    A block holds at most ``block_bytes`` of float64 query matrix. The first
    block is one bounded collect; when the queries do not fit, they are
    counted and written once to the shared scratch folder partitioned by a
    hash of their id (hash blocks vary a little around the target size), so
    each block is read alone (partition pruning) instead of filtering the
    whole query set once per block."""
    q = queries.select(F.col(qid_col).cast("bigint").alias("qid"), F.col(qvec_col).alias("qvec"))
    max_rows = max(1, block_bytes // (max(dim, 1) * 8))
    # one bounded collect: when it holds every query, it is the only block
    head = q.limit(max_rows + 1).toArrow()
    if head.num_rows <= max_rows:
        reads = [head]
    else:
        from filelens.session import scratch_path
        n = queries.count()
        n_blocks = max(2, math.ceil(n * 5 / (4 * max_rows)))  # blocks average 80% of the budget
        path = scratch_path(queries.sparkSession, "query-blocks")
        q.withColumn("blk", F.pmod(F.xxhash64("qid"), F.lit(n_blocks)).cast("int")) \
            .write.mode("errorifexists").partitionBy("blk").parquet(path)
        stored = queries.sparkSession.read.parquet(path)
        reads = (stored.where(F.col("blk") == b).select("qid", "qvec").toArrow() for b in range(n_blocks))
    for tbl in reads:
        if tbl.num_rows == 0:
            continue
        ids = tbl.column("qid").to_numpy()
        qmat, qvalid = dense_matrix(tbl.column("qvec"), dim)
        qnorm = np.sqrt(np.einsum("ij,ij->i", qmat, qmat))
        qnorm[~qvalid] = 0.0
        yield ids, qmat, qnorm


def blockwise(queries: DataFrame, qid_col: str, qvec_col: str, dim: int, block_bytes: int,
              per_block, empty: DataFrame) -> DataFrame:
    """Union over bounded query blocks of ``per_block(ids, qmat, qnorm)`` ->
    (finished result for the queries of that block, its broadcast). Every
    query lives in exactly one block, so the union needs no further ranking.

    One block: its lazy plan. Several: each block runs as its own job --
    broadcast, corpus scan, per-query cut -- appending to a results table
    in the shared scratch folder, and its broadcast is released before the
    next; the plan never grows with the number of blocks."""
    blocks = _query_blocks(queries, qid_col, qvec_col, dim, block_bytes)
    first = next(blocks, None)
    if first is None:
        return empty
    second = next(blocks, None)
    if second is None:
        return per_block(*first)[0]
    per_block = partial(per_block, several=True)
    from filelens.session import scratch_path
    spark = queries.sparkSession
    path = scratch_path(spark, "block-results")
    for blk in itertools.chain([first, second], blocks):
        df, bc = per_block(*blk)
        df.write.mode("append").parquet(path)
        bc.unpersist()
    return spark.read.parquet(path)


def infer_dim(corpus: DataFrame, vec_col: str) -> int:
    """Most common vector length of the corpus (one aggregate job)."""
    row = (corpus.select(F.size(vec_col).alias("d")).where(F.col("d") > 0)
           .groupBy("d").count().orderBy(F.desc("count"), "d").first())
    return int(row["d"]) if row else 0


def scored_rows(corpus: DataFrame, id_col: str, vec_col: str, dim: int, k: int | None):
    """``several`` -> the rows to score. For several query blocks they are
    written once; of the rows without a vector of ``dim``, which all score 0.0
    for every query, the k least ids are all that can be among the best."""
    from filelens.operators.common import materialized, spread
    made = {}

    def rows(several: bool) -> DataFrame:
        if several not in made:
            if several:
                whole = F.coalesce(F.size(vec_col) == dim, F.lit(False))
                once = materialized(corpus, "scored-rows")
                least = once.where(~whole).orderBy(id_col).limit(k)
                tasks = 2 * corpus.sparkSession.sparkContext.defaultParallelism
                made[several] = materialized(once.where(whole).unionByName(least).repartition(tasks), "scored-vectors")
            else:
                made[several] = spread(corpus)
        return made[several]
    return rows


def dense_search(corpus: DataFrame, queries: DataFrame, k: int | None = 5, *,
                 id_col: str = "file_id", vec_col: str = "embedding",
                 qid_col: str = "query_id", qvec_col: str = "embedding",
                 payload: list[str] | None = None, threshold: float | None = None,
                 dim: int | None = None, block_bytes: int = DEFAULT_BLOCK_BYTES,
                 group_col: str | None = None, vectorize=None) -> DataFrame:
    """Top-k corpus rows per query by cosine (k=None or k<0: no cut).

    ``vectorize`` (optional) turns the Arrow column ``vec_col`` of a batch
    into (n x dim matrix, valid mask) inside the scoring task -- e.g. hashed
    vectors from word lists -- so corpus vectors are never materialised as
    rows between two Python stages.

    With ``group_col`` (a payload column) the unit ranked is the group,
    represented by its best row (score desc, id asc): top-k groups per query.
    Returns query_id, rank, <id_col>, <payload...>, score."""
    payload = list(payload or [])
    if k is not None and k < 0:
        k = None
    spark = corpus.sparkSession
    if dim is None:
        dim = infer_dim(queries, qvec_col)
    from filelens.operators.common import spread
    cols = [id_col] + payload + [vec_col]
    corpus = corpus.select(*cols)
    fields = {f.name: f for f in corpus.schema.fields}
    out_schema = T.StructType([fields[id_col]] + [fields[p] for p in payload] + [
        T.StructField("score", T.DoubleType(), True),
        T.StructField("query_id", T.LongType(), True)])
    if k == 0:
        empty = spark.createDataFrame([], out_schema)
        return empty.select("query_id", F.lit(0).cast("bigint").alias("rank"), id_col, *payload, "score")

    if k is None or vectorize is not None or group_col is not None:
        held = spread(corpus)
        source = lambda several: held
    else:
        source = scored_rows(corpus, id_col, vec_col, dim, k)
    if k is None or group_col is not None:
        def kernel(bc):
            return _kernel(bc, k, threshold, id_col, vec_col, payload, dim, group_col, vectorize)
    else:
        def kernel(bc):
            return _topk_kernel(bc, k, threshold, id_col, vec_col, payload, dim, vectorize)

    def per_block(ids, qmat, qnorm, several=False):
        bc = spark.sparkContext.broadcast((ids, qmat, qnorm))
        res = source(several).mapInArrow(kernel(bc), out_schema)
        if group_col is not None:
            # at most k rows per query and task: one exchange by query serves
            # both windows (best row per group, then top k groups)
            res = res.repartition("query_id")
            wg = Window.partitionBy("query_id", group_col).orderBy(F.desc("score"), F.asc(id_col))
            res = res.withColumn("_g", F.row_number().over(wg)).where(F.col("_g") == 1).drop("_g")
            w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(group_col))
        else:
            w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col))
        res = res.withColumn("rank", F.row_number().over(w).cast("bigint"))
        if k is not None:
            res = res.where(F.col("rank") <= k)
        return res.select("query_id", "rank", id_col, *payload, "score"), bc

    empty = spark.createDataFrame([], out_schema).select(
        "query_id", F.lit(0).cast("bigint").alias("rank"), id_col, *payload, "score")
    return blockwise(queries, qid_col, qvec_col, dim, block_bytes, per_block, empty)


def _rank_kernel(bc, id_col: str, vec_col: str, dim: int, vectorize=None):
    """Per wanted (query, id), how many rows of the task come before it."""
    from filelens.operators.inverted import before_marks

    def run(batches):
        qids, qmat, qnorm, marks = bc.value
        count = {}
        step = min(SLICE_ROWS, max(1, TILE_BYTES // (8 * max(1, len(qids)))))
        for rb in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            mat, valid = dense_matrix(rb.column(vec_col), dim) if vectorize is None else vectorize(rb.column(vec_col))
            s, ids = cosine_matrix(mat, valid, qmat, qnorm), rb.column(id_col).to_numpy(zero_copy_only=False)
            for q, (at, doc) in marks.items():
                n = before_marks(at, doc, s[:, q], ids)
                count[q] = n if q not in count else count[q] + n
        for q, n in count.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), qids[q])), pa.array(marks[q][1]), pa.array(n)],
                                             ["query_id", "doc", "before"])
    return run


def dense_ranks(corpus: DataFrame, queries: DataFrame, wanted: DataFrame, *, id_col: str = "file_id",
                vec_col: str = "embedding", qid_col: str = "query_id", qvec_col: str = "embedding",
                dim: int | None = None, block_bytes: int = DEFAULT_BLOCK_BYTES, vectorize=None) -> DataFrame:
    """(query_id, doc, rank): the exact rank of each wanted (query_id, doc) in
    the whole list of :func:`dense_search`, without making the list. One scan
    of the corpus per query block counts, per wanted document, those before
    it; a task emits one number for each. Few documents per query are meant:
    those of a query block are held by a task. ``vectorize``: as there."""
    from filelens.operators.common import materialized, maybe_broadcast, spread
    spark = corpus.sparkSession
    if dim is None:
        dim = infer_dim(queries, qvec_col)
    src = spread(corpus.select(id_col, vec_col))
    held = queries.select(F.col(qid_col).cast("bigint").alias("query_id"), F.col(qvec_col).alias("_q"))
    own = corpus.select(F.col(id_col).alias("doc"), F.col(vec_col).alias("_v"))
    pairs = own.join(maybe_broadcast(wanted.select("query_id", "doc").distinct()), "doc").join(held, "query_id")

    def score(batches):
        for rb in batches:
            a, va = dense_matrix(rb.column("_v"), dim) if vectorize is None else vectorize(rb.column("_v"))
            b, vb = dense_matrix(rb.column("_q"), dim)
            norm = np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)) * (va & vb)
            with np.errstate(invalid="ignore", divide="ignore"):
                s = np.where(norm > 0, np.einsum("ij,ij->i", a, b) / np.where(norm > 0, norm, 1.0), 0.0)
            yield pa.RecordBatch.from_arrays(
                [rb.column("query_id"), rb.column("doc"),
                 pa.array(round_half_up(np.nan_to_num(s, nan=0.0, posinf=0.0, neginf=0.0)))], ["query_id", "doc", "score"])

    id_type = corpus.schema[id_col].dataType.simpleString()
    marks = materialized(pairs.select("query_id", "doc", "_q", "_v").mapInArrow(
        score, f"query_id bigint, doc {id_type}, score double"), "wanted-scores")
    schema = f"query_id bigint, doc {id_type}, before bigint"

    def per_block(ids, qmat, qnorm, several=False):
        mine = marks.join(F.broadcast(spark.createDataFrame(pa.table({"query_id": ids}))), "query_id").toArrow()
        at = {}
        place = {q: i for i, q in enumerate(ids.tolist())}
        for q, part in _grouped(mine):
            at[place[q]] = part.column("score").to_numpy(), part.column("doc").to_numpy(zero_copy_only=False)
        bc = spark.sparkContext.broadcast((ids, qmat, qnorm, at))
        counted = src.mapInArrow(_rank_kernel(bc, id_col, vec_col, dim, vectorize), schema)
        return counted.groupBy("query_id", "doc").agg((F.sum("before") + 1).alias("rank")), bc

    empty = spark.createDataFrame([], f"query_id bigint, doc {id_type}, rank bigint")
    return blockwise(queries, qid_col, qvec_col, dim, block_bytes, per_block, empty)


def _grouped(rows: pa.Table):
    """(query id, its rows by score) of a table of marks."""
    rows = rows.sort_by([("query_id", "ascending"), ("score", "ascending")])
    q = rows.column("query_id").to_numpy()
    starts = _first_per_run([q])
    for a, z in zip(starts, np.r_[starts[1:], len(q)]):
        yield int(q[a]), rows.slice(a, z - a)
