"""Encoding and embedding jobs: vocabulary, fixed-length encodings,
hashed-term embeddings, masked mean pooling, centroids, vector health."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filelens.functions import text as X
from filelens.functions import vectors as V
from filelens.operators.common import (BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS, global_rank, materialized,
                                       maybe_broadcast, row_bytes, spread)
from filelens.schema import EMBEDDING_DIM, MAX_SEQ_LEN


def vocab_build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Vocabulary of the corpus: (tok, cnt, token_id). Ids follow the order
    (count desc, token asc) and start after the reserved ids (pad, cls,
    sep, unk). Counting is partial-then-final; the ranking is a range sort."""
    counts = (spread(docs, id_col).select(F.explode(X.words(text_col)).alias("tok"))
              .groupBy("tok").agg(F.count(F.lit(1)).alias("cnt")))
    ranked = global_rank(counts, [F.desc("cnt"), F.asc("tok")], "r")
    return ranked.select("tok", "cnt", (F.col("r") + X.FIRST_WORD_ID - 1).cast("bigint").alias("token_id"))


def encode_windows(docs: DataFrame, vocab: DataFrame, n: int = MAX_SEQ_LEN,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts into fixed-length windows.

    Each window holds up to n-2 consecutive words as [CLS] ids [SEP], padded
    with 0 to exactly n; the mask is 1 on real tokens. A text of w words
    gives ceil(w/(n-2)) windows (an empty or NULL text gives one window of
    [CLS][SEP]); a word outside the vocabulary is [UNK].
    Output: id, window, input_ids, attention_mask (both length n).

    Encoding is per-row work: when the vocabulary passes the broadcast check
    it is an Arrow-batched map with no shuffle (words looked up once per
    distinct word, ids scattered into the window matrix by NumPy);
    otherwise blocks of texts look up their distinct words in a join, with the
    same rows (:func:`_encode_windows_joined`)."""
    v = vocab.select("tok", "token_id")
    nv = v.count()
    if nv > BROADCAST_MAX_ROWS or nv * row_bytes(v.schema) > BROADCAST_MAX_BYTES:
        return _encode_windows_joined(docs, vocab, n, id_col, text_col)
    vt = v.toArrow()
    bv = docs.sparkSession.sparkContext.broadcast(
        dict(zip(vt.column("tok").to_pylist(), vt.column("token_id").to_pylist())))
    src = spread(docs, id_col).select(F.col(id_col).alias("_id"), X.words(text_col).alias("_ws"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           T.StructField("window", T.LongType()),
                           T.StructField("input_ids", T.ArrayType(T.LongType())),
                           T.StructField("attention_mask", T.ArrayType(T.LongType()))])

    def run(batches):
        voc = bv.value

        def ids_of(words):
            return np.array([voc.get(w, X.UNK_ID) for w in words.to_pylist()], dtype=np.int64)

        for rb in slices(batches):
            yield _windows(rb, n, id_col, ids_of)

    return src.mapInArrow(run, schema)


# Texts of a block, a power of two, whose distinct words are looked up together.
ENCODE_TEXTS = 1 << 10


def _windows(rb: pa.RecordBatch, n: int, id_col: str, ids_of) -> pa.RecordBatch:
    """Windows of a batch (id, words); ``ids_of`` gives the ids of distinct words."""
    rows, per = rb.num_rows, n - 2
    ws = rb.column(1)
    lens = pc.fill_null(pc.list_value_length(ws), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    enc = pc.dictionary_encode(pc.list_flatten(ws))
    tmap = ids_of(enc.dictionary)
    tid = tmap[enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)] if len(tmap) else \
        np.zeros(0, dtype=np.int64)
    n_win = np.maximum((lens + per - 1) // per, 1)
    win_off = np.r_[0, np.cumsum(n_win)[:-1]]
    n_all = int(n_win.sum())
    row = np.repeat(np.arange(rows, dtype=np.int64), lens)
    pos = np.arange(len(tid), dtype=np.int64) - np.repeat(np.r_[0, np.cumsum(lens)[:-1]], lens)
    w = win_off[row] + pos // per
    ids = np.zeros((n_all, n), dtype=np.int64)
    ids[:, 0] = X.CLS_ID
    ids[w, 1 + pos % per] = tid
    cnt = np.bincount(w, minlength=n_all)
    ids[np.arange(n_all), cnt + 1] = X.SEP_ID
    mask = (np.arange(n)[None, :] < (cnt + 2)[:, None]).astype(np.int64)
    offs = pa.array(np.arange(n_all + 1, dtype=np.int32) * n)
    return pa.RecordBatch.from_arrays([
        rb.column(0).take(pa.array(np.repeat(np.arange(rows), n_win))),
        pa.array(np.arange(n_all, dtype=np.int64) - np.repeat(win_off, n_win)),
        pa.ListArray.from_arrays(offs, pa.array(ids.ravel())),
        pa.ListArray.from_arrays(offs, pa.array(mask.ravel()))],
        [id_col, "window", "input_ids", "attention_mask"])


def _encode_windows_joined(docs: DataFrame, vocab: DataFrame, n: int = MAX_SEQ_LEN,
                           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`encode_windows` for a vocabulary that is too large to broadcast.
    Texts are dealt to blocks of ``ENCODE_TEXTS``; a block asks for the id of
    each of its distinct words once, and its texts meet the answers in one
    group: a text is shuffled once, as its words, and no row is made per
    word of a text."""
    texts = materialized(spread(docs, id_col).select(
        F.col(id_col).alias("_id"), X.words(text_col).alias("_ws"), F.monotonically_increasing_id().alias("_at")), "encode-words")
    block = F.shiftright("_at", ENCODE_TEXTS.bit_length() - 1)
    texts = texts.select("_id", "_ws", block.alias("block"))
    asked = texts.select("block", F.explode(F.array_distinct("_ws")).alias("tok")).distinct()
    answers = asked.join(vocab.select("tok", "token_id"), "tok").select(
        F.col("block").alias("of_block"), "tok", F.col("token_id").cast("bigint").alias("token_id"))
    texts = texts.select("_id", "_ws", (F.col("block") + 0).alias("block"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           T.StructField("window", T.LongType()),
                           T.StructField("input_ids", T.ArrayType(T.LongType())),
                           T.StructField("attention_mask", T.ArrayType(T.LongType()))])

    def encode(of_block: pa.Table, known: pa.Table) -> pa.Table:
        words, token_ids = known.column("tok").combine_chunks(), known.column("token_id").to_numpy()

        def ids_of(distinct):
            at = pc.index_in(distinct, value_set=words)
            if not len(token_ids):
                return np.full(len(distinct), X.UNK_ID, dtype=np.int64)
            return np.where(at.is_valid().to_numpy(zero_copy_only=False),
                            token_ids[at.fill_null(0).to_numpy(zero_copy_only=False)], X.UNK_ID).astype(np.int64)

        of_block = of_block.select(["_id", "_ws"]).combine_chunks()
        return pa.Table.from_batches([_windows(rb, n, id_col, ids_of) for rb in slices(of_block.to_batches())])

    return texts.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(encode, schema)


def hashed_terms(docs: DataFrame, dim: int = EMBEDDING_DIM, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Sparse hashed-term vectors of whole texts: (id, bucket, weight) with
    weight = tf / ||tf||2 (feature hashing of md5 buckets), one row per
    non-zero bucket. The same per-row map as :func:`hashed_embed` (no
    shuffle), emitting only the non-zero entries."""
    src = spread(docs, id_col).select(F.col(id_col).alias("_id"), X.words(text_col).alias("_ws"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           T.StructField("bucket", T.LongType()), T.StructField("weight", T.DoubleType())])

    def run(batches):
        for rb in slices(batches):
            vec = hashed_matrix(rb.column(1), dim)
            r, c = np.nonzero(vec)
            yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(r)), pa.array(c.astype(np.int64)),
                                              pa.array(vec[r, c])], [id_col, "bucket", "weight"])

    return src.mapInArrow(run, schema)


# Texts that a task makes into words, vectors or windows at once.
SLICE_TEXTS = 1000


def slices(batches, rows: int = SLICE_TEXTS):
    """The batches in pieces of so many rows: what a task holds beside a batch
    grows with the piece."""
    for rb in batches:
        for i in range(0, rb.num_rows, rows):
            yield rb.slice(i, rows)


def hashed_counts(lens: np.ndarray, words: pa.Array, codes: np.ndarray, dim: int) -> np.ndarray:
    """n x dim counts of hashed terms for coded words
    (:func:`filelens.functions.text.coded_words`)."""
    n = len(lens)
    rows = np.repeat(np.arange(n, dtype=np.int64), lens)
    return np.bincount(rows * dim + X.hash_buckets(words, dim)[codes], minlength=n * dim).reshape(n, dim)


def unit_counts(counts: np.ndarray) -> np.ndarray:
    """Rows of counts, divided by their length (zero rows stay zero)."""
    tf = counts.astype(np.float64)
    nrm = np.sqrt((tf * tf).sum(axis=1))[:, None]
    return np.divide(tf, nrm, out=np.zeros_like(tf), where=nrm > 0)


def hashed_matrix(ws: pa.Array, dim: int) -> np.ndarray:
    """n x dim unit rows of hashed-term counts for an Arrow list<string>
    column of words (NULL or empty lists give zero rows). The distinct words
    of a batch are hashed once."""
    return unit_counts(hashed_counts(*X.coded_words(ws), dim))


def packed_counts(counts: np.ndarray) -> pa.Array:
    """Rows of counts as one binary value each (32-bit numbers), which a table
    stores and hands on faster than a list of numbers."""
    n, dim = counts.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * (4 * dim)),
                                                  pa.py_buffer(np.ascontiguousarray(counts, dtype="<i4"))])


def counts_vectorizer(dim: int = EMBEDDING_DIM):
    """As :func:`hashed_vectorizer`, for a column of :func:`packed_counts`."""
    def vectorize(packed: pa.Array):
        n, packed = len(packed), packed.cast(pa.binary())
        if not n:
            return np.zeros((0, dim)), np.ones(0, dtype=bool)
        _, offsets, data = packed.buffers()
        first = np.frombuffer(offsets, np.int32)[packed.offset]
        return unit_counts(np.frombuffer(data, "<i4", n * dim, first).reshape(n, dim)), np.ones(n, dtype=bool)

    return vectorize


def hashed_vectorizer(dim: int = EMBEDDING_DIM):
    """In-task vectorizer for :func:`filelens.operators.dense.dense_search`:
    an Arrow list<string> column of words -> (hashed unit vectors, valid)."""
    def vectorize(ws: pa.Array):
        m = hashed_matrix(ws, dim)
        return m, np.ones(len(m), dtype=bool)

    return vectorize


def hashed_embed(docs: DataFrame, dim: int = EMBEDDING_DIM, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Dense unit vectors (id, embedding array<double> of ``dim``): term
    counts of the md5 buckets of every word of the whole text, divided by
    their L2 norm; a text with no word gets the zero vector.

    Embedding a text is a per-row map, so the plan has no shuffle: the JVM
    splits words (same expression as everywhere else), and inside each
    Arrow batch the distinct words are dictionary-encoded, each distinct
    word is hashed once, and one ``bincount`` over
    (row, bucket) gives the counts of the whole batch. The sparse
    (id, bucket, weight) form of the same vectors is :func:`hashed_terms`."""
    src = spread(docs, id_col).select(F.col(id_col).alias("_id"), X.words(text_col).alias("_ws"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for rb in slices(batches):
            n = rb.num_rows
            vec = hashed_matrix(rb.column(1), dim)
            emb = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(vec.ravel()))
            yield pa.RecordBatch.from_arrays([rb.column(0), emb], [id_col, "embedding"])

    return src.mapInArrow(run, schema)


# Token-vector tables up to this size are broadcast to the pooling map.
POOL_TABLE_MAX_BYTES = 256 * 1024 * 1024
# (document, token) pairs weighed per NumPy step inside one Arrow batch.
POOL_CHUNK_PAIRS = 65536


def masked_mean_pool(docs: DataFrame, token_table: DataFrame, n_tokens: int,
                     id_col: str = "doc_id", text_col: str = "text",
                     tok_id_col: str = "vec_id", tok_vec_col: str = "embedding") -> DataFrame:
    """Document vectors by masked mean pooling of token vectors.

    Every word of a text is a real (mask 1) token whose vector is the row of
    ``token_table`` with id = md5 bucket of the word mod ``n_tokens``; pad
    positions carry mask 0 and do not count. The mean divides by the number
    of real tokens (1 when there are none); a word whose id has no table row
    counts in the divisor and adds nothing. Result: (id, pos, value), one
    row per vector element, for the documents with at least one token found
    in the table.

    Pooling is per-row work. When the table is small enough to broadcast
    (checked: bytes of its vectors, one vector length, unique ids) it
    runs as an Arrow-batched map with no shuffle: per batch, the (document,
    token) pairs are counted once and the weighted token vectors are summed
    per document by a sort-and-reduce. Otherwise the same result comes from
    a shuffle plan (:func:`_masked_mean_pool_joined`)."""
    tb = token_table.select(F.col(tok_id_col).cast("bigint").alias("tid"), F.col(tok_vec_col).alias("tv"))
    st = tb.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tid").alias("nd"),
                F.count_if(F.col("tv").isNull()).alias("n_null"),
                F.min(F.size("tv")).alias("dmin"), F.max(F.size("tv")).alias("dmax")).first()
    dim = st["dmax"] or 0
    # floats stay floats until they are added up
    kind = np.float32 if isinstance(tb.schema["tv"].dataType.elementType, T.FloatType) else np.float64
    fits = (st["n"] == st["nd"] and st["n_null"] == 0 and st["dmin"] == dim and dim > 0
            and max(st["n"], n_tokens) * dim * np.dtype(kind).itemsize <= POOL_TABLE_MAX_BYTES)
    if not fits:
        return _masked_mean_pool_joined(docs, token_table, n_tokens, id_col, text_col, tok_id_col, tok_vec_col)
    tbl = tb.where((F.col("tid") >= 0) & (F.col("tid") < n_tokens)).toArrow()
    mat = np.zeros((n_tokens, dim), dtype=kind)
    present = np.zeros(n_tokens, dtype=bool)
    if tbl.num_rows:
        tids = tbl.column("tid").to_numpy()
        mat[tids] = tbl.column("tv").combine_chunks().flatten().to_numpy(
            zero_copy_only=False).astype(kind, copy=False).reshape(len(tids), dim)
        present[tids] = True
    bc = docs.sparkSession.sparkContext.broadcast((mat, present))
    src = spread(docs, id_col).select(F.col(id_col).alias("_id"), X.words(text_col).alias("_ws"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           T.StructField("_v", T.ArrayType(T.DoubleType()))])

    def run(batches):
        m, pres = bc.value
        for rb in slices(batches):
            n = rb.num_rows
            lens, words, codes = X.coded_words(rb.column(1))
            tid = X.hash_buckets(words, n_tokens)[codes]
            rows = np.repeat(np.arange(n, dtype=np.int64), lens)
            keys, cnt = np.unique(rows * n_tokens + tid, return_counts=True)  # sorted by row
            ur, ut = keys // n_tokens, keys % n_tokens
            hit = pres[ut]
            ur, ut, cnt = ur[hit], ut[hit], cnt[hit]
            sums = np.zeros((n, m.shape[1]), dtype=np.float64)
            for lo in range(0, len(ur), POOL_CHUNK_PAIRS):
                r = ur[lo:lo + POOL_CHUNK_PAIRS]
                contrib = cnt[lo:lo + POOL_CHUNK_PAIRS, None].astype(np.float64) * m[ut[lo:lo + POOL_CHUNK_PAIRS]]
                starts = np.r_[0, np.flatnonzero(np.diff(r)) + 1]
                sums[r[starts]] += np.add.reduceat(contrib, starts, axis=0)
            keep = np.zeros(n, dtype=bool)
            keep[ur] = True
            vec = sums / np.maximum(lens, 1)[:, None].astype(np.float64)
            sel = np.flatnonzero(keep)
            if len(sel) == 0:
                continue
            d = m.shape[1]
            emb = pa.ListArray.from_arrays(pa.array(np.arange(len(sel) + 1, dtype=np.int32) * d),
                                           pa.array(vec[sel].ravel()))
            yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(sel)), emb], [id_col, "_v"])

    pooled = src.mapInArrow(run, schema)
    return pooled.select(id_col, F.posexplode("_v").alias("pos", "value")) \
        .select(id_col, F.col("pos").cast("bigint").alias("pos"), "value")


def _masked_mean_pool_joined(docs: DataFrame, token_table: DataFrame, n_tokens: int,
                             id_col: str, text_col: str, tok_id_col: str, tok_vec_col: str) -> DataFrame:
    """Shuffle form of :func:`masked_mean_pool` for token tables too large to
    broadcast: tokens are counted per (document, token id), so the
    token-vector join sees each distinct token once per document."""
    toks = (spread(docs, id_col).select(id_col, F.explode(X.words(text_col)).alias("tok"))
            .select(id_col, X.hash_bucket("tok", n_tokens).alias("tid")))
    counts = toks.groupBy(id_col, "tid").agg(F.count(F.lit(1)).alias("c"))
    n_real = counts.groupBy(id_col).agg(F.sum("c").alias("n_real"))
    table = token_table.select(F.col(tok_id_col).alias("tid"), F.col(tok_vec_col).alias("tv"))
    dim = table.agg(F.max(F.size("tv"))).first()[0] or 0
    table = maybe_broadcast(table, width=16 + 8 * max(dim, 1))
    elems = counts.join(table, "tid").select(id_col, "c", F.posexplode("tv").alias("pos", "x"))
    sums = elems.groupBy(id_col, "pos").agg(F.sum(F.col("c") * F.col("x").cast("double")).alias("s"))
    return sums.join(n_real, id_col).select(
        id_col, F.col("pos").cast("bigint").alias("pos"),
        (F.col("s") / F.greatest(F.col("n_real"), F.lit(1)).cast("double")).alias("value"))


def centroids(vecs: DataFrame, group_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Mean vector per group as (group, pos, value): posexplode then a
    partial/final average per (group, element) -- a hot group is spread over
    all map tasks before the shuffle, so it cannot land in one task whole."""
    return (vecs.select(group_col, F.posexplode(vec_col).alias("pos", "x"))
            .groupBy(group_col, "pos").agg(F.avg(F.col("x").cast("double")).alias("value"))
            .withColumn("pos", F.col("pos").cast("bigint")))


def vector_health(vecs: DataFrame, expected_dim: int, id_col: str = "file_id",
                  vec_col: str = "embedding", tol: float = 1e-2) -> DataFrame:
    """Per-vector checks: status in ok / missing / empty / bad_dim /
    not_unit / nan; files with a non-ok status must be re-embedded."""
    v = F.col(vec_col)
    d = V.vector_dim(v)
    n = V.norm(v)
    has_nan = F.exists(v, lambda x: F.isnan(x))
    status = (F.when(v.isNull(), "missing")
              .when(F.size(v) == 0, "empty")
              .when(d != expected_dim, "bad_dim")
              .when(has_nan, "nan")
              .when(F.abs(n - 1.0) > tol, "not_unit")
              .otherwise("ok"))
    return vecs.select(id_col, d.alias("dim"), F.round(n, 6).alias("norm"), status.alias("status"))
