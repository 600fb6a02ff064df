"""Masked mean pooling of encoded windows: one vector per window.

An encoding is the ids of a window's tokens and a mask of the same length; the
tokens with a mask other than 0 count. Where there is no mask, it follows from
the ids (padding is 0). Ids or masks of another length than the window's are a
failed encoding, whose vector is null.

One plan at any size: windows are dealt to blocks of a bounded number of
tokens. Each block asks for the vector of each of its distinct tokens once, a
shuffle join answers, and a block's windows meet its vectors in one group. What
is shuffled is the ids of the windows and a vector per block and distinct token,
not one per token; a token that is in every window, such as the one that starts
each, has one row per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelens.functions import text as X
from filelens.operators.common import materialized
from filelens.operators.dense import dense_matrix
from filelens.schema import MAX_SEQ_LEN

HOT_ROWS = 1 << 21     # tokens that meet their vectors in one group
_CHUNK = 1 << 15       # tokens whose vectors are added up at once


def checked_windows(windows: DataFrame, n: int = MAX_SEQ_LEN) -> DataFrame:
    """``windows`` (input_ids, attention_mask and others) with ``encoding``,
    struct(input_ids, attention_mask, token_type_ids), in place of both: the
    mask is that of the ids where it is null, and an encoding whose parts do
    not have exactly ``n`` entries is null."""
    mask = F.coalesce(F.col("attention_mask"), X.mask_from_ids("input_ids"))
    others = [c for c in windows.columns if c not in ("input_ids", "attention_mask", "encoding")]
    return windows.select(*others, X.checked_encoding("input_ids", mask, n).alias("encoding"))


def _sums_of(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(rows[order], first, axis=0)


def _vectors(rows: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))


def _pooled(dim: int):
    """(block, _w, ids) and (of_block, tid, v) of a block -> (_w, total)."""
    def run(windows: pa.Table, answers: pa.Table) -> pa.Table:
        of, ids = windows.column("_w").to_numpy(), windows.column("ids").combine_chunks()
        total = np.zeros((len(of), dim))
        if len(of) and len(answers):
            # a token with several rows in the table adds all of them
            known, vectors = _sums_of(answers.column("tid").to_numpy(), dense_matrix(answers.column("v"), dim)[0])
            tid = ids.flatten().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(known, tid), len(known) - 1)
            row = np.repeat(np.arange(len(of)), ids.value_lengths().to_numpy(zero_copy_only=False))
            hit = known[at] == tid
            at, row = at[hit], row[hit]
            for i in range(0, len(at), _CHUNK):
                rows, sums = _sums_of(row[i:i + _CHUNK], vectors[at[i:i + _CHUNK]])
                total[rows] += sums
        return pa.table([pa.array(of), _vectors(total)], names=["_w", "total"])
    return run


def pool_windows(windows: DataFrame, token_vectors: DataFrame, n: int = MAX_SEQ_LEN, tok_id_col: str = "token_id",
                 tok_vec_col: str = "embedding", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``windows`` (input_ids, attention_mask, any others) with ``status`` (ok,
    failed), ``n_real`` (tokens that count; null if failed) and ``embedding``:
    the sum of the vectors of the tokens that count over their number (1 if
    there are none), null if failed. ``token_vectors`` has a vector per token
    id; a token without one, or with one of another length than most of the
    table has, counts in the divisor and adds nothing."""
    others = [c for c in windows.columns if c not in ("input_ids", "attention_mask", "encoding")]
    mask = F.col("encoding.attention_mask")
    tokens = F.filter(F.arrays_zip(F.col("encoding.input_ids").alias("tid"), mask.alias("m")), lambda t: t["m"] != 0)
    whole = F.col("encoding").isNotNull()
    # blocks of a power of two of windows, of the rows that a task wrote in turn
    shift = max(0, (hot_rows // max(1, n)).bit_length() - 1)
    checked = materialized(checked_windows(windows, n).withColumn("_w", F.monotonically_increasing_id()).select(
        *others, "_w", whole.alias("_ok"), F.when(whole, F.size(tokens).cast("bigint")).alias("n_real"),
        F.when(whole, F.transform(tokens, lambda t: t["tid"].cast("bigint"))).alias("_ids")), "pool-windows")
    table = token_vectors.select(F.col(tok_id_col).cast("bigint").alias("tid"), F.col(tok_vec_col).alias("v"))
    usual = table.groupBy(F.size("v").alias("dim")).count().where("dim > 0").orderBy(F.desc("count"), "dim").first()
    dim = usual["dim"] if usual else 0
    real = checked.where("n_real > 0").select(F.shiftright("_w", shift).alias("block"), "_w", F.col("_ids").alias("ids"))
    asked = real.select("block", F.explode(F.array_distinct("ids")).alias("tid")).where("tid is not null").distinct()
    answers = asked.join(table.where(F.size("v") == dim), "tid").select(F.col("block").alias("of_block"), "tid", "v")
    real = real.select((F.col("block") + 0).alias("block"), "_w", F.filter("ids", lambda i: i.isNotNull()).alias("ids"))
    sums = real.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(
        _pooled(dim), "_w bigint, total array<double>") if dim else real.select("_w", F.array().cast("array<double>").alias("total"))
    divisor = F.greatest(F.col("n_real"), F.lit(1)).cast("double")
    mean = F.zip_with("total", F.array_repeat(divisor, dim), lambda x, d: x / d)
    return checked.drop("_ids").join(sums, "_w", "left").select(
        *others, F.when(F.col("_ok"), "ok").otherwise("failed").alias("status"), "n_real",
        F.when(F.col("_ok"), F.coalesce(mean, F.array_repeat(F.lit(0.0), dim))).alias("embedding"))
