"""Vector expressions: dot, norms, cosine, L2 normalisation, pooling, blob codec.

All arithmetic runs in DOUBLE on Spark's higher-order array functions, so it
stays in the JVM. Scores are rounded to ``SCORE_DECIMALS`` before anyone
orders by them: float sums differ with summation order, the rounded value
plus an id tie-break gives a total, reproducible order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filelens.schema import L2_EPS, SCORE_DECIMALS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    """Sum of a[i]*b[i] in DOUBLE (caller guarantees equal lengths)."""
    a, b = _c(a), _c(b)
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def sq_norm(v) -> Column:
    v = _c(v)
    return F.aggregate(v, F.lit(0.0).cast("double"),
                       lambda acc, x: acc + x.cast("double") * x.cast("double"))


def norm(v) -> Column:
    return F.sqrt(sq_norm(v))


def cosine(a, b, a_norm=None, b_norm=None, decimals: int | None = SCORE_DECIMALS) -> Column:
    """Cosine similarity with the original tool's edge rules.

    * either side NULL, or lengths differ  -> 0.0
    * either squared norm is 0 (so also two empty vectors) -> 0.0
    * otherwise dot / (|a| * |b|), not clamped; NaN -> 0.0
    Pre-computed norms may be passed to avoid re-evaluating them per pair.
    """
    a, b = _c(a), _c(b)
    na = _c(a_norm) if a_norm is not None else norm(a)
    nb = _c(b_norm) if b_norm is not None else norm(b)
    raw = (F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)), F.lit(0.0))
           .when((na == 0) | (nb == 0) | na.isNull() | nb.isNull(), F.lit(0.0))
           .otherwise(dot(a, b) / (na * nb)))
    raw = F.nanvl(raw, F.lit(0.0))
    return F.round(raw, decimals) if decimals is not None else raw


def l2_normalize(v, as_float: bool = True) -> Column:
    """x / sqrt(max(sum(x^2), 1e-12)) element-wise; FLOAT elements unless
    ``as_float`` is False (then DOUBLE, for exact downstream scores)."""
    v = _c(v)
    denom = F.sqrt(F.greatest(sq_norm(v), F.lit(L2_EPS)))
    t = "float" if as_float else "double"
    # The divisor enters as an array argument so it is computed once per row;
    # referenced inside the lambda it would be re-aggregated per element.
    return F.zip_with(v, F.array_repeat(denom, F.size(v)), lambda x, d: (x.cast("double") / d).cast(t))


def masked_mean(token_vectors, mask) -> Column:
    """Mean of the rows of ``token_vectors`` (array<array<float>>) whose mask
    is non-zero; divisor is the number of unmasked rows, 1 if there are none.
    Element type DOUBLE; the output width is that of the first token."""
    tv, m = _c(token_vectors), _c(mask)
    width = F.coalesce(F.size(F.element_at(tv, 1)), F.lit(0))
    kept = F.filter(F.arrays_zip(tv.alias("v"), m.alias("m")), lambda s: s["m"] != 0)
    n = F.greatest(F.size(kept), F.lit(1)).cast("double")
    zero = F.array_repeat(F.lit(0.0).cast("double"), width)
    summed = F.aggregate(kept, zero, lambda acc, s: F.zip_with(
        acc, s["v"], lambda x, y: x + F.coalesce(y.cast("double"), F.lit(0.0))))
    divided = F.zip_with(summed, F.array_repeat(n, width), lambda x, d: x / d)
    return F.when(tv.isNull(), F.lit(None)).otherwise(divided)


def vector_dim(v) -> Column:
    """Length of a vector, 0 for NULL (a missing vector reads as empty)."""
    return F.coalesce(F.size(_c(v)), F.lit(0)).cast("bigint")


# ---------------------------------------------------------------------------
# Vector <-> bytes (import/export of existing stores). Little-endian float32.
# Arrow-batched; no per-row Python.
# ---------------------------------------------------------------------------

@F.pandas_udf(T.BinaryType())
def vector_to_blob(v: pd.Series) -> pd.Series:
    out = []
    for x in v:
        if x is None:
            out.append(None)
        else:
            out.append(np.asarray(x, dtype="<f4").tobytes())
    return pd.Series(out, dtype=object)


_BLOB_OUT = T.StructType([
    T.StructField("embedding", T.ArrayType(T.FloatType()), True),
    T.StructField("blob_status", T.StringType(), True),
])


@F.pandas_udf(_BLOB_OUT)
def blob_to_vector(b: pd.Series) -> pd.DataFrame:
    """bytes -> float32 vector. NULL or 0 bytes -> empty ("empty"); a length
    that is not a multiple of 4 -> empty with status "bad_length"."""
    vecs, status = [], []
    for x in b:
        if x is None or len(x) == 0:
            vecs.append([])
            status.append("empty")
        elif len(x) % 4 != 0:
            vecs.append([])
            status.append("bad_length")
        else:
            vecs.append(np.frombuffer(bytes(x), dtype="<f4").tolist())
            status.append("ok")
    return pd.DataFrame({"embedding": vecs, "blob_status": status})
