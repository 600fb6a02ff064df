import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from filelens.functions import vectors as V


def _cos(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    return df.select(V.cosine("a", "b").alias("s")).first()["s"]


@pytest.mark.parametrize("a,b,want", [
    ([1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 4.0], 0.0),   # lengths differ
    ([0.0, 0.0], [1.0, 2.0], 0.0),                  # zero vector
    (None, [1.0, 2.0], 0.0),                        # NULL
    ([], [], 0.0),                                  # both empty
    ([1.0, 0.0], [-1.0, 0.0], -1.0),                # opposite
    ([1.0, float("nan")], [1.0, 1.0], 0.0),         # NaN element
    ([1.0, 1.0], [1.0, 0.0], round(1 / math.sqrt(2), 6)),
])
def test_cosine_edges(spark, a, b, want):
    assert _cos(spark, a, b) == pytest.approx(want, abs=1e-9)


def test_cosine_symmetric_and_bounded(spark):
    rng = np.random.default_rng(1)
    rows = [(rng.normal(size=8).tolist(), rng.normal(size=8).tolist()) for _ in range(50)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    out = df.select(V.cosine("a", "b").alias("x"), V.cosine("b", "a").alias("y")).collect()
    for r in out:
        assert r.x == r.y
        assert -1 - 1e-9 <= r.x <= 1 + 1e-9


def test_l2_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    out = [r.n for r in df.select(V.l2_normalize("v").alias("n")).collect()]
    assert out[0] == pytest.approx([0.6, 0.8], rel=1e-6)
    assert out[1] == [0.0, 0.0]


def test_masked_mean(spark):
    rows = [([[1.0, 2.0], [3.0, 4.0]], [1, 1]),
            ([[1.0, 2.0], [3.0, 4.0]], [0, 0]),   # all-zero mask: sum 0, divisor 1
            ([[1.0, 2.0], [3.0, 4.0]], [0, 1]),
            ([[5.0, 6.0]], [1])]
    df = spark.createDataFrame(rows, "t array<array<float>>, m array<int>")
    out = [r.p for r in df.select(V.masked_mean("t", "m").alias("p")).collect()]
    assert out == [[2.0, 3.0], [0.0, 0.0], [3.0, 4.0], [5.0, 6.0]]


@pytest.mark.parametrize("n_bytes,status", [(0, "empty"), (3, "bad_length"), (4, "ok"), (1536, "ok")])
def test_blob_decode(spark, n_bytes, status):
    b = np.arange(n_bytes // 4, dtype="<f4").tobytes() if n_bytes % 4 == 0 else b"\x00" * n_bytes
    df = spark.createDataFrame([(bytearray(b),)], "b binary")
    r = df.select(V.blob_to_vector("b").alias("r")).first()["r"]
    assert r["blob_status"] == status
    assert len(r["embedding"]) == (n_bytes // 4 if status == "ok" else 0)


def test_blob_roundtrip(spark):
    v = [0.5, -1.25, 3.0, 1e-3]
    df = spark.createDataFrame([(v,)], "v array<float>")
    out = df.select(V.blob_to_vector(V.vector_to_blob("v")).alias("r")).first()["r"]
    assert out["embedding"] == pytest.approx(v, rel=1e-7)
    raw = df.select(V.vector_to_blob("v").alias("b")).first()["b"]
    assert len(raw) == 16 and np.frombuffer(bytes(raw), "<f4").tolist() == pytest.approx(v, rel=1e-7)
