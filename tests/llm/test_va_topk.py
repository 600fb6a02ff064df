import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import SF
from filelens.llm import va_topk as V


def brute(rows, k, is_query):
    vec = {i: np.floor(np.array(v, np.float32).astype(np.float64) * 64).astype(np.int64) for i, v in rows}
    out = set()
    for q in vec:
        if is_query(q):
            best = sorted((-int(vec[q] @ vec[c]), c) for c in vec if c != q and len(vec[c]) == len(vec[q]))[:k]
            out |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(best)}
    return out


def found(df, k=20, mod=20, **more):
    got = V.search(df, F.col("vec_id") % mod == 0, k, **more)
    rows = [tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_against_all_pairs(spark):
    from filelens.llm.registry import QUERIES

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {tuple(r) for r in QUERIES["op9_exact_topk"](spark, SF).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute(rows, 20, lambda q: q % 20 == 0)


@pytest.mark.parametrize("bits", [2, 6])
def test_coarse_cells_copies_and_ties(spark, bits, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(150)] + [(600 + i, [0.0] * 8) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    assert found(df, 7, 10, bits=bits) == brute(rows, 7, lambda q: q % 10 == 0)


def test_awkward_tables(spark):
    schema = "vec_id long, embedding array<float>, label int, v string, ids string, cand string"
    rows = [(0, [1.0, 2.0]), (1, [0.5, -1.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]),
            (5, [float("inf"), 0.0]), (None, [1.0, 1.0]), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (7, [1.0]), (8, []), (10, []),
            (20, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, "a", "b", "c") for r in rows], schema)
    fine = [(i, v) for i, v in rows if i in (0, 1, 6, 7, 8, 10, 20)]  # both rows of 6
    assert found(df, 20, 2) == rows_brute(fine, 20, lambda q: q % 2 == 0)
    assert found(df.limit(0)) == set()


def rows_brute(rows, k, is_query):
    """As the SQL: every row is a query or candidate, in Python integers."""
    whole = [(i, [math.floor(64 * x) for x in np.array(v, np.float32).astype(float).tolist()]) for i, v in rows]
    out = set()
    for q in {i for i, _ in rows if is_query(i)}:
        pairs = [(-sum(x * y for x, y in zip(a, b)), j) for i, a in whole if i == q
                 for j, b in whole if j != q and len(a) == len(b)]
        out |= {(q, n + 1, j, max(-V._MOST, min(V._MOST, -s))) for n, (s, j) in enumerate(sorted(pairs)[:k])}
    return out


def test_every_row_is_a_candidate(spark):
    rows = [(1, [1.0, 0.0])] + [(3, [1.0, 0.0])] * 2 + [(20, [1.0, 1.0])] + [(40, [2.0, 1.0])] * 30 + [(5, [0.5, 0.0])] * 25
    rows += [(60, [1.0, 0.0])] * 2 + [(7, [3e6, 0.0])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for k in (3, 20):
        assert found(df, k) == rows_brute(rows, k, lambda q: q % 20 == 0)


def test_large_components_and_ids_with_several_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=6) * 10.0 ** rng.choice([0, 3, 5, 7])).tolist()) for i in range(200)]
    rows += [(200 + i, rows[3][1]) for i in range(30)] + [(300, [1e6, -2e7, 3.5, 0.0, 0.0, 1.0]), (301, [16384.0] + [0.0] * 5)]
    rows += [(i, rng.normal(size=6).tolist()) for i in (10, 10, 10, 11, 20)]      # further vectors of an id
    rows += [(10, (rng.normal(size=6) * 1e6).tolist())] + [(400, [3e38] * 6), (410, [2.9e38] * 6), (420, [-3e38] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    assert found(df, 7, 10) == rows_brute(rows, 7, lambda q: q % 10 == 0)
