import numpy as np
import pytest
from pyspark.sql import functions as F

from filelens.functions import vectors as V
from filelens.operators import pooling

SCHEMA = "doc_id long, window long, input_ids array<long>, attention_mask array<long>, status string, note string"


def brute(ids, mask, table, n, dim):
    if mask is None:
        mask = None if ids is None else [int(i != 0) for i in ids]
    if ids is None or len(ids) != n or len(mask) != n:
        return None
    real = [i for i, m in zip(ids, mask) if m]
    return sum((np.array(table[i]) for i in real if i in table), np.zeros(dim)) / max(1, len(real))


@pytest.mark.parametrize("hot_rows", [2, 1_000_000])
def test_pooling_against_brute_force(spark, hot_rows):
    rng = np.random.default_rng(5)
    table = {i: rng.normal(size=3).tolist() for i in range(9) if i != 5}  # 5 has no vector
    rows = []
    for d in range(60):
        size = int(rng.integers(0, 6))
        ids = [1, *rng.integers(3, 9, size).tolist(), 2] + [0] * (6 - size)
        rows.append((d, d % 3, ids, [int(i != 0) for i in ids]))
    rows += [(100, 0, rows[0][2], None), (101, 0, rows[0][2], [0] * 8), (102, 0, rows[0][2], [1] * 7),
             (103, 0, [1, 2], [1, 1]), (104, 0, None, None), (105, 0, [], []), (106, 0, [1] * 8, [5] * 8),
             (106, 0, [1] * 8, [5] * 8), (None, None, [0] * 8, [1] * 8)]
    df = spark.createDataFrame([(*r, "s", "x") for r in rows], SCHEMA).drop("status").repartition(4)
    vecs = spark.createDataFrame(list(table.items()) + [(77, None), (78, [1.0])], "token_id long, embedding array<double>")
    got = pooling.pool_windows(df, vecs, n=8, hot_rows=hot_rows)
    assert got.columns == ["doc_id", "window", "note", "status", "n_real", "embedding"]
    seen = {}
    for r in got.collect():
        seen.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, seen.values())) == len(rows)
    for d, _, ids, mask in rows:
        want = brute(ids, mask, table, 8, 3)
        for r in seen[d]:
            assert r.status == ("failed" if want is None else "ok")
            assert (r.embedding is None) == (want is None) == (r.n_real is None)
            if want is not None:
                assert r.embedding == pytest.approx(want.tolist(), abs=1e-12)


def test_same_as_masked_mean_of_a_windows_vectors(spark):
    table = [[float(i), float(i * i)] for i in range(6)]
    df = spark.createDataFrame([(1, 0, [1, 4, 4, 2, 0, 0], [1, 1, 0, 1, 0, 0])],
                               "doc_id long, window long, input_ids array<long>, attention_mask array<long>")
    vecs = spark.createDataFrame(list(enumerate(table)), "token_id long, embedding array<double>")
    pooled = pooling.pool_windows(df, vecs, n=6).first()
    rows = df.withColumn("v", F.transform("input_ids", lambda i: F.element_at(
        F.array(*[F.array(*map(F.lit, r)) for r in table]), (i + 1).cast("int"))))
    want = rows.select(V.masked_mean("v", "attention_mask").alias("m")).first().m
    assert pooled.embedding == pytest.approx(want) and pooled.n_real == 3


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, [1, 2], [1, 1])],
                               "doc_id long, window long, input_ids array<long>, attention_mask array<long>")
    vecs = spark.createDataFrame([(1, [1.0])], "token_id long, embedding array<double>")
    assert pooling.pool_windows(df.where("false"), vecs, n=2).count() == 0
    assert pooling.pool_windows(df, vecs.where("false"), n=2).first().embedding == []


def test_a_vector_moves_once_per_block_not_per_token(spark):
    """Rows that the join of tokens and vectors makes: distinct tokens of a
    block, however often they occur."""
    rows = [(d, 0, [1] + [3 + (d + i) % 5 for i in range(6)] + [2], [1] * 8) for d in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, window long, input_ids array<long>, attention_mask array<long>").coalesce(1)
    vecs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "token_id long, embedding array<double>")
    seen = spark.sparkContext.accumulator(0)
    made = pooling._pooled

    def counted(dim):
        run = made(dim)

        def count(windows, answers):
            seen.add(len(answers))
            return run(windows, answers)
        return count

    pooling._pooled = counted
    try:
        got = pooling.pool_windows(df, vecs, n=8).collect()
    finally:
        pooling._pooled = made
    assert len(got) == 500 and 0 < seen.value <= 7 * 4
    assert {tuple(r.embedding) for r in got} == {(sum(ids) / 8, 1.0) for *_, ids, _ in rows}
