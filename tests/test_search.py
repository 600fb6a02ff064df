import numpy as np
import pytest
from pyspark.sql import functions as F

from filelens.operators import search
from filelens.operators.dense import dense_search


@pytest.fixture(scope="module")
def small_index(spark):
    # positive, NULL, negative, tie pair, zero vector
    rows = [(1, "/a/1.txt", "1.txt", ".txt", [1.0, 0.0]),
            (2, "/a/2.txt", "2.txt", ".txt", None),
            (3, "/a/3.txt", "3.txt", ".txt", [-1.0, 0.0]),
            (4, "/a/4.txt", "4.txt", ".txt", [0.6, 0.8]),
            (5, "/a/5.txt", "5.txt", ".txt", [0.6, 0.8]),
            (6, "/a/6.txt", "6.txt", ".txt", [0.0, 0.0])]
    return spark.createDataFrame(rows, "file_id long, path string, name string, extension string, "
                                       "embedding array<float>")


def _ids(df):
    return [r.file_id for r in df.collect()]


def test_topk_order_null_between(small_index):
    out = search.search_topk(small_index, [1.0, 0.0], -1)
    # 1.0, then the 0.6 tie by id, then the three 0.0 rows by id, then -1.0
    assert _ids(out) == [1, 4, 5, 2, 6, 3]


@pytest.mark.parametrize("k,n", [(0, 0), (1, 1), (5, 5), (7, 6), (-1, 6)])
def test_topk_k(small_index, k, n):
    assert len(search.search_topk(small_index, [1.0, 0.0], k).collect()) == n


def test_topk_prefix(small_index):
    for k in range(1, 6):
        assert _ids(search.search_topk(small_index, [0.3, 0.7], k)) == \
            _ids(search.search_topk(small_index, [0.3, 0.7], k + 1))[:k]


def test_topk_plan(small_index):
    plan = search.search_topk(small_index, [1.0, 0.0], 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def _brute(corpus, queries, k, threshold=None):
    out = {}
    for qid, q in queries:
        sc = []
        for cid, v in corpus:
            if v is None or len(v) != len(q) or not np.any(v) or not np.any(q):
                s = 0.0
            else:
                s = float(np.dot(v, q) / (np.linalg.norm(v) * np.linalg.norm(q)))
            s = round(s, 6)
            if threshold is None or s >= threshold:
                sc.append((-s, cid))
        out[qid] = [c for _, c in sorted(sc)[:k]]
    return out


@pytest.mark.parametrize("threshold", [None, 0.2])
def test_dense_search_matches_brute_force(spark, threshold):
    rng = np.random.default_rng(7)
    corpus = [(i, rng.normal(size=6).round(3).tolist()) for i in range(300)]
    corpus[5] = (5, None)
    corpus[6] = (6, [0.0] * 6)
    corpus[7] = (7, corpus[8][1])  # exact tie
    queries = [(100 + j, rng.normal(size=6).round(3).tolist()) for j in range(25)]
    cdf = spark.createDataFrame(corpus, "file_id long, embedding array<double>").repartition(4)
    qdf = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    got = dense_search(cdf, qdf, 5, threshold=threshold, block_bytes=25 * 6 * 8 // 3)  # force 3+ blocks
    res = {}
    for r in got.orderBy("query_id", "rank").collect():
        res.setdefault(r.query_id, []).append(r.file_id)
    want = {q: v for q, v in _brute(corpus, queries, 5, threshold).items() if v}
    assert res == want


def test_cosine_pairs_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    vecs = [(i, rng.normal(size=4).tolist()) for i in range(120)]
    df = spark.createDataFrame(vecs, "file_id long, embedding array<double>")
    got = {(r.id_a, r.id_b) for r in search.cosine_pairs(df, 0.8, block_rows=16).collect()}
    want = set()
    for i, a in vecs:
        for j, b in vecs:
            if i < j and round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 6) >= 0.8:
                want.add((i, j))
    assert got == want


def test_group_search_best_chunk(spark):
    rng = np.random.default_rng(11)
    rows = []
    for d in range(40):
        for c in range(int(rng.integers(1, 6))):
            rows.append((d * 100 + c, d, c, rng.normal(size=5).tolist()))
    qs = [(j, rng.normal(size=5).tolist()) for j in range(8)]
    cdf = spark.createDataFrame(rows, "chunk_id long, doc_id long, chunk_no long, embedding array<double>")
    qdf = spark.createDataFrame(qs, "query_id long, embedding array<double>")
    got = dense_search(cdf.repartition(3), qdf, 4, id_col="chunk_id", payload=["doc_id", "chunk_no"],
                       group_col="doc_id")
    res = {}
    for r in got.orderBy("query_id", "rank").collect():
        res.setdefault(r.query_id, []).append((r.doc_id, r.chunk_id))
    for qid, q in qs:
        best = {}
        for cid, d, c, v in rows:
            s = round(float(np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q)), 6)
            if d not in best or (-s, cid) < best[d]:
                best[d] = (-s, cid)
        want = sorted((v[0], d, v[1]) for d, v in best.items())[:4]
        assert res[qid] == [(d, cid) for _, d, cid in want]


@pytest.mark.parametrize("threshold", [None, 0.4, -0.5])
def test_few_pairs_are_scored_and_the_best_are_exact(threshold, monkeypatch):
    from types import SimpleNamespace

    import pyarrow as pa

    from filelens.operators import dense
    rng = np.random.default_rng(3)
    vecs = np.r_[rng.normal(size=(4000, 16)), np.zeros((9, 16))]
    vecs[50:90] = vecs[7]  # copies: ties go by id
    vecs[100, 3] = np.nan
    ids = rng.permutation(len(vecs))
    rows = [None if i % 997 == 5 else v.tolist()[:15 if i % 997 == 6 else 16] for i, v in enumerate(vecs)]
    q = np.r_[vecs[:300:3], -vecs[7:8], np.zeros((1, 16)), np.abs(vecs[200:201])]
    scored, exact = [], dense.pair_scores
    monkeypatch.setattr(dense, "pair_scores", lambda *a: scored.append(len(a[4])) or exact(*a))
    bc = SimpleNamespace(value=(np.arange(len(q)), q, np.sqrt((q * q).sum(axis=1))))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(rows, pa.list_(pa.float64()))], ["file_id", "embedding"])
    got = {}
    for b in dense._topk_kernel(bc, 5, threshold, "file_id", "embedding", [], 16)(iter([batch.slice(0, 1500), batch.slice(1500)])):
        for r in b.to_pylist():
            got.setdefault(r["query_id"], []).append((-r["score"], r["file_id"]))
    mat, valid = dense.dense_matrix(batch.column("embedding"), 16)
    every = dense.cosine_matrix(mat, valid, *bc.value[1:])
    for j in range(len(q)):
        want = sorted((-s, int(i)) for s, i in zip(every[:, j], ids) if threshold is None or s >= threshold)[:5]
        assert sorted(got.get(j, [])) == [(pytest.approx(s, abs=1e-12), i) for s, i in want]
    assert sum(scored) < len(q) * len(vecs) / 10
