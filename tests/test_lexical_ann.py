"""BM25 and rank fusion against brute force; LSH properties:
with every row a candidate the approximate search is exact (recall 1.0),
and LSH pairs are always a subset of the exact pairs."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from filelens.operators import ann, inverted, lexical, search
from filelens.operators.dense import dense_search

TEXTS = ["the cat sat on the mat", "the dog sat", "", "cats and dogs and the cat",
         "mat mat mat", "a b c", "The CAT, the cat; the Cat!", "über straße über"]
QUERIES = ["cat mat", "the the dog", "nothing here", "über", "sat cat dog mat the"]


def _words(t):
    return re.findall(r"[\w]+", t.lower())


def _bm25_brute(texts, queries, k, k1=1.2, b=0.75):
    docs = [_words(t) for t in texts]
    n = len(docs)
    avgdl = sum(len(d) for d in docs) / n
    out = {}
    for qi, q in enumerate(queries):
        scores = {}
        for w in set(_words(q)):
            df = sum(1 for d in docs if w in d)
            if df == 0:
                continue
            idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
            for di, d in enumerate(docs):
                tf = d.count(w)
                if tf:
                    s = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / avgdl))
                    scores[di] = scores.get(di, 0.0) + s
        ranked = sorted(((-round(s, 6), di) for di, s in scores.items()))[:k]
        out[qi] = [(di, -s) for s, di in ranked]
    return out


@pytest.mark.parametrize("k", [1, 3, 10])
def test_bm25_matches_brute_force(spark, k):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    qs = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, text string")
    got = {}
    for r in lexical.bm25_topk(docs, qs, k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    want = {q: v for q, v in _bm25_brute(TEXTS, QUERIES, k).items() if v}
    assert got.keys() == want.keys()
    for q in want:
        assert [d for d, _ in got[q]] == [d for d, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-6)


def test_rrf_fuse(spark):
    a = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12)], "query_id long, rank long, doc_id long")
    b = spark.createDataFrame([(1, 1, 12), (1, 2, 13)], "query_id long, rank long, doc_id long")
    got = [(r.doc_id, r.score) for r in lexical.rrf_fuse(a, b, 3).orderBy("rank").collect()]
    s = {10: 1 / 61, 11: 1 / 62, 12: 1 / 63 + 1 / 61, 13: 1 / 62}
    want = sorted(((-round(v, 6), d) for d, v in s.items()))[:3]
    assert [d for d, _ in got] == [d for _, d in want]
    # 11 and 13 tie on score: the lower id wins the last place
    assert 11 in [d for d, _ in got] and 13 not in [d for d, _ in got]


@pytest.fixture(scope="module")
def vecs(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(12, 6))
    near = base[:6] + 0.05 * rng.normal(size=(6, 6))  # near copies give pairs over the threshold
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.vstack([base, near]))]
    return spark.createDataFrame(rows, "file_id long, embedding array<double>")


def test_ann_exact_when_all_candidates(spark, vecs):
    qs = vecs.withColumnRenamed("file_id", "query_id")
    exact = dense_search(vecs, qs, 5)
    # zero bits per band: every row has key 0 in every band, so all are candidates
    approx = ann.ann_topk(vecs, qs, 5, dim=6, bands=1, bits=0)
    rec = ann.ann_recall(approx, exact, 5).collect()
    assert len(rec) == 18 and all(r.recall == 1.0 for r in rec)
    key = lambda df: sorted((r.query_id, r.rank, r.file_id, r.score) for r in df.collect())
    assert key(approx) == key(exact.select("query_id", "rank", "file_id", "score"))


def test_lsh_pairs_subset_of_exact(spark, vecs):
    exact = {(r.id_a, r.id_b): r.score for r in search.cosine_pairs(vecs, 0.5).collect()}
    assert exact  # the near copies
    for bands, bits in [(4, 3), (16, 2)]:
        got = {(r.id_a, r.id_b): r.score for r in ann.lsh_pairs(vecs, 6, 0.5, bands, bits).collect()}
        assert set(got) <= set(exact)
        assert all(got[p] == pytest.approx(exact[p], abs=1e-6) for p in got)
    everything = {(r.id_a, r.id_b) for r in ann.lsh_pairs(vecs, 6, 0.5, 1, 0).collect()}
    assert everything == set(exact)


def test_lsh_pairs_hot_bucket_salted(spark, vecs):
    # a tiny group limit forces the one (band, key) bucket to be salted into
    # block pairs; the result must not change
    plain = {(r.id_a, r.id_b) for r in ann.lsh_pairs(vecs, 6, 0.5, 1, 0).collect()}
    salted = {(r.id_a, r.id_b) for r in ann.lsh_pairs(vecs, 6, 0.5, 1, 0, max_group_rows=4).collect()}
    assert salted == plain


def _fused(spark, docs, qs, k, dim):
    """Fusion of the whole lists, in Python."""
    from filelens.operators import embed
    from filelens.operators.dense import dense_search

    vec = lambda d, i: embed.hashed_embed(d, dim=dim, id_col=i)
    sem = dense_search(vec(docs, "doc_id"), vec(qs, "query_id"), None, id_col="doc_id", dim=dim).collect()
    kw = lexical.bm25_topk(docs, qs, -1).collect()
    score = {}
    for r in [*sem, *kw]:
        score[r.query_id, r.doc_id] = score.get((r.query_id, r.doc_id), 0.0) + 1 / (60 + r["rank"])
    out = []
    for q in {q for q, _ in score}:
        best = sorted((-round(s, 6), d) for (p, d), s in score.items() if p == q)[:k]
        out += [(q, n + 1, d, -s) for n, (s, d) in enumerate(best)]
    return sorted(out)


def _many_texts():
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(200)]
    weight = 1.0 / np.arange(1, 201)
    texts = [" ".join(rng.choice(words, size=rng.integers(1, 120), p=weight / weight.sum())) for _ in range(900)]
    texts[17] = "w150 w160 w170 w180 w190 w3"
    return texts + [None, "", texts[5]]


@pytest.fixture(scope="module")
def stored(spark):
    """An index of blocks of 16 documents, and its queries."""
    before, inverted.BLOCK_DOCS = inverted.BLOCK_DOCS, 16
    docs = spark.createDataFrame(list(enumerate(_many_texts())), "doc_id long, text string").repartition(3)
    qs = spark.createDataFrame([(0, "w150 w160 w170"), (1, "w0 w1 w2"), (2, "w0"), (3, "none"), (4, None), (5, "W7 w7, w199!")],
                               "query_id long, text string")
    yield inverted.build(docs), qs
    inverted.BLOCK_DOCS = before


@pytest.mark.parametrize("k", [1, 7, -1])
def test_stored_index_finds_what_brute_force_finds(spark, stored, k):
    index, qs = stored
    texts = _many_texts()
    ids = [i for i, t in enumerate(texts) if t is not None]
    want = _bm25_brute([texts[i] for i in ids], ["w150 w160 w170", "w0 w1 w2", "w0", "none", "", "W7 w7, w199!"],
                       10 ** 6 if k < 0 else k)
    again = inverted.InvertedIndex(spark, index.root)   # read back
    got = {}
    for r in lexical.bm25_search(again, qs, k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((ids.index(r.doc_id), r.score))
    assert {q: [d for d, _ in v] for q, v in got.items()} == {q: [d for d, _ in v] for q, v in want.items() if v}
    assert all([s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-6) for q in got)


def test_blocks_read_fall_with_k(stored):
    index, qs = stored
    asked = index.query(qs)

    def read(k):
        return {r.query_id: (r.scored, r.blocks) for r in asked.blocks_read(k).collect()}

    few, some, every = read(1), read(20), read(None)
    assert all(few[q][0] <= some[q][0] <= every[q][0] == every[q][1] for q in every)
    assert few[0][0] * 3 < every[0][0]            # rare words: most blocks are skipped
    assert sum(n for n, _ in few.values()) < sum(n for n, _ in some.values()) < sum(n for n, _ in every.values())


def test_a_frequent_term_is_cut_by_block(stored):
    index, _ = stored
    rows = index.postings.where("term = 'w0'").collect()
    assert len(rows) > 20 and all(r.n == len(r.at) == len(r.tfs) and r.max_tf == max(r.tfs) for r in rows)
    assert index.documents.selectExpr("max(size(docs)) AS m").first().m == 16


def test_ranks_without_the_lists(spark, stored):
    from filelens.operators import embed
    from filelens.operators.dense import dense_ranks, dense_search

    index, qs = stored
    asked = index.query(qs)
    whole = {(r.query_id, r.doc): r["rank"] for r in asked.top(None).collect()}
    wanted = spark.createDataFrame([(q, d) for q in range(6) for d in (0, 5, 17, 33, 902, 901, 4000)], "query_id long, doc long")
    got = {(r.query_id, r.doc): r["rank"] for r in asked.ranks(wanted).collect()}
    assert got == {p: n for p, n in whole.items() if p[1] in (0, 5, 17, 33, 902)}

    docs = spark.createDataFrame(list(enumerate(_many_texts())), "doc_id long, text string").repartition(3)
    vecs = embed.hashed_embed(docs, dim=32, id_col="doc_id")
    qv = embed.hashed_embed(qs, dim=32, id_col="query_id")
    whole = {(r.query_id, r.doc_id): r["rank"] for r in dense_search(vecs, qv, None, id_col="doc_id", dim=32).collect()}
    got = {(r.query_id, r.doc): r["rank"] for r in
           dense_ranks(vecs, qv, wanted, id_col="doc_id", dim=32, block_bytes=2 * 8 * 32).collect()}
    assert got == {p: n for p, n in whole.items() if p[1] in (0, 5, 17, 33, 902, 901)}


def test_rows_before_marks():
    rng = np.random.default_rng(5)
    for _ in range(50):
        score, ids = rng.integers(0, 6, 40) / 4, rng.permutation(40)
        pick = rng.choice(40, 7, replace=False)
        pick = pick[np.argsort(score[pick], kind="stable")]
        got = inverted.before_marks(score[pick], ids[pick], score, ids)
        assert got.tolist() == [sum((-s, i) < (-score[p], ids[p]) for s, i in zip(score, ids)) for p in pick]


@pytest.mark.parametrize("depth", [1, 4, 256])
def test_hybrid_is_the_fusion_of_whole_lists(spark, depth):
    # many documents share the words of the queries in other amounts, so that
    # the two rankers disagree far down their lists
    texts = TEXTS + [None, "cat dog mat sat", "über cat"] + [
        " ".join(["cat"] * (i % 5) + ["dog"] * (i % 3) + [f"w{i % 11}"] * (i % 7)) for i in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    qs = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, text string")
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in lexical.hybrid_topk(docs, qs, 3, depth, dim=16).collect())
    assert got == pytest.approx(_fused(spark, docs, qs, 3, 16)) if not got else [g[:3] for g in got] == [
        w[:3] for w in _fused(spark, docs, qs, 3, 16)]


def test_hybrid_reads_the_texts_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(t):
        read.add(1)
        return t

    texts = TEXTS + [None] + [f"cat w{i % 7} w{i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("text", counted("text"))
    qs = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, text string")
    assert lexical.hybrid_topk(docs, qs, 3, dim=16).count() > 0
    assert read.value == len(texts)


def test_an_index_keeps_vectors_of_all_rows(spark):
    from filelens.operators import embed

    # more rows than a task cuts into blocks at once, some without a text or a word
    texts = [None if i % 50 == 7 else "" if i % 50 == 9 else f"cat w{i} w{i % 13} dog" for i in range(5000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    only = spark.createDataFrame([("cat",), ("w3",)], "term string")
    index = inverted.build(docs, only=only, dim=8)
    unit = embed.counts_vectorizer(8)
    got = {}
    for b in index.vectors.toArrow().to_batches():
        got.update(zip(b.column("doc").to_pylist(), unit(b.column("vec"))[0].tolist()))
    want = {r.doc_id: r.embedding for r in embed.hashed_embed(docs, dim=8).collect()}
    assert got == want and len(want) == len(texts)
    assert index.n == sum(t is not None for t in texts)
    held = {r.term: r.n for r in index.postings.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    assert held["cat"] == sum(bool(t) for t in texts) and held["w3"] == sum("w3" in (t or "").split() for t in texts)
    assert len(held) < 100   # the other words are left out, but for a few that share a place


def test_recall_divides_by_what_there_is(spark):
    exact = spark.createDataFrame([(1, 1, 10), (1, 2, 11)], "query_id long, rank long, file_id long")
    assert ann.ann_recall(exact, exact, 5).first()["recall"] == 1.0


def test_ann_without_cut(spark, vecs):
    qs = vecs.limit(3).withColumnRenamed("file_id", "query_id")
    assert ann.ann_topk(vecs, qs, -1, 6, 1, 0).count() == 3 * vecs.count()
