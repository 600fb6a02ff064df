from collections import Counter, defaultdict

import numpy as np

from cases import SF, WORD, awkward, nothing, sentence
from filelens.llm import bagminhash as B


def bag(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()


def brute(docs):
    """doc_id -> least id of its class, by all pairs that share a shingle."""
    bags = {i: bag(t) for i, t in docs}
    where = defaultdict(list)
    for i, b in bags.items():
        for x in b:
            where[x].append(i)
    parent = {i: i for i in bags}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {(p, q) for ids in where.values() for n, q in enumerate(ids) for p in ids[:n]}:
        both = sum((bags[a] & bags[b]).values())
        if 5 * both >= 4 * sum((bags[a] | bags[b]).values()):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in bags}


def test_signature_agreement_is_unbiased():
    rng = np.random.default_rng(1)
    for a, b in (([1, 1, 1, 5, 0, 2], [1, 0, 3, 2, 1, 2]), ([7], [5]), ([100, 3, 1], [37, 3, 2])):
        a, b, hits = np.array(a), np.array(b), 0.0
        for _ in range(150):
            h = rng.integers(0, 2**63, len(a)).astype(np.uint64)
            rows = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
            s = B.signatures(rows, np.concatenate([h[a > 0], h[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2)
            hits += (s[0] == s[1]).mean()
        assert abs(hits / 150 - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.02


def test_query_against_all_pairs(spark):
    from filelens.llm.registry import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op3_minhash_dedup"](spark, SF).collect()
    want = brute(docs)
    assert {r.doc_id: r.class_id for r in got} == want
    assert sum(r.kept for r in got) == len(set(want.values()))


def test_chain_and_hot_group(spark):
    # a chain of near copies, each like the next but not like the far ones, a
    # large group of copies and near copies, and texts sharing one passage
    base = sentence(9, 200).split()
    chain = [" ".join(base[4 * i:] + [f"new{j}" for j in range(4 * i)]) for i in range(8)]
    hot = sentence(11, 120).split()
    group = [" ".join(hot)] * 40 + [" ".join(hot[:i] + [f"edit{i}"] + hot[i + 1:]) for i in range(0, 118, 2)]
    passage = sentence(12, 100)
    shared = [passage + " " + sentence(100 + i, 80) for i in range(40)]
    docs = list(enumerate(chain + group + shared))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.class_id for r in B.near_duplicates(df).collect()} == brute(docs)


def test_awkward_tables(spark):
    df = awkward(spark)
    got = B.near_duplicates(df).collect()
    assert len(got) == df.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[0].class_id == 0 and by[1].class_id == 1 and by[2].class_id == 2 and by[1].kept
    assert by[6].class_id == 5 and by[7].class_id == 5 and by[6].class_size == 5
    kept = B.keep_first(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 1 and 6 not in ids and 7 not in ids and ids.count(None) == 2
    assert B.near_duplicates(nothing(spark)).count() == 0
