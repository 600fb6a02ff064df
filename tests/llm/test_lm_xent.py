import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cases import SF, awkward, nothing
from filelens.llm import lm_xent as L
from filelens.llm import textops as X


def classes(text):
    for _, _, buf, offs in X.text_slices(pa.array([text])):
        _, word, before, pair = L.word_classes(buf, offs)
        return list(zip(word.tolist(), before.tolist(), pair.tolist()))
    return []


def brute(docs, target):
    """doc index -> (target loss, background loss), with dictionaries."""
    seen = [classes(t or "") for _, t in docs]

    def loss(own, members):
        words, history, pairs = Counter(), Counter(), Counter()
        for i in members:
            for w, b, p in seen[i]:
                words[w] += 1
                history[b] += 1
                pairs[p] += 1
        n, total = sum(words.values()), 0.0
        for w, b, p in seen[own]:
            single = (words[w] + 1) / (n + 2 ** L.VOCAB_BITS)
            total -= math.log((min(pairs[p], history[b], words[w]) + L.PRIOR * single) / (history[b] + L.PRIOR))
        return total / len(seen[own])

    every = range(len(docs))
    return {i: (loss(i, [j for j in every if j != i and docs[j][0] in target]), loss(i, [j for j in every if j != i]))
            for i in every if seen[i]}


def test_against_counters(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(25).collect()]
    target = {i for i, _ in docs if i % 3 == 0}
    got = L.score(spark.createDataFrame(docs, "doc_id long, text string"),
                  spark.createDataFrame([(i,) for i in target] * 2 + [(None,)], "doc_id long")).collect()
    want = brute(docs, target)
    for r in got:
        t, b = want[r.doc_id]
        assert (r.target_loss, r.background_loss, r.score) == pytest.approx((t, b, t - b))


def test_held_out_labels(spark):
    sf = SF.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = L.score(spark.read.parquet(f"{sf}/documents.parquet"), labels.where("quality = 1 and doc_id % 2 = 0")) \
        .join(labels.where("doc_id % 2 = 1"), "doc_id").where("score is not null").toPandas()
    good, bad = (got[got.quality == q].score.to_numpy() for q in (1, 0))
    assert (good[:, None] < bad[None, :]).mean() > 0.8


def test_awkward_tables(spark):
    df = awkward(spark)
    got = L.score(df, spark.createDataFrame([(5,), (None,)], "doc_id long")).collect()
    assert len(got) == df.count()
    assert all((r.n_words == 0) == (r.score is None) and (r.score is None or np.isfinite(r.score)) for r in got)
    assert L.score(nothing(spark), spark.createDataFrame([], "doc_id long")).count() == 0


def test_counts_are_exact_beyond_any_fixed_size(spark):
    # 600,000 distinct words: more than 2**18 words and, with 2 texts, 2**20 pairs
    words = [f"w{i}" for i in range(600_000)]
    texts = [" ".join(words), " ".join(words[::-1]), "never seen before", "w1 w2 w1 w2"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in L.score(df, spark.createDataFrame([(0,)], "doc_id long")).collect()}
    vocabulary, n = 600_003, 1_200_004
    # no word and no pair of this text is in any other
    assert got[2].background_loss == pytest.approx(
        -sum(math.log(L.PRIOR / (n + vocabulary) / (h + L.PRIOR)) for h in (3, 0, 0)) / 3)
    # all but w2 after w1 (once, in text 0) and w1 after w2 (once, in text 1)
    single, pairs, histories = 2 / (600_000 + vocabulary), (0, 1, 0, 1), (1, 1, 1, 1)
    assert got[3].target_loss == pytest.approx(
        -sum(math.log((p + L.PRIOR * single) / (h + L.PRIOR)) for p, h in zip(pairs, histories)) / 4)
