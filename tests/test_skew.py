"""Hot groups: one key, label or group of copies holding a third of all rows
must give the same answer as a plain computation (the operators pre-aggregate
or salt; nothing collects a whole group)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from filelens.operators import ann, embed, index


def test_exact_dups_third_are_copies(spark):
    n = 3000
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = ann.exact_dups(docs).collect()
    assert len(got) == n // 3 - 1
    assert {r.keep_id for r in got} == {0} and {r.n_copies for r in got} == {n // 3}


def test_centroids_hot_label(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(3000, 4))
    labels = [0 if i % 3 == 0 else 1 + i % 5 for i in range(3000)]
    df = spark.createDataFrame([(i, int(l), [float(x) for x in v]) for i, (l, v) in enumerate(zip(labels, vecs))],
                               "file_id long, label long, embedding array<double>").repartition(8)
    got = {(r.label, r.pos): r.value for r in embed.centroids(df, "label").collect()}
    for lab in set(labels):
        want = vecs[[i for i, l in enumerate(labels) if l == lab]].mean(axis=0)
        assert [got[(lab, p)] for p in range(4)] == pytest.approx(list(want), abs=1e-9)


def test_change_detect_hot_path_batch(spark):
    # a third of the scanned rows carry one path: the newest of them decides
    scan_rows = [(i, "/hot" if i % 3 == 0 else f"/p{i}", "x", ".txt", 100 + (i % 300)) for i in range(3000)]
    scan = spark.createDataFrame(scan_rows, "file_id long, path string, name string, extension string, "
                                            "last_modified long").repartition(8)
    stored = spark.createDataFrame([(7, "/hot", 200)], "file_id long, path string, last_modified long")
    out = index.change_detect(scan, stored).where(F.col("path") == "/hot").collect()
    assert len(out) == 1 and out[0].action == "update" and out[0].last_modified == 397 and out[0].file_id == 7
