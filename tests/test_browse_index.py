"""Semantics of the browse, health and maintenance operators:
limit before filter, NULL mtimes last, no limit when <= 0, vector health
statuses, duplicates, hash change, vanished files, re-index rules."""

import math

import pytest

from filelens.operators import ann, browse, embed, index


@pytest.fixture(scope="module")
def idx(spark):
    rows = [(1, "/r/a.txt", "a.txt", ".txt", 30), (2, "/r/b.txt", "b.txt", ".txt", None),
            (3, "/r/c.pdf", "c.pdf", ".pdf", 50), (4, "/x/a.txt", "a.txt", ".txt", 50),
            (5, "/r/e f.txt", "e f.txt", ".txt", 10)]
    return spark.createDataFrame(rows, "file_id long, path string, name string, extension string, "
                                       "last_modified long").withColumn("embedding", index.F.lit(None).cast(
                                           "array<float>"))


def test_list_recent_order_nulls_last_and_limit(idx):
    assert [r.file_id for r in browse.list_recent(idx, 200).collect()] == [3, 4, 1, 5, 2]
    assert [r.file_id for r in browse.list_recent(idx, 2).collect()] == [3, 4]
    assert len(browse.list_recent(idx, 0).collect()) == 5  # limit only when > 0
    assert len(browse.list_recent(idx, -3).collect()) == 5


def test_list_filter_after_limit_and_across_blank(idx):
    # the filter sees only the 2 most recent rows: a.txt under /x (id 4) is
    # among them, the older /r/a.txt (id 1) is not
    assert [r.file_id for r in browse.list_filter(idx, "a.txt", 2).collect()] == [4]
    assert [r.file_id for r in browse.list_filter(idx, "a.txt", 200).collect()] == [4, 1]
    # the needle may span the blank joining name and path: "a.txt /x"
    assert [r.file_id for r in browse.list_filter(idx, "a.txt /x", 200).collect()] == [4]
    assert [r.file_id for r in browse.list_filter(idx, "A.TXT", 200).collect()] == []  # case-sensitive
    assert len(browse.list_filter(idx, "", 200).collect()) == 5  # empty needle keeps all


def test_vector_health_statuses(spark):
    rows = [(1, [0.6, 0.8]), (2, None), (3, []), (4, [1.0, 0.0, 0.0]), (5, [float("nan"), 1.0]),
            (6, [2.0, 0.0]), (7, [0.6, 0.805])]
    v = spark.createDataFrame(rows, "file_id long, embedding array<double>")
    st = {r.file_id: r.status for r in embed.vector_health(v, 2).collect()}
    assert st == {1: "ok", 2: "missing", 3: "empty", 4: "bad_dim", 5: "nan", 6: "not_unit", 7: "ok"}


def test_exact_dups_keep_lowest_id(spark):
    docs = spark.createDataFrame([(5, "x"), (2, "x"), (9, "x"), (1, "y"), (3, "z"), (4, "z")],
                                 "doc_id long, text string")
    got = sorted((r.doc_id, r.keep_id, r.n_copies) for r in ann.exact_dups(docs).collect())
    assert got == [(4, 3, 2), (5, 2, 3), (9, 2, 3)]


def test_hash_change_and_vanished(spark):
    scan = spark.createDataFrame([(1, "/a", "h1"), (2, "/b", "h2"), (3, "/c", "h3")],
                                 "file_id long, path string, content_hash string")
    stored = spark.createDataFrame([(11, "/a", "h1"), (12, "/b", "old"), (13, "/c", None), (14, "/gone", "h")],
                                   "file_id long, path string, content_hash string")
    act = {r.path: r.action for r in index.hash_change(scan, stored).collect()}
    assert act == {"/a": "skip", "/b": "update", "/c": "update"}
    assert [r.path for r in index.vanished_files(stored, scan).collect()] == ["/gone"]


def test_model_reindex_rules(spark):
    iv = spark.createDataFrame([(1, "/a", [1.0, 0.0]), (2, "/b", None), (3, "/c", [1.0])],
                               "file_id long, path string, embedding array<float>")
    meta = spark.createDataFrame([("model_name", "m1"), ("embedding_dim", "2")], "key string, value string")
    same = {r.file_id: r.reason for r in index.model_reindex(iv, meta, {"model_name": "m1", "embedding_dim": "2"})
            .collect()}
    assert same == {2: "missing_vector", 3: "bad_dim"}
    changed = {r.file_id: r.reason for r in index.model_reindex(iv, meta, {"model_name": "m2", "embedding_dim": "2"})
               .collect()}
    assert changed == {1: "model_changed", 2: "model_changed", 3: "model_changed"}


def test_metadata_upsert_replaces_by_key(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    new = spark.createDataFrame([("b", "3"), ("c", "4")], "key string, value string")
    assert sorted(tuple(r) for r in index.metadata_upsert(old, new).collect()) == [("a", "1"), ("b", "3"), ("c", "4")]


def test_file_features_and_tags(spark):
    f = spark.createDataFrame([(1, "  Title line  \nbody"), (2, "ü"), (3, "")], "file_id long, text string")
    got = {r.file_id: (r.size_bytes, r.title) for r in browse.file_features(f).collect()}
    assert got == {1: (19, "Title line"), 2: (2, "ü"), 3: (0, "")}
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    files = spark.createDataFrame([(1, "/a"), (2, "/b")], "file_id long, path string")
    tags = {r.file_id: r.tags for r in browse.file_tags(files, browse.label_tags(labels)).collect()}
    assert tags == {1: "labeled,quality,toxic", 2: ""}


def test_index_stats_counts(spark):
    iv = spark.createDataFrame([(".txt", [3.0, 4.0]), (".txt", None), (".pdf", [1.0])],
                               "extension string, embedding array<float>")
    st = {r.extension: (r.n_files, r.n_vectors, r.min_dim, r.max_dim, r.max_norm)
          for r in browse.index_stats(iv).collect()}
    assert st[".txt"][:4] == (2, 1, 2, 2) and math.isclose(st[".txt"][4], 5.0)
    assert st[".pdf"][:4] == (1, 1, 1, 1)
