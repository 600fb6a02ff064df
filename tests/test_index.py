from pyspark.sql import functions as F

from filelens.operators import index


def test_change_detect_rules(spark):
    scan = spark.createDataFrame(
        [(1, "/eq", "eq", ".txt", 100), (2, "/old", "old", ".txt", 100), (3, "/new", "new", ".txt", 100),
         (4, "/nul", "nul", ".txt", 100), (5, "/abs", "abs", ".txt", 100),
         (6, "/twice", "twice", ".txt", 50), (7, "/twice", "twice", ".txt", 70)],
        "file_id long, path string, name string, extension string, last_modified long")
    stored = spark.createDataFrame(
        [(11, "/eq", 100), (12, "/old", 101), (13, "/new", 99), (14, "/nul", None), (16, "/twice", 60)],
        "file_id long, path string, last_modified long")
    out = {r.path: (r.action, r.file_id, r.last_modified)
           for r in index.change_detect(scan, stored).collect()}
    assert out == {"/eq": ("skip", 11, 100), "/old": ("skip", 12, 100), "/new": ("update", 13, 100),
                   "/nul": ("update", 14, 100), "/abs": ("insert", 5, 100), "/twice": ("update", 16, 70)}


def test_upsert_then_rerun_is_noop(spark):
    scan = spark.createDataFrame([(1, "/a", "a", ".txt", 10, "x"), (2, "/b", "b", ".txt", 20, "y")],
                                 "file_id long, path string, name string, extension string, "
                                 "last_modified long, text string")
    vecs = spark.createDataFrame([(1, [1.0]), (2, [0.5])], "file_id long, embedding array<float>")
    empty = spark.createDataFrame([], "file_id long, path string, name string, extension string, "
                                      "last_modified long, embedding array<float>")
    d1 = index.embed_delta(index.change_detect(scan, empty), vecs)
    s1 = index.index_upsert(empty, d1)
    assert sorted(r.path for r in s1.collect()) == ["/a", "/b"]
    d2 = index.embed_delta(index.change_detect(scan, s1.drop("origin")), vecs)
    assert d2.count() == 0
    s2 = index.index_upsert(s1.drop("origin"), d2)
    assert sorted((r.path, r.origin) for r in s2.collect()) == [("/a", "stored"), ("/b", "stored")]


def test_embed_failures_not_indexed(spark):
    ch = spark.createDataFrame([(1, "/a", "a", ".txt", 5, "", "insert"), (2, "/b", "b", ".txt", 5, "t", "insert"),
                                (3, "/c", "c", ".txt", 5, "t", "update")],
                               "file_id long, path string, name string, extension string, last_modified long, "
                               "text string, action string")
    vecs = spark.createDataFrame([(1, [1.0]), (3, [])], "file_id long, embedding array<float>")
    st = {r.file_id: r.status for r in index.embed_delta(ch, vecs).collect()}
    assert st == {1: "no_text", 2: "embed_failed", 3: "embed_failed"}


def test_latest_per_key_hot_key(spark):
    rows = [(0, i, i % 7) for i in range(3000)] + [(1, 5, 1), (2, 9, 9), (2, 10, 9)]
    df = spark.createDataFrame(rows, "k long, id long, ts long")
    out = {r.k: (r.id, r.ts) for r in index.latest_per_key(df, "k", "ts", "id").collect()}
    assert out == {0: (6, 6), 1: (5, 1), 2: (9, 9)}


def test_cascade_and_orphans(spark):
    files = spark.createDataFrame([(1, "/a"), (2, "/b")], "file_id long, path string")
    vecs = spark.createDataFrame([(1, [1.0]), (2, [1.0]), (3, [1.0])], "file_id long, embedding array<float>")
    assert [r.file_id for r in index.orphan_vectors(vecs, files).collect()] == [3]
    f2, v2 = index.cascade_delete(files, vecs, spark.createDataFrame([(2,)], "file_id long"))
    assert sorted(r.file_id for r in f2.collect()) == [1]
    assert sorted(r.file_id for r in v2.collect()) == [1, 3]


def test_quarantine_and_retry_once(spark):
    ch = spark.createDataFrame([(1, "/a", "a", ".txt", 5, "", "insert"), (2, "/b", "b", ".txt", 5, "t", "insert"),
                                (3, "/c", "c", ".txt", 5, "t", "update"), (4, "/d", "d", ".txt", 5, "t", "insert")],
                               "file_id long, path string, name string, extension string, last_modified long, "
                               "text string, action string")
    first = spark.createDataFrame([(4, [1.0])], "file_id long, embedding array<float>")
    q = {r.file_id: (r.status, r.attempts, r.reason) for r in index.quarantine(index.embed_delta(ch, first)).collect()}
    assert set(q) == {1, 2, 3} and all(a == 1 for _, a, _ in q.values())
    assert q[1][0] == "no_text" and q[1][2] == index.QUARANTINE_REASONS["no_text"]
    assert q[2][2] == index.QUARANTINE_REASONS["embed_failed"]
    # the embedder now answers for 2 only: 2 recovers, 1 and 3 fail again
    second = spark.createDataFrame([(2, [0.5]), (4, [1.0])], "file_id long, embedding array<float>")
    rec, still = index.retry_quarantined(index.quarantine(index.embed_delta(ch, first)), ch, second)
    assert [(r.file_id, r.status) for r in rec.collect()] == [(2, "insert")]
    assert sorted((r.file_id, r.attempts) for r in still.collect()) == [(1, 2), (3, 2)]
    # attempts == 2: never retried again
    rec2, still2 = index.retry_quarantined(still, ch, second)
    assert rec2.count() == 0 and still2.count() == 0


def test_path_ids_resolve_collisions(spark):
    # a 4-value hash forces collisions between new paths and with stored ones
    tiny = lambda c, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(4))
    stored = spark.createDataFrame([("/s1", 0), ("/s2", 1)], "path string, file_id long")
    new = spark.createDataFrame([("/s1",), ("/n1",), ("/n2",), ("/n1",)], "path string")
    ids = {r.path: r.file_id for r in index.path_ids(new, stored, hash_fn=tiny).collect()}
    assert set(ids) == {"/s1", "/n1", "/n2"}
    assert ids["/s1"] == 0  # a stored path keeps its id
    assert len(set(ids.values()) | {1}) == 4  # unique among themselves and not the stored /s2's id
    plain = {r.path: r.file_id for r in index.path_ids(new, None).collect()}
    assert plain["/n1"] == spark.range(1).select(F.xxhash64(F.lit("/n1"))).first()[0]
