import os
import tempfile

import pytest
from pyspark.sql import functions as F

from filelens.sources import files as S
from filelens.sources import store


@pytest.fixture()
def tree():
    root = tempfile.mkdtemp(prefix="filelens-tree-")
    os.makedirs(f"{root}/sub/deeper")
    os.makedirs(f"{root}/we[ird]")
    with open(f"{root}/a.txt", "w") as f:
        f.write("hello world")
    with open(f"{root}/sub/deeper/b.TXT", "w") as f:
        f.write("deep")
    with open(f"{root}/sub/bad.txt", "wb") as f:
        f.write(b"ok \xff\xfe bytes")
    with open(f"{root}/sub/ws.txt", "w") as f:
        f.write("   \n ")
    with open(f"{root}/doc.pdf", "wb") as f:
        f.write(b"%PDF-1.4")
    with open(f"{root}/we[ird]/sp ace.txt", "w") as f:
        f.write("spaced")
    open(f"{root}/empty.txt", "w").close()
    with open(f"{root}/.hidden.txt", "w") as f:
        f.write("h")
    with open(f"{root}/_under.txt", "w") as f:
        f.write("u")
    os.symlink(f"{root}/a.txt", f"{root}/link.txt")
    return root


def test_inventory(spark, tree):
    inv = {r.name: r for r in S.inventory(spark, tree).collect()}
    # the file source skips hidden, underscore and zero-length files
    assert set(inv) == {"a.txt", "b.TXT", "bad.txt", "ws.txt", "doc.pdf", "sp ace.txt", "link.txt"}
    assert inv["a.txt"].path == f"{tree}/a.txt" and inv["a.txt"].size_bytes == 11
    assert inv["b.TXT"].extension == ".TXT"
    assert inv["a.txt"].last_modified == int(os.path.getmtime(f"{tree}/a.txt"))
    assert set(r.name for r in S.eligible(S.inventory(spark, tree)).collect()) == \
        {"a.txt", "bad.txt", "ws.txt", "doc.pdf", "sp ace.txt", "link.txt"}


def test_extract_never_fails(spark, tree):
    c = S.with_path_parts(S.read_content(spark, tree))
    out = {r.name: (r.status, r.text) for r in S.extract(c).collect()}
    assert out["a.txt"] == ("ok", "hello world")
    assert out["bad.txt"][0] == "repaired" and out["bad.txt"][1].startswith("ok ")
    assert out["ws.txt"] == ("ok", "   \n ")  # whitespace-only is kept
    assert out["doc.pdf"][0] == "no_extractor"
    assert out["b.TXT"][0] == "unsupported"


def test_large_files_not_read(spark, tree):
    c = S.read_content(spark, tree, max_bytes=8)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = c._jdf.queryExecution().explainString(mode)
    assert "LessThanOrEqual(length,8)" in plan  # the body read is filtered in the reader
    out = {r.name: (r.status, r.size_bytes) for r in S.extract(S.with_path_parts(c)).collect()}
    assert out["a.txt"] == ("too_large", 11)
    assert out["doc.pdf"][0] == "no_extractor" and out["doc.pdf"][1] == 8


def test_plugged_extractor(spark, tree):
    S.register_extractor([".pdf"], lambda s: s.map(lambda b: "pdf:" + str(len(b))))
    try:
        c = S.with_path_parts(S.read_content(spark, tree))
        out = {r.name: (r.status, r.text) for r in S.extract(c).collect()}
        assert out["doc.pdf"] == ("ok", "pdf:8")
    finally:
        S._EXTRACTORS.clear()


def test_versioned_store_idempotent(spark):
    root = tempfile.mkdtemp(prefix="filelens-store-")
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    assert store.commit(df, root, 1)
    assert not store.commit(df, root, 1)  # replay: already committed
    assert store.commit(df.withColumn("v", F.lit("b")), root, 2)
    assert store.read_current(spark, root).first()["v"] == "b"


def test_ensure_table_idempotent(spark):
    from filelens.schema import INDEX_SCHEMA
    root = tempfile.mkdtemp(prefix="filelens-store-") + "/index"
    assert store.ensure_table(spark, root, INDEX_SCHEMA)
    t = store.read_current(spark, root)
    assert t.count() == 0 and [f.name for f in t.schema.fields] == [f.name for f in INDEX_SCHEMA.fields]
    assert not store.ensure_table(spark, root, INDEX_SCHEMA)  # already there: no-op
    assert store.versions(spark, root) == [0]


def test_stream_latest_strictly_newer(spark):
    from filelens.streaming.jobs import stream_latest
    src = tempfile.mkdtemp(prefix="filelens-src-")
    sch = "k long, id long, ts long, v string"
    batches = [
        [(1, 1, 10, "a"), (2, 2, 5, "b"), (1, 3, 12, "c")],
        [(1, 4, 12, "equal-later"), (2, 5, 4, "older"), (3, 6, 1, "new")],
        [(2, 7, 6, "newer")],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, sch).coalesce(1).write.parquet(f"{src}/b{i}")
    # one file per trigger: three micro-batches in order
    import glob
    flat = tempfile.mkdtemp(prefix="filelens-flat-")
    for i in range(3):
        f = glob.glob(f"{src}/b{i}/*.parquet")[0]
        os.link(f, f"{flat}/part-{i}.parquet")
    root = stream_latest(spark, flat, "*.parquet", sch, "k", "ts", "id", max_files_per_trigger=1)
    st = {r.k: (r.id, r.v) for r in store.read_current(spark, root).collect()}
    assert st == {1: (3, "c"), 2: (7, "newer"), 3: (6, "new")}
    assert store.versions(spark, root)[-1] == 3


def test_upsert_newer_touched_keys_equals_full_merge(spark, monkeypatch):
    from filelens.streaming import jobs
    sch = "k long, id long, ts long, v string"
    state = spark.createDataFrame([(1, 1, 10, "s1"), (2, 2, 5, "s2"), (3, 3, 7, "s3"), (None, 4, 1, "sn")], sch)
    batch = spark.createDataFrame([(1, 9, 10, "equal"), (2, 8, 6, "newer"), (2, 7, 6, "newer-lower-id"),
                                   (4, 6, 1, "new"), (None, 5, 2, "null-newer"), (3, 10, 6, "older")], sch)

    def rows(df):
        return sorted((r.k if r.k is not None else -1, r.id, r.ts, r.v) for r in df.collect())

    touched = rows(jobs.upsert_newer(state, batch, "k", "ts", "id"))
    monkeypatch.setattr(jobs, "BROADCAST_MAX_ROWS", -1)
    full = rows(jobs.upsert_newer(state, batch, "k", "ts", "id"))
    assert touched == full == [(-1, 5, 2, "null-newer"), (1, 1, 10, "s1"), (2, 7, 6, "newer-lower-id"),
                               (3, 3, 7, "s3"), (4, 6, 1, "new")]


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_deltas_newest_wins_and_deleted(spark):
    root = tempfile.mkdtemp(prefix="filelens-store-") + "/t"
    sch = "k long, v string"

    def frame(*rows):
        return spark.createDataFrame(list(rows), sch)

    assert store.commit(frame((1, "a"), (2, "b"), (None, "n")), root, 0)
    assert store.commit_delta(frame((2, "b2"), (3, "c")), root, 1, "k")
    assert not store.commit_delta(frame((2, "lost")), root, 1, "k")       # replay
    assert store.commit_delta(frame(), root, 2, "k")                       # nothing changed
    assert store.commit_delta(frame((None, "n2")), root, 3, "k", deleted=frame((1, None), (9, None)))
    want = [(2, "b2", 1), (3, "c", 1)]
    got = store.read_current(spark, root, with_version=True)
    assert _rows(got.where("k is not null"), "k", "v", "version") == want
    assert _rows(got.where("k is null"), "v", "version") == [("n2", 3)]
    assert store.versions(spark, root) == [0, 1, 2, 3]
    assert store.compact(spark, root) and not store.compact(spark, root)
    assert _rows(store.read_current(spark, root, with_version=True).where("k is not null"), "k", "v", "version") == want
    parts = [r.p for r in frame((3, "")).select(store.part_of("k").alias("p")).collect()]
    assert (3, "c") in _rows(store.read_current(spark, root, parts=parts).where("k is not null"), "k", "v")
    # a deleted key may come back
    assert store.commit_delta(frame((1, "again")), root, 4, "k")
    assert (1, "again", 4) in _rows(store.read_current(spark, root, with_version=True).where("k is not null"), "k", "v", "version")


def test_a_commit_writes_its_batch_and_deltas_are_compacted(spark):
    root = tempfile.mkdtemp(prefix="filelens-store-") + "/t"
    state = spark.range(200_000).selectExpr("id AS k", "sha2(string(id), 256) AS v")
    store.commit(state, root, 0)

    def size(name):
        return sum(os.path.getsize(f"{root}/{name}/{f}") for f in os.listdir(f"{root}/{name}") if f.endswith(".parquet"))

    for n in range(1, 20):
        store.commit_delta(spark.createDataFrame([(n, f"v{n}")], "k long, v string"), root, n, "k", keep=1)
        if n % store.MAX_DELTAS:  # else compacted, and gone with keep=1
            assert size(f"v={n}-by=k") < size(next(d for d in os.listdir(root) if "by" not in d)) / 1000
    names = sorted(os.listdir(root))
    assert sum("by" in d for d in names) <= store.MAX_DELTAS and "v=0" not in names
    back = store.read_current(spark, root)
    assert back.count() == 200_000 and _rows(back.where("k between 1 and 20 and v like 'v%'"), "k") == [(n,) for n in range(1, 20)]


def test_stream_writes_deltas_and_counters(spark):
    from filelens.streaming import jobs
    sch = "k long, id long, ts long, v string"
    root = tempfile.mkdtemp(prefix="filelens-state-") + "/s"
    batches = [[(1, 1, 10, "a"), (2, 2, 5, "b"), (1, 3, 12, "c"), (None, 9, None, "n")],
               [(1, 4, 12, "equal"), (2, 5, 4, "older"), (3, 6, 1, "new"), (None, 8, 1, "n2")], [], [(2, 7, 6, "newer")]]
    for _ in range(2):  # the second time all triggers are replayed
        for i, rows in enumerate(batches):
            jobs.commit_newer(spark.createDataFrame(rows, sch), i, root, "k", "ts", "id")
    got = store.read_current(spark, root)
    assert _rows(got.where("k is not null"), "k", "id", "v") == [(1, 3, "c"), (2, 7, "newer"), (3, 6, "new")]
    assert _rows(got.where("k is null"), "v") == [("n2",)]
    assert _rows(jobs.read_counters(spark, root), "batch_id", "arrived", "keys", "inserted", "updated") == [
        (0, 4, 3, 3, 0), (1, 4, 4, 1, 1), (2, 0, 0, 0, 0), (3, 1, 1, 0, 1)]


def test_second_index_run_writes_nothing(spark):
    from filelens.operators import index
    root = tempfile.mkdtemp(prefix="filelens-index-") + "/i"
    files = "file_id long, path string, name string, extension string, last_modified long"
    scan = spark.createDataFrame([(1, "/a.txt", "a.txt", ".txt", 5), (2, "/b.txt", "b.txt", ".txt", 7)], files)
    vecs = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "file_id long, embedding array<double>")
    texts = spark.createDataFrame([("/a.txt", True), ("/b.txt", True)], "path string, has_text boolean")
    store.commit(scan.where("false").withColumn("embedding", F.array().cast("array<double>")), root, 0)
    for run in (1, 2):
        assert index.index_run(scan, vecs, texts, root, run)
    assert _rows(store.read_current(spark, root, with_version=True), "path", "version") == [("/a.txt", 1), ("/b.txt", 1)]
    assert spark.read.parquet(f"{root}/v=2-by=path").count() == 0
    assert index.index_run(scan.withColumn("last_modified", F.col("last_modified") + F.col("file_id") - 1), vecs, texts, root, 3)
    assert spark.read.parquet(f"{root}/v=3-by=path").count() == 1


def test_corpus_tree_of_many_small_files(spark):
    rows = [(i, "a/b" if i % 2 else None, "en", f"text {i}") for i in range(400)] + [(5, "a/b", "en", "again"), (7, "a/b", "en", None)]
    root = tempfile.mkdtemp(prefix="filelens-corpus-") + "/tree"
    S.write_corpus(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").repartition(3), root)
    inv = S.inventory(spark, root)
    assert inv.count() == 400 and sum(len(d) for _, d, _ in os.walk(root)) <= 4  # no folder per file
    slots = spark.sparkContext.defaultParallelism
    assert S.read_content(spark, root).rdd.getNumPartitions() <= 8 * slots < inv.count() / 4
    got = {r.path[len(root):]: bytes(r.content).decode() for r in S.read_content(spark, root).collect()}
    assert got["/source=a%2Fb/lang=en/doc_1.txt"] == "text 1\n"
    assert got["/source=__HIVE_DEFAULT_PARTITION__/lang=en/doc_2.txt"] == "text 2\n"
    assert sorted(got["/source=a%2Fb/lang=en/doc_5.txt"].split("\n")) == ["", "again", "text 5"]
    assert sorted(got["/source=a%2Fb/lang=en/doc_7.txt"].split("\n")) == ["", "", "text 7"]


def test_stream_index_reads_each_file_once(spark):
    from filelens.operators import embed
    from filelens.streaming.jobs import stream_index
    root = tempfile.mkdtemp(prefix="filelens-corpus-") + "/tree"
    S.write_corpus(spark.range(300).selectExpr("id AS doc_id", "'s' AS source", "'en' AS lang", "string(id) AS text"), root)
    seen, extract = [], S.extract
    reads = spark.sparkContext.accumulator(0)

    def counted(files, *a, **kw):
        def run(batches):
            for b in batches:
                reads.add(b.num_rows)
                yield b
        seen.append(1)
        return extract(files.mapInArrow(run, files.schema), *a, **kw)

    S.extract = counted
    try:
        index = stream_index(spark, root, lambda df: embed.hashed_embed(df, id_col="file_id"))
    finally:
        S.extract = extract
    assert store.read_current(spark, index).count() == 300 and reads.value == 300 * len(seen)
    assert spark.conf.get("spark.sql.files.openCostInBytes") == "4194304b"
