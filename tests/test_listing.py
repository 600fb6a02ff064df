import glob as G
import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from filelens.sources import files as S
from filelens.sources import listing as L
from filelens.sources import store


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "tree"
    for d in ("sub/deeper/deepest", ".git", "_meta", "_k=1/in", "_metadata", "_common_metadata.d", "k=2/lang=en", "we[ird]", "x._COPYING_", "bare"):
        (root / d).mkdir(parents=True)
    for name, body in {"a.txt": b"hello", ".hidden.txt": b"h", "_under.txt": b"u", "_p=1.txt": b"p", "_metadata.txt": b"m", "b._COPYING_": b"c",
                       "empty.txt": b"", "sub/b.TXT": b"deep", "sub/deeper/deepest/c": b"c" * 20, ".git/config": b"cfg", "_meta/m.txt": b"m",
                       "_k=1/in/d.txt": b"dd", "_metadata/e.txt": b"e", "_common_metadata.d/f.txt": b"f", "k=2/lang=en/g.txt": b"g\xff",
                       "we[ird]/sp ace%41.txt": b"spaced", "we[ird]/ab?.md": b"q", "x._COPYING_/h.txt": b"h"}.items():
        (root / name).write_bytes(body)
        os.utime(root / name, ns=(0, 1_700_000_000_123_456_789 + len(name)))
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside/far.txt").write_bytes(b"far")
    os.symlink(root / "a.txt", root / "link.txt")
    os.symlink(tmp_path / "outside", root / "link_dir")
    os.symlink(root / "nothing", root / "broken.txt")
    os.symlink(root / "circle", root / "circle")
    os.mkfifo(root / "pipe")
    return str(root)


def _own(spark, root, glob=None):
    """What Spark's own source has, in the form of the listing."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (r.option("pathGlobFilter", glob) if glob else r).load(root).collect()
    return sorted((x.path.removeprefix("file:"), x.modificationTime, x.length, bytes(x.content)) for x in rows)


@pytest.mark.parametrize("below, glob", [
    ("", None), ("/sub/..", "{a,b,sp}*.[tT]*"), ("", "[!a]*"), ("/a.txt", None), ("/_under.txt", None), ("/sub{,/deeper}", None), ("/*", "*.txt"),
    ("/bare", None)])
def test_listing_is_that_of_sparks_own_source(spark, tree, below, glob):
    root = tree + below
    want = _own(spark, root, glob)
    files = L.listed(spark, L.local_roots(spark, f"file://{root}"), glob)
    assert sorted((r.path, r.modificationTime, r.length) for r in files.collect()) == [w[:3] for w in want]
    got = L.with_bodies(files, 1 << 30, 100).collect()
    assert sorted((r.path, r.modificationTime, r.length, bytes(r.content)) for r in got) == want


def test_inventory_and_content_are_those_of_sparks_own_source(spark, tree):
    want = _own(spark, tree)
    got = S.read_content(spark, f"{tree}/").collect()
    assert sorted((r.path, r.last_modified, r.size_bytes, bytes(r.content)) for r in got) == [
        (p, int(t.timestamp()), n, c) for p, t, n, c in want]
    assert sorted((r.path, r.size_bytes) for r in S.inventory(spark, tree).collect()) == [(w[0], w[2]) for w in want]


def test_roots_that_spark_itself_lists(spark, tree, tmp_path):
    assert L.local_roots(spark, f"{tree}/nowhere") is None and L.local_roots(spark, f"{tree}/nowhere*") is None
    for job in (S.inventory, S.read_content):
        with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
            job(spark, f"{tree}/nowhere")
    # of what a stream has written, only what it has committed counts
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.range(3).selectExpr("string(id) AS value").coalesce(1).write.text(src)
    q = spark.readStream.schema("value string").text(src).writeStream.format("text").option("checkpointLocation", str(tmp_path / "ckpt")) \
        .trigger(availableNow=True).start(out)
    q.awaitTermination()
    (tmp_path / "out/uncommitted.txt").write_bytes(b"x")
    assert L.local_roots(spark, out) is None
    assert [r.name for r in S.inventory(spark, out).collect() if r.name == "uncommitted.txt"] == []


def test_names_beyond_ascii(spark, tmp_path):
    (tmp_path / "été 中.txt").write_bytes(b"x")
    assert [(r.name, bytes(r.content)) for r in S.with_path_parts(S.read_content(spark, str(tmp_path))).collect()] == [("été 中.txt", b"x")]


def test_bodies_as_they_are_when_read(spark, tmp_path):
    for n in ("a", "b", "gone"):
        (tmp_path / n).write_bytes(b"1234")
    files = L.listed(spark, [str(tmp_path)])
    (tmp_path / "b").write_bytes(b"123456789")
    os.remove(tmp_path / "gone")
    with pytest.raises(Exception, match="gone"):
        L.with_bodies(files, 8, 12).collect()
    spark.conf.set("spark.sql.files.ignoreMissingFiles", "true")
    try:
        rows = L.with_bodies(files, 8, 12).collect()
    finally:
        spark.conf.unset("spark.sql.files.ignoreMissingFiles")
    assert sorted((os.path.basename(r.path), r.length, r.content) for r in rows) == [("a", 4, b"1234"), ("b", 9, None)]


def test_only_wanted_bodies_are_read(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.txt").write_bytes(b"x" * (i + 1))
    wanted = spark.createDataFrame([(f"{tmp_path}/1.txt",), (f"{tmp_path}/3.txt",), (f"{tmp_path}/other.txt",)], "path string")
    got = S.read_content(spark, str(tmp_path), wanted)
    os.remove(tmp_path / "4.txt")  # or the read would fail
    assert sorted((r.path[-5:], r.size_bytes, len(r.content)) for r in got.collect()) == [("1.txt", 2, 2), ("3.txt", 4, 4)]


def _many(spark, root, n):
    S.write_corpus(spark.range(n).selectExpr("id AS doc_id", "'s' AS source", "'en' AS lang", "string(id) AS text"), root)


def test_inventory_does_not_hold_the_files_in_the_driver(spark, tmp_path):
    _many(spark, f"{tmp_path}/tree", 1000)
    got = S.inventory(spark, f"{tmp_path}/tree")
    assert got.count() == 1000 and len(got.inputFiles()) <= 8 * spark.sparkContext.defaultParallelism


def test_content_does_not_hold_the_files_in_the_driver(spark, tmp_path):
    _many(spark, f"{tmp_path}/tree", 1000)
    got = S.read_content(spark, f"{tmp_path}/tree")
    assert got.count() == 1000 and len(got.inputFiles()) <= 8 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("per_trigger", [None, 300])
def test_index_stream_does_not_hold_the_files_in_the_driver(spark, tmp_path, monkeypatch, per_trigger):
    from filelens.operators import embed
    from filelens.streaming import jobs
    root, at = f"{tmp_path}/tree", {}
    _many(spark, root, 1000)
    for i in range(1000):  # the higher the number, the older
        os.utime(f"{root}/source=s/lang=en/doc_{i}.txt", (0, 1_700_000_000 - i))
    monkeypatch.setattr(jobs, "scratch_path", lambda spark, name: at.setdefault(name, f"{tmp_path}/{name}"))
    index = jobs.stream_index(spark, root, lambda df: embed.hashed_embed(df, id_col="file_id"), max_files_per_trigger=per_trigger)
    # the files that the stream keeps in the driver and in its log
    logs = [f for f in G.glob(f"{at['stream-ckpt']}/sources/0/*") if not f.endswith(".crc")]
    kept = [json.loads(x) for f in logs for x in open(f).read().splitlines()[1:]]
    assert len(kept) <= 8 * spark.sparkContext.defaultParallelism
    got = store.read_current(spark, index, with_version=True).withColumn("n", F.regexp_extract("path", r"doc_(\d+)", 1).cast("int"))
    took = {r.version: (r.a, r.b, r.c) for r in got.groupBy("version").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count("*").alias("c")).collect()}
    # the oldest come first
    assert took == ({1: (700, 999, 300), 2: (400, 699, 300), 3: (100, 399, 300), 4: (0, 99, 100)} if per_trigger else {1: (0, 999, 1000)})
    assert [(r.arrived, r.inserted) for r in jobs.read_counters(spark, index).orderBy("batch_id").collect()] == [
        (c, c) for _, (_, _, c) in sorted(took.items())]
