import os

import pytest
from pyspark.sql import functions as F

from filelens.sources import walk as W


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "tree"
    for d in ("sub/deeper/deepest", ".git", "_meta", "we[ird]", "bare"):
        (root / d).mkdir(parents=True)
    for name, body in {"a.txt": b"hello", ".hidden.txt": b"h", "_under.txt": b"u", "empty.txt": b"", "sub/b.TXT": b"deep",
                       "sub/deeper/deepest/c": b"c", ".git/config": b"cfg", "_meta/m.txt": b"m",
                       "we[ird]/sp ace.txt": b"spaced"}.items():
        (root / name).write_bytes(body)
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside/far.txt").write_bytes(b"far")
    os.symlink(root / "a.txt", root / "link.txt")         # a link to a file is a file
    os.symlink(tmp_path / "outside", root / "link_dir")   # not followed
    os.symlink(root, root / "sub/loop")
    os.symlink(root / "nothing", root / "broken.txt")
    os.mkfifo(root / "pipe")
    return str(root)


def expected(root):
    """Every regular file of os.walk, which does not follow links to folders."""
    return {os.path.join(d, f) for d, _, files in os.walk(root) for f in files if os.path.isfile(os.path.join(d, f))}


def test_walk_lists_all_regular_files(spark, tree):
    rows = W.walk(spark, tree).collect()
    assert len(rows) == 10 and {r.path for r in rows} == expected(tree)
    by = {r.name: r for r in rows}
    assert by["empty.txt"].size_bytes == 0 and by["link.txt"].size_bytes == 5
    assert by["a.txt"].last_modified == int(os.path.getmtime(f"{tree}/a.txt"))
    assert by[".hidden.txt"].extension == ".txt" and by["c"].extension == "" and by["b.TXT"].extension == ".TXT"


def test_walk_of_other_roots(spark, tree, tmp_path):
    assert {r.path for r in W.walk(spark, f"file://{tree}/").collect()} == expected(tree)
    assert W.walk(spark, f"{tree}/bare").count() == 0
    assert W.walk(spark, str(tmp_path / "missing")).count() == 0


def test_names_that_are_not_utf8(spark, tmp_path):
    try:
        (tmp_path / os.fsdecode(b"b\xffd.txt")).write_bytes(b"x")
    except OSError:
        pytest.skip("file system refuses such names")
    got = W.walk(spark, str(tmp_path))
    assert [r.name for r in got.collect()] == ["b�d.txt"]
    assert [(r.status, r.text) for r in W.text_pieces(got).collect()] == [("no_text", None)]


BODIES = {
    "ascii.txt": b"0123456789" * 7,
    "wide.txt": "aé中\U0001f600".encode() * 40,
    "invalid.txt": b"ok \xff\xfe \xe2\x82 \x80\x80\x80\x80\x80\x80 \xf0\x90 end \xc3" * 9,
    "conts.txt": b"\x80" * 50,
    "empty.txt": b"",
    "one.txt": b"x",
    "exact.txt": b"y" * 32,
}


@pytest.mark.parametrize("limit", [1, 2, 3, 7, 16, 1 << 20])
def test_pieces_hold_every_byte_once(spark, tmp_path, limit):
    for name, body in BODIES.items():
        (tmp_path / name).write_bytes(body)
    files = W.walk(spark, str(tmp_path))
    got = {}
    for r in W.read_pieces(files, limit).collect():
        got.setdefault(os.path.basename(r.path), []).append((r.piece, r.offset, bytes(r.content)))
    texts = {}
    for r in W.text_pieces(files, limit).collect():
        assert r.status != "too_large"
        texts.setdefault(os.path.basename(r.path), []).append((r.piece, r.text))
    whole = {r.n: r.t for r in spark.createDataFrame([(n, bytearray(b)) for n, b in BODIES.items()], "n string, b binary")
             .select("n", F.make_valid_utf8(F.col("b").cast("string")).alias("t")).collect()}
    assert got.keys() == BODIES.keys()
    for name, body in BODIES.items():
        pieces = sorted(got[name])
        assert b"".join(p[2] for p in pieces) == body
        assert [p[1] for p in pieces] == [sum(len(q[2]) for q in pieces[:i]) for i in range(len(pieces))]
        assert max(len(p[2]) for p in pieces) <= limit + 3
        # repaired piece by piece as the whole is
        assert "".join(t for _, t in sorted(texts[name])) == whole[name]


def test_a_file_that_went_is_one_row(spark, tmp_path):
    files = spark.createDataFrame([(str(tmp_path / "gone.txt"), ".txt", 100)], "path string, extension string, size_bytes long")
    assert [(r.piece, r.status, r.text) for r in W.text_pieces(files, 10).collect()] == [(0, "no_text", None)]
    assert W.read_pieces(files.where("false"), 10).count() == 0


def test_written_files_are_found(spark, tmp_path):
    rows = spark.range(300).select(F.concat(F.lit("d"), F.col("id") % 7, F.lit("/.x/_"), "id").alias("path"),
                                   F.repeat(F.lit("z"), F.col("id").cast("int")).cast("binary").alias("content"))
    assert W.write_files(rows.repartition(5), str(tmp_path)) == 300
    got = W.walk(spark, str(tmp_path)).select("name", "size_bytes").collect()
    assert {(r.name, r.size_bytes) for r in got} == {(f"_{i}", i) for i in range(300)}
