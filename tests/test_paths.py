import pytest
from pyspark.sql import functions as F

from filelens.functions import paths as P


@pytest.mark.parametrize("name,ext", [
    ("a.txt", ".txt"), ("b.tar.gz", ".gz"), (".bashrc", ""), ("trail.", "."), ("noext", ""),
    ("UP.TXT", ".TXT"), ("sp ace.txt", ".txt"), ("we[ird]", ""),
])
def test_extension(spark, name, ext):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(P.extension("n").alias("e")).first()["e"] == ext


@pytest.mark.parametrize("path,want", [
    ("/a//b/./c", "/a/b/c"), ("/a/b/../c", "/a/c"), ("/../a", "/a"), ("a/../../b", "../b"),
    ("./", "."), ("/", "/"), ("/x/y/..", "/x"), ("a/./b//", "a/b"),
])
def test_normalize(spark, path, want):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(P.normalize_path("p").alias("n")).first()["n"] == want


def test_name_and_uri(spark):
    df = spark.createDataFrame([("file:/tmp/x/y.txt",), ("file:///tmp/z",)], "p string")
    out = df.select(P.file_name(P.strip_uri("p")).alias("n"), P.strip_uri("p").alias("s")).collect()
    assert [(r.s, r.n) for r in out] == [("/tmp/x/y.txt", "y.txt"), ("/tmp/z", "z")]


def test_url_name(spark):
    df = spark.createDataFrame([("https://h.example.com/en/page.html?x=1#t",)], "u string")
    assert df.select(P.url_path_name("u").alias("n")).first()["n"] == "page.html"
