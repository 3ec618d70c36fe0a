import posixpath

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import paths


def evaluate(spark, rows, column):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r.y for r in df.select("i", column.alias("y")).orderBy("i").collect()]


def test_extension_and_stem(spark):
    names = ["a.tar.gz", "noext", "f.", ".bashrc", "a.b\n"]
    assert evaluate(spark, names, paths.extension("x")) == [".gz", "", ".", ".bashrc", ".b\n"]
    assert evaluate(spark, names, paths.stem("x")) == ["a.tar", "noext", "f", "", "a"]


def test_parent_and_base(spark):
    given = ["/a/b", "/a", "a", "a/b/c"]
    assert evaluate(spark, given, paths.parent_dir("x")) == ["/a", "/", ".", "a/b"]
    assert evaluate(spark, given, paths.base_name("x")) == ["b", "a", "a", "c"]


def test_clean_path(spark):
    given = ["", ".", "/", "/..", "/a/../../b", "a/../..", "../a/./b//c/", "/a/b/", "a/./b", "/a.b/..c", "a/..", "./a"]
    want = [posixpath.normpath(p) for p in given]
    assert evaluate(spark, given, paths.clean_path("x")) == want


@pytest.mark.parametrize(
    "folder, want",
    [(".", "/r/n"), ("a/b", "/r/a/b/n"), ("../x", "/x/n"), ("/abs", "/r/abs/n"), ("a/../b", "/r/b/n")],
)
def test_joined_path(spark, folder, want):
    assert evaluate(spark, ["/r"], paths.joined_path("x", folder, F.lit("n"))) == [want]


def test_human_size(spark):
    sizes = [0, 1023, 1024, 1280, 2816, 1048575, 1048576, 5 * 1024**4, 2**60, 2**62]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i int, s bigint")
    got = [r.h for r in df.select("i", paths.human_size("s").alias("h")).orderBy("i").collect()]
    assert got == [
        "0 B", "1023 B", "1.0 KB", "1.2 KB", "2.8 KB", "1024.0 KB", "1.0 MB", "5.0 TB", "1.0 EB", "4.0 EB",
    ]


def test_walk_order_differs_from_string_order(spark):
    df = spark.createDataFrame([("/r/a.txt",), ("/r/a/b",), ("/r/a-b",)], "source_path string")
    assert [r.source_path for r in df.orderBy(paths.walk_key("source_path")).collect()] == [
        "/r/a/b", "/r/a-b", "/r/a.txt",
    ]


def test_quarantine_path(spark):
    import hashlib

    df = spark.createDataFrame([("/r", "/r/x/ü.tar.gz", "0123456789")], "r string, p string, h string")
    path6 = hashlib.sha1("/r/x/ü.tar.gz".encode()).hexdigest()[:6]
    got = df.select(paths.quarantine_path("r", "p", "h").alias("q")).first().q
    assert got == f"/r/duplicates/ü.tar_01234567_{path6}.gz"
