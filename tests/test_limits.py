"""Many rules, odd roots, invalid patterns, and checks that cannot be pruned."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.functions.regexes import PatternError, to_java
from shelfmark.operators import classify, dedupe, filters, ignore
from shelfmark.operators.rename import mapped_names
from shelfmark.plans.planning import plan_summary

RULES = "rule_idx int, matcher_idx int, folder string, raw string, is_regex boolean"


@pytest.mark.parametrize("n", [500, 5000])
def test_many_rules(spark, manifest, n):
    rows = [Row(rule_idx=i, matcher_idx=0, folder=f"f{i}", raw=f"<{i}>", is_regex=False) for i in range(n)]
    rows += [Row(rule_idx=n, matcher_idx=i, folder="one", raw=f"[{i}]", is_regex=False) for i in range(n)]
    files = manifest([f"/r/a<{n - 1}>", "/r/a<7>", f"/r/[{n - 1}]", "/r/none"])
    got = {r.source_path: r.dest_path for r in classify.classify_case(files, rows).collect()}
    assert got == {
        f"/r/a<{n - 1}>": f"/r/f{n - 1}/a<{n - 1}>", "/r/a<7>": "/r/f7/a<7>", f"/r/[{n - 1}]": f"/r/one/[{n - 1}]", "/r/none": None
    }


@pytest.mark.parametrize("n", [500, 2000])
def test_many_patterns_explained(manifest, n):
    rules = [Row(ord=i, pattern=f"n{i}", source="s") for i in range(n)]
    got = ignore.explain_ignored(manifest([f"/r/n{n - 1}", "/r/n"]), rules).collect()
    assert {r.source_path: r.pattern for r in got} == {f"/r/n{n - 1}": f"n{n - 1}", "/r/n": None}


@pytest.mark.parametrize("root", ["/data", "/data/", "s3://b/p", "s3://b", "s3://b/", "/", "/x/../data"])
def test_forms_agree_on_roots(spark, manifest, monkeypatch, root):
    rules = spark.createDataFrame([(0, 0, "./f//g", "a", False), (1, 0, "../up", "b", False), (2, 0, "rx", "^c[0-9]$", True)], RULES)
    clean = root.rstrip("/")
    files = manifest([f"{clean}/xa", f"{clean}/d/b1", f"{clean}/c7", f"{clean}/z"], root=root)
    want = sorted(map(str, classify.classify_join(files, rules).collect()))
    for limit in (0, 1000):
        monkeypatch.setattr(classify, "CASE_LIMIT", max(limit, 1))
        assert sorted(map(str, classify.classify(files, rules).collect())) == want
    assert filters.drop_quarantined(manifest([f"{clean}/duplicates/a", f"{clean}/duplicates/x/a"], root=root)).count() in (1, 2)


def test_quarantine_of_unclean_root(manifest):
    for root, base in (("/data/", "/data"), ("s3://b/p/", "s3://b/p"), ("s3://b", "s3://b"), ("/", "")):
        left = filters.drop_quarantined(manifest([f"{base}/duplicates/a", f"{base}/duplicates/x/a", f"{base}/a"], root=root))
        assert sorted(r.source_path for r in left.collect()) == [f"{base}/a", f"{base}/duplicates/x/a"]


@pytest.mark.parametrize(
    "path, want",
    [
        ("s3://b/x//y/../z/", "s3://b/x/z"), ("s3://b", "s3://b"), ("s3://b/", "s3://b"), ("s3://b/../../c", "s3://b/c"),
        ("a://", "a://"), ("file:///a//b", "file:///a/b"), ("/a//b/.", "/a/b"), ("", "."), ("a/../..", ".."), ("x:/y//z", "x:/y/z"),
    ],
)
def test_clean_path(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(paths.clean_path("p").alias("c")).first().c == want


@pytest.mark.parametrize("pad", ["", " ", "\t", "\u00a0", "\u3000", "\x1f"])
def test_padded_patterns_agree(spark, manifest, pad):
    files = manifest(["/r/build/x", "/r/a/build/y", "/r/c"])
    rules = spark.createDataFrame([(pad + "build" + pad,)], "pattern string")
    literal = ignore.drop_ignored(files, [r.pattern for r in rules.collect()])
    assert sorted(literal.collect()) == sorted(ignore.drop_ignored_join(files, rules).collect())
    assert literal.count() == (3 if pad == "\x1f" else 1)


@pytest.mark.parametrize(
    "pattern",
    [
        "[z-a]", r"[a-\d]", r"\p{Foo}", r"\p{greek}", r"\p{Lx}", r"\x{110000}", "(?P<a>x)(?P<a>y)", "(a{1000}){1000}",
        "((a{100}){100}){2}", "a**", "x{2,1}", "x{1001}", "[a", "(", ")",
    ],
)
def test_refused_patterns(pattern):
    with pytest.raises(PatternError):
        to_java(pattern)


@pytest.mark.parametrize(
    "pattern, text, hit",
    [
        (r"[\d-a]+", "1-a", True), ("^[a-]$", "-", True), ("^[]a]+$", "]a", True), (r"^\p{Greek}$", "α", True), (r"^\p{Old_Italic}", "a", False),
        (r"^\p{Any}$", "\n", True), ("(?m:^a$)\nb$", "a\nb", True), ("(?m:x)a$", "xa\nb", False), ("(?m)xa$", "xa\nb", True),
        ("(a{10}){100}", "a", False), ("((?m)a)b$", "ab\n", False), (r"^[\x{41}-\x{43}]$", "B", True), ("^[+--]$", ",", True),
    ],
)
def test_accepted_patterns(spark, pattern, text, hit):
    assert spark.createDataFrame([(text,)], "t string").filter(F.col("t").rlike(to_java(pattern))).count() == hit


def test_checks_are_not_pruned(spark, manifest):
    files = manifest(["/r/a", "/r/b"])
    twice = spark.createDataFrame([("/r/a", "x"), ("/r/a", "y"), ("/r/b", "z")], "source_path string, new_name string")
    with pytest.raises(Exception, match="several names"):
        mapped_names(files, twice).count()
    with pytest.raises(Exception, match="unknown file"):
        mapped_names(files.limit(1), twice.filter("new_name <> 'y'")).count()
    hashed = files.withColumn("sha256", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="hash missing"):
        dedupe.require_hashes(hashed).count()


def test_null_operation_is_not_the_total(spark):
    plan = spark.createDataFrame([("move",), (None,)], "op_type string")
    assert sorted(map(tuple, plan_summary(plan).collect()), key=str) == [("move", 1), ("total", 2), (None, 1)]
