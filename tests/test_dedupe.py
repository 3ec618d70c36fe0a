import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shelfmark.functions.skew import HOT_GROUPS, attach_groups
from shelfmark.operators import dedupe
from shelfmark.session import materialize
from shelfmark.sources.hash_cache import compact_cache, drop_from_cache, read_cache, save_cache
from tests.conftest import paths_of


def with_content(spark, contents, root="/r"):
    rows = [(root, p, len(c), bytearray(c)) for p, c in contents.items()]
    return spark.createDataFrame(rows, "root_dir string, source_path string, size bigint, content binary")


def plan_of(spark, contents):
    return dedupe.dedupe_plan(materialize(dedupe.hash_manifest(with_content(spark, contents)), "h"))


def test_first_in_walk_order_stays(spark):
    assert paths_of(plan_of(spark, {"/r/a.txt": b"abc", "/r/a/b": b"abc", "/r/c": b"abd"})) == ["/r/a.txt"]


def test_empty_files_are_duplicates(spark):
    assert paths_of(plan_of(spark, {"/r/x": b"", "/r/y": b"", "/r/z": b"1"})) == ["/r/y"]


def test_same_prefix_other_content(spark):
    long = b"x" * 5000
    assert paths_of(plan_of(spark, {"/r/1": long + b"a", "/r/2": long + b"b"})) == []


def test_quarantined_files_neither_move_nor_keep(spark):
    files = {"/r/duplicates/a": b"abc", "/r/z": b"abc", "/r/zz": b"abc", "/r/duplicates/s/b": b"abc"}
    assert paths_of(plan_of(spark, files)) == ["/r/z", "/r/zz"]
    full = dedupe.dedupe_full_plan(materialize(dedupe.hash_manifest(with_content(spark, files)), "h"))
    assert {r.source_path: r.op_type for r in full.collect()} == {
        "/r/duplicates/a": "skip", "/r/duplicates/s/b": "skip", "/r/z": "dedupe", "/r/zz": "dedupe",
    }


def test_one_content_holds_most_files(spark):
    files = {f"/r/{i:05d}": (b"same" if i % 3 else str(i).encode()) for i in range(6000)}
    hashed = materialize(dedupe.hash_manifest(with_content(spark, files)), "h")
    plan = dedupe.dedupe_plan(hashed)
    assert plan.count() == 3999
    assert plan.select("dest_path").distinct().count() == 3999
    # Repartitioning the input changes nothing.
    again = dedupe.dedupe_plan(hashed.repartition(13, F.reverse("source_path")))
    assert again.exceptAll(plan).count() == 0 and plan.exceptAll(again).count() == 0


def test_attach_groups_hot_cold_and_missing(spark):
    rows = spark.range(20000).select(
        F.col("id"),
        F.when(F.col("id") < 9000, 0).when(F.col("id") >= 19990, None).otherwise(F.col("id")).alias("k"),
    )
    groups = materialize(
        rows.filter("k is not null and (k = 0 or k % 2 = 0)").groupBy("k").agg(F.count("*").alias("n_files")), "g"
    )
    got = attach_groups(rows, groups, ["k"], spread_by="id")
    assert got.count() == 20000
    assert got.filter("n_files is null").count() == 10 + 10990 // 2
    assert got.filter("k = 0").agg(F.min("n_files"), F.max("n_files")).first() == (9000, 9000)
    inner = attach_groups(rows, groups, ["k"], spread_by="id", how="inner")
    assert inner.count() == 20000 - 10 - 10990 // 2
    total = groups.agg(F.sum("n_files")).first()[0]
    assert groups.filter(F.col("n_files") * HOT_GROUPS >= total).count() <= HOT_GROUPS


def test_hot_groups_are_spread_without_adaptive_execution(spark):
    """With plain shuffle joins no partition gets much more than its share."""
    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        rows = spark.range(40000).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"))
        groups = materialize(rows.groupBy("k").agg(F.count("*").alias("n_files")), "g")
        got = attach_groups(rows, groups, ["k"], spread_by="id")
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 40000 and len(sizes) == 8 and max(sizes) < 2 * 40000 / 8


def test_missing_hash_fails(spark):
    files = spark.createDataFrame([("/r/a", None), ("/r/b", "x")], "source_path string, sha256 string")
    assert paths_of(dedupe.missing_hashes(files.select("source_path"), files)) == ["/r/a"]
    with pytest.raises(Exception, match="hash missing for /r/a"):
        dedupe.require_hashes(files).collect()


def test_cache_needs_the_whole_fingerprint(spark):
    schema = "source_path string, size bigint, mtime timestamp, sha256 string"
    ts = "timestamp'2024-01-01 00:00:00'"
    cache = spark.sql(
        f"select 'a' source_path, 1L size, {ts} mtime, 'ha' sha256 union all "
        f"select 'b', 1L, {ts}, 'hb' union all select 'c', 1L, {ts}, 'hc'"
    ).to(spark.createDataFrame([], schema).schema)
    files = spark.sql(
        f"select 'a' source_path, 1L size, {ts} mtime union all select 'b', 2L, {ts} union all "
        f"select 'c', 1L, {ts} + interval 1 second union all select 'd', 1L, {ts}"
    )
    asked = []

    def hash_files(misses):
        asked.extend(r.source_path for r in misses.collect())
        return misses.withColumn("sha256", F.upper("source_path"))

    got = {r.source_path: (r.sha256, r.from_cache) for r in dedupe.resolve_hashes(files, cache, hash_files).collect()}
    assert got == {"a": ("ha", True), "b": ("B", False), "c": ("C", False), "d": ("D", False)}
    assert sorted(asked) == ["b", "c", "d"]


def test_cache_table(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert read_cache(spark, path).count() == 0
    one = spark.sql("select 'a' source_path, 1L size, timestamp'2024-01-01' mtime, 'x' sha256")
    assert save_cache(spark, path, one)
    assert not save_cache(spark, path, one.limit(0))
    two = one.withColumn("sha256", F.lit("y")).unionByName(one.withColumn("source_path", F.lit("b")))
    assert save_cache(spark, path, two)
    assert {r.source_path: r.sha256 for r in read_cache(spark, path).collect()} == {"a": "y", "b": "x"}


def entry(spark, paths, sha):
    return spark.createDataFrame([(p,) for p in paths], "source_path string").selectExpr(
        "source_path", "1L size", "timestamp'2024-01-01' mtime", f"'{sha}' sha256"
    )


def test_cache_deltas(spark, tmp_path):
    path = str(tmp_path / "cache")

    def entries():
        return {r.source_path: r.sha256 for r in read_cache(spark, path).collect()}

    def rows():
        return sum(pq.read_metadata(f).num_rows for f in (tmp_path / "cache").rglob("*.parquet"))

    assert not compact_cache(spark, path)
    save_cache(spark, path, entry(spark, [f"p{i}" for i in range(1000)], "a"))
    save_cache(spark, path, entry(spark, ["p3", "new"], "b"))
    assert rows() == 1002  # a delta is as large as what is fresh
    drop_from_cache(spark, path, entry(spark, ["p4", "p4", "unknown"], ""))
    assert rows() == 1004
    want = {f"p{i}": "a" for i in range(1000) if i != 4} | {"p3": "b", "new": "b"}
    assert entries() == want
    assert compact_cache(spark, path) and entries() == want
    save_cache(spark, path, entry(spark, ["p4"], "c"))
    assert entries() == want | {"p4": "c"}
    # A generation that was not completely written is not read.
    (tmp_path / "cache" / "generation=9-8").mkdir()
    assert entries() == want | {"p4": "c"}


def test_lookup_does_not_shuffle_the_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    for sha in "ab":
        save_cache(spark, path, entry(spark, [f"p{i}" for i in range(100)], sha))
    files = entry(spark, ["p1", "x"], "").drop("sha256")
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = dedupe.cached_hashes(files, read_cache(spark, path))
        assert {r.source_path: r.cached_sha256 for r in found.collect()} == {"p1": "b", "x": None}
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)
    assert plan.count("Exchange hashpartitioning") == 1  # that of the files


def test_corrupt_cache_is_empty(spark, tmp_path):
    path = str(tmp_path / "cache")
    save_cache(spark, path, entry(spark, ["a"], "x"))
    for file in (tmp_path / "cache").rglob("*.parquet"):
        file.write_bytes(b"junk")
        (file.parent / f".{file.name}.crc").unlink()
    assert read_cache(spark, path).count() == 0
    assert save_cache(spark, path, entry(spark, ["b"], "y"))
    assert [r.source_path for r in read_cache(spark, path).collect()] == ["b"]
