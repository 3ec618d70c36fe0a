import hashlib
import os

import pytest

from checks import queries
from shelfmark.operators import dedupe
from shelfmark.plans.duplicates import duplicates_plan, hash_candidates
from shelfmark.session import work_dir
from shelfmark.sources import content, manifest


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    for path, data in {
        "a.txt": b"abc",
        "_under": b"",
        "a/b": b"abc",
        "a/c/d/e": b"x" * 5000,
        "f/g": b"x" * 4999 + b"y",
        ".hid/x": b"1",
        ".hidden": b"2",
        "build-1/x": b"3",
        "zero": b"",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)
    os.symlink(root / "a", root / "link")
    return root


def scans(spark, root, **options):
    """Both ways to scan, as {relative path: size}."""
    import json

    manifest.register(spark)
    for parts in (1, 3, 64):
        reader = spark.read.format("file_manifest").option("partitions", parts)
        reader = reader.option("ignore", json.dumps(options.get("ignore", [])))
        reader = reader.option("maxDepth", options.get("max_depth", 1024))
        reader = reader.option("hidden", options.get("hidden", False))
        yield relative(reader.load(str(root)), root)
    yield relative(manifest.scan_tree(spark, str(root), **options), root)


def relative(df, root):
    rows = df.collect()
    assert len({r.source_path for r in rows}) == len(rows)
    return {r.source_path.removeprefix(f"{root}/"): r.size for r in rows}


def test_scan(spark, tree):
    for got in scans(spark, tree):
        link = got.pop("link")
        assert link == len(str(tree / "a"))
        assert got == {"a.txt": 3, "_under": 0, "a/b": 3, "a/c/d/e": 5000, "f/g": 5000, "build-1/x": 1, "zero": 0}


def test_scan_prunes(spark, tree):
    for got in scans(spark, tree, ignore=["build", "/a/c", "z*"]):
        assert set(got) == {"a.txt", "_under", "a/b", "f/g", "link"}
    for got in scans(spark, tree, max_depth=1):
        assert set(got) == {"a.txt", "_under", "a/b", "f/g", "build-1/x", "zero", "link"}
    for got in scans(spark, tree, max_depth=0):
        assert set(got) == {"a.txt", "_under", "zero", "link"}
    for got in scans(spark, tree, hidden=True):
        assert {".hid/x", ".hidden"} < set(got)


def test_options_reach_the_scan(spark, tree):
    manifest.register(spark)
    reader = spark.read.format("file_manifest").option("details", True).option("hidden", True)
    files = reader.load(str(tree))
    every = {r.source_path.removeprefix(f"{tree}/"): (r.depth, r.hidden) for r in files.collect()}
    assert every[".hid/x"] == (1, True) and every[".hidden"] == (0, True) and every["a/c/d/e"] == (3, False)
    cases = [
        ({"hidden": False}, lambda p, d, h: not h),
        ({"hidden": False, "maxDepth": 0}, lambda p, d, h: not h and d < 1),
        ({"maxDepth": 1}, lambda p, d, h: d <= 1),
        ({"prefix": f"{tree}/a"}, lambda p, d, h: p.startswith("a")),
        ({"prefix": f"{tree}/a/c/d"}, lambda p, d, h: p.startswith("a/c/d")),
        ({"prefix": f"{tree}/a/", "maxDepth": 1}, lambda p, d, h: p == "a/b"),
        ({"prefix": "/elsewhere"}, lambda p, d, h: False),
    ]
    for options, keeps in cases:
        some = spark.read.format("file_manifest").options(details=True, **{"hidden": True, **options}).load(str(tree))
        both = some.selectExpr("source_path", "1 n").unionByName(files.selectExpr("source_path", "0 n"))
        got = {(r.source_path.removeprefix(f"{tree}/"), r.n) for r in both.collect()}
        assert got == {(p, 0) for p in every} | {(p, 1) for p, (d, h) in every.items() if keeps(p, d, h)}, options
    assert {r.depth for r in files.filter("depth > 1 or hidden").collect()} == {0, 1, 3}


def test_hidden_root(spark, tree):
    for got in scans(spark, tree / ".hid"):
        assert got == {}


def test_ruled_out_folders_are_not_listed(tree):
    reader = manifest.FileManifestReader({"path": str(tree), "prefix": f"{tree}/a/c", "partitions": "64"})
    listed = {place.directory.removeprefix(str(tree)) for group in reader.partitions() for place in group.places}
    assert listed == {"", "/a", "/a/c", "/a/c/d"}


@pytest.mark.parametrize("look", [3, 10_000])
@pytest.mark.parametrize("parts", [1, 2, 5, 100])
def test_partitions_are_bounded(spark, tmp_path, monkeypatch, parts, look):
    monkeypatch.setattr(manifest, "LOOK", look)
    for i in range(7):
        for j in range(i):
            (tmp_path / f"d{i}" / f"e{j}").mkdir(parents=True)
            (tmp_path / f"d{i}" / f"e{j}" / "f").write_bytes(b"1")
        (tmp_path / f"f{i}").write_bytes(b"")
    reader = manifest.FileManifestReader({"path": str(tmp_path), "partitions": str(parts)})
    groups = reader.partitions()
    assert 0 < len(groups) <= parts
    found = [p for g in groups for b in reader.read(g) for p in b.column(1).to_pylist()]
    assert sorted(found) == sorted(str(p) for p in tmp_path.rglob("f*") if p.is_file())


def test_missing_root_fails(spark, tmp_path):
    with pytest.raises(Exception, match="No such file"):
        manifest.scan_tree(spark, str(tmp_path / "nowhere")).collect()


def test_hashes(spark, tree):
    files = manifest.scan_tree(spark, str(tree), ["link"])
    for r in content.with_content_hash(content.with_prefix_hash(files)).collect():
        data = open(r.source_path, "rb").read()
        assert r.sha256 == hashlib.sha256(data).hexdigest()
        assert r.partial_sha256 == hashlib.sha256(data[:4096]).hexdigest()


def test_both_hashes_from_one_read(spark, tree):
    files = manifest.scan_tree(spark, str(tree), ["link"])
    key = lambda df: sorted((r.source_path, r.partial_sha256, r.sha256) for r in df.collect())
    assert key(content.with_hashes(files)) == key(content.with_content_hash(content.with_prefix_hash(files)))


@pytest.mark.parametrize("sizes", [[10 << 30] + [1 << 20] * 999, [1 << 30] * 40, [], [0], [None, 5, None]])
def test_bytes_are_shared_evenly(spark, sizes):
    from pyspark.sql import functions as F

    rows = [(f"/r/{i:04d}", s) for i, s in enumerate(sizes)]
    files = spark.createDataFrame(rows, "source_path string, size bigint")
    dealt = content.in_shares(files, F.col("size"), share_bytes=1 << 30).withColumn("task", F.spark_partition_id())
    got = dealt.collect()
    assert sorted(r.source_path for r in got) == [p for p, _ in rows]
    cost = {r.source_path: (r.size or 0) + content.OPEN_BYTES for r in got}
    share = max(sum(cost.values()) / dealt.rdd.getNumPartitions(), 1)
    for task in {r.task for r in got}:
        mine = [cost[r.source_path] for r in got if r.task == task]
        assert sum(mine) <= share + max(mine)
        assert max(mine) < 2 * share or len(mine) == 1  # a huge file meets no other


def test_unreadable_file_fails(spark, tree):
    files = manifest.scan_tree(spark, str(tree), ["link"])
    files = dedupe.materialize(files, "files")
    (tree / "zero").unlink()
    with pytest.raises(Exception, match="No such file"):
        content.with_content_hash(files).collect()


def test_funnel_and_cache(spark, tree, tmp_path):
    files = manifest.scan_tree(spark, str(tree), ["link"])
    files = dedupe.materialize(files, "files")
    cache = str(tmp_path / "cache")
    plain = {r.source_path: r.dest_path for r in duplicates_plan(files).collect()}
    assert sorted(p.removeprefix(f"{tree}/") for p in plain) == ["a.txt", "zero"]
    cold = hash_candidates(files, cache)
    warm = hash_candidates(files, cache)
    # The long files share size and prefix, so their content is read as well.
    assert cold.filter("from_cache").count() == 0 and cold.count() == 6
    assert warm.filter("not from_cache").count() == 0 and warm.count() == 6
    assert {r.source_path: r.dest_path for r in dedupe.dedupe_plan(warm).collect()} == plain


def test_statistics(spark, tree):
    files = dedupe.materialize(manifest.scan_tree(spark, str(tree), ["link"]), "files")
    hashed = content.with_content_hash(content.with_prefix_hash(files)).selectExpr("*", "false from_cache")
    assert dedupe.scan_statistics(hashed).first().asDict() == {
        "files_seen": 7, "partial_hashed": 6, "full_hashed": 6, "cache_hits": 0,
        "cache_misses": 6, "bytes_hashed": 10006, "dedupes": 2,
    }


def test_work_dir_is_shared_or_refused(spark):
    assert os.path.isdir(work_dir(spark))


def test_tree_is_written_as_by_partition_by(spark, tmp_path):
    """Odd values as folders, rows that share a folder, null and empty texts."""
    odd = ["a", "", None, "x=y/z", "50%", "é ü", "[{^}]", "q\"'#*:?\\", "a\tb\x7f", "..."]
    rows = [(i // 2, None if i % 5 == 0 else f"t{i % 3}" * (i % 4), odd[i % len(odd)]) for i in range(40)] + [(None, "n", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    queries.write_tree(docs, str(tmp_path / "mine"), ["source", "doc_id"])
    docs.repartition(3, "source", "doc_id").write.partitionBy("source", "doc_id").text(str(tmp_path / "spark"))

    def lines(root):
        files = [p for p in root.rglob("*.txt") if not p.name.startswith(".")]
        assert len({p.parent for p in files}) == len(files)
        return {str(p.parent.relative_to(root)): sorted(p.read_bytes().split(b"\n")) for p in files}

    assert lines(tmp_path / "mine") == lines(tmp_path / "spark")
    assert not list((tmp_path / "mine").rglob(".*"))


def test_one_folder_is_written_by_many_tasks(spark, tmp_path):
    docs = spark.range(1000).selectExpr("id doc_id", "repeat('x', 100) text", "'s' source")
    queries.write_tree(docs, str(tmp_path / "t"), ["source"])
    sizes = [p.stat().st_size for p in (tmp_path / "t" / "source=s").iterdir()]
    assert sum(sizes) == 101_000 and len(sizes) == 8 and max(sizes) < 2 * 101_000 / 8
