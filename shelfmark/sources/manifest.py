"""Scanning a directory tree into a manifest.

Two ways with the same result. ``scan_tree`` lists level by level: the
directories of a level are rows, spread over all tasks, so a deep or lopsided
tree keeps every executor busy. The data source ``file_manifest`` is the plain
``spark.read`` form: one pass, with subtrees as partitions.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shelfmark.functions import globs, paths
from shelfmark.operators.filters import DEFAULT_MAX_DEPTH
from shelfmark.schemas import MANIFEST
from shelfmark.session import materialize
from shelfmark.sources.listing import entries

LOOK = 10_000  # entries of one directory that are read while planning

_LISTED = "source_path string, is_dir boolean, size bigint, mtime_us bigint"


def _list_batches(batches: Iterator) -> Iterator:
    import pandas as pd

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["source_path", "is_dir", "size", "mtime_us"])

    rows = []
    for batch in batches:
        for directory in batch["dir"]:
            for name, *rest in entries(directory):
                rows.append((f"{directory.rstrip('/')}/{name}", *rest))
                if len(rows) == 10_000:
                    yield frame(rows)
                    rows = []
    yield frame(rows)


def scan_tree(
    spark: SparkSession,
    root: str,
    ignore: Sequence[str] = (),
    max_depth: int = DEFAULT_MAX_DEPTH,
    hidden: bool = False,
) -> DataFrame:
    """Manifest of the files below ``root``; hidden, ignored and too deep
    directories are never listed."""
    root = root.rstrip("/") or "/"
    if not hidden and _hidden_root(root):
        return spark.createDataFrame([], MANIFEST)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rel = paths.relative_path("source_path", F.lit(root))
    keep = F.lit(True) if hidden else ~paths.base_name("source_path").startswith(".")
    for pattern in ignore:
        for_file, for_dir = (globs.entry_regex(pattern, d) for d in (False, True))
        if for_file is not None:
            keep = keep & (F.col("is_dir") | ~rel.rlike(for_file))
        if for_dir is not None:
            keep = keep & (~F.col("is_dir") | ~rel.rlike(for_dir))

    level = spark.range(1).select(F.lit(root).alias("dir"))
    found = None
    depth, n_dirs = 0, 1
    while True:
        spread = level.repartition(min(tasks, n_dirs), "dir")
        listed = spread.mapInPandas(_list_batches, _LISTED).filter(keep)
        listed = materialize(listed, "listed")
        files = listed.filter("not is_dir").select(
            F.lit(root).alias("root_dir"),
            "source_path",
            "size",
            F.timestamp_micros("mtime_us").alias("mtime"),
        )
        found = files if found is None else found.unionByName(files)
        level = listed.filter("is_dir").select(F.col("source_path").alias("dir"))
        depth, n_dirs = depth + 1, level.count()
        if depth > max(max_depth, 0) or n_dirs == 0:
            return found


def _base(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def _hidden_root(root: str) -> bool:
    return len(_base(root)) > 1 and _base(root).startswith(".")


def _is_true(option: object) -> bool:
    return str(option).lower() == "true"


def _schema(details: bool) -> T.StructType:
    more = [T.StructField("depth", T.IntegerType()), T.StructField("hidden", T.BooleanType())]
    return T.StructType(MANIFEST.fields + more * details)


class Place:
    """A directory to list: with all below it (``deep``) or only its own files.

    Of a directory with very many entries a place is one of ``shares`` parts, told by a
    hash of the entry's name.
    """

    def __init__(self, directory: str, depth: int, deep: bool, share: int = 0, shares: int = 1):
        self.directory, self.depth, self.deep = directory, depth, deep
        self.share, self.shares = share, shares

    def holds(self, name: str) -> bool:
        return self.shares == 1 or zlib.crc32(name.encode("utf-8", "surrogateescape")) % self.shares == self.share


class Places(InputPartition):
    def __init__(self, places: list[Place]):
        self.places = places


class FileManifestReader(DataSourceReader):
    """Directories that cannot hold a wanted file are not listed.

    What is wanted is told by options, not by ``pushFilters``: Spark 4.1 keeps one read plan
    for a loaded DataFrame, so a filter pushed by one query on it would also be in force in
    the next, and in every other branch of the same query.
    """

    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/") or "/"
        self.max_depth = max(int(options.get("maxdepth", DEFAULT_MAX_DEPTH)), 0)
        self.hidden = _is_true(options.get("hidden"))
        self.details = _is_true(options.get("details"))
        self.target = max(int(options.get("partitions", 64)), 1)
        self.patterns = json.loads(options.get("ignore", "[]"))
        self.prefix = options.get("prefix", "")

    def _pruner(self):
        import re

        def compiled(is_dir: bool):
            found = [globs.entry_regex(p, is_dir) for p in self.patterns]
            return [re.compile(rx.replace("\\z", "\\Z")) for rx in found if rx is not None]

        rules = {d: compiled(d) for d in (False, True)}
        skip = len(self.root.rstrip("/")) + 1

        def pruned(path: str, is_dir: bool) -> bool:
            if not self.hidden and _base(path).startswith("."):
                return True
            inside = f"{path}/" if is_dir else path
            if not inside.startswith(self.prefix) and not (is_dir and self.prefix.startswith(inside)):
                return True
            return any(rx.search(path[skip:]) for rx in rules[is_dir])

        return pruned

    def partitions(self) -> Sequence[InputPartition]:
        """At most ``partitions`` groups of places. The tree is split from the top until there
        are enough places; of a directory no more than ``LOOK`` entries are read here, one with
        more is listed by several tasks, each for its share."""
        if not self.hidden and _hidden_root(self.root):
            return [Places([])]  # a source without partitions would be read once, without a place
        pruned = self._pruner()
        level, done = [Place(self.root, 0, True)], []
        while level and len(level) + len(done) < self.target:
            below = []
            for place in level:
                found = list(itertools.islice(entries(place.directory), LOOK + 1))
                if len(found) > LOOK:
                    done += [Place(place.directory, place.depth, True, i, self.target) for i in range(self.target)]
                    continue
                done.append(Place(place.directory, place.depth, False))
                if place.depth < self.max_depth:
                    paths_below = (f"{place.directory.rstrip('/')}/{name}" for name, is_dir, _, _ in found if is_dir)
                    below += [Place(d, place.depth + 1, True) for d in paths_below if not pruned(d, True)]
            level = below
        places = level + done  # the deep ones first, so that every group gets its part of them
        return [Places(places[i :: self.target]) for i in range(min(self.target, len(places)))]

    def read(self, partition: Places) -> Iterator:
        import pyarrow as pa

        pruned = self._pruner()
        kinds = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.int32(), pa.bool_()]
        schema = pa.schema(list(zip(_schema(self.details).names, kinds)))

        def batch(rows: list):
            arrays = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        skip = len(self.root.rstrip("/"))
        rows: list = []
        stack = list(partition.places)
        while stack:
            place = stack.pop()
            for name, is_dir, size, mtime in entries(place.directory):
                if not place.holds(name):
                    continue
                path = f"{place.directory.rstrip('/')}/{name}"
                if is_dir:
                    if place.deep and place.depth < self.max_depth and not pruned(path, True):
                        stack.append(Place(path, place.depth + 1, True))
                elif not pruned(path, False):
                    more = (place.depth, _hidden_root(self.root) or "/." in path[skip:]) if self.details else ()
                    rows.append((self.root, path, size, mtime, *more))
                    if len(rows) == 10_000:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)


class FileManifestSource(DataSource):
    """``spark.read.format("file_manifest").load(root)``.

    Options: ``maxDepth``, ``hidden``, ``prefix`` (what paths begin with), ``ignore`` (JSON list
    of patterns), ``partitions`` (how many at most) and ``details`` (adds the columns ``depth``, directories between root
    and file, and ``hidden``, whether a name from the root on begins with a dot).
    """

    @classmethod
    def name(cls) -> str:
        return "file_manifest"

    def schema(self):
        return _schema(_is_true({k.lower(): v for k, v in self.options.items()}.get("details")))

    def reader(self, schema) -> FileManifestReader:
        return FileManifestReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileManifestSource)
