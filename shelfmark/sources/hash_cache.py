"""Content hashes kept between runs, keyed by path, valid for one size and mtime.

A cache is a folder of generations. A generation is a table in buckets by path, to which
deltas are appended: what a run found out, under a growing number. The last delta of a path
counts; a delta without hash is a tombstone. Since rows of a path are always in the same
bucket, neither finding the last delta nor joining the cache to files by path shuffles the
cache. ``compact_cache`` writes the entries that count as the first delta of the next
generation; readers take the highest generation that was completely written.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.schemas import HASH_CACHE
from shelfmark.sources.listing import put_if_absent, subfolders

_COLUMNS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in HASH_CACHE.fields) + ", delta bigint"
_GENERATION, _WRITTEN = "generation=", "_written="


def _generations(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(number, buckets) of the generations that were completely written."""
    names = subfolders(spark, path)
    done = {n.removeprefix(_WRITTEN) for n in names if n.startswith(_WRITTEN)}
    found = [n.removeprefix(_GENERATION) for n in names if n.startswith(_GENERATION)]
    return sorted(tuple(map(int, n.split("-"))) for n in found if n in done)


def _table(spark: SparkSession, path: str, number: int, buckets: int) -> str:
    """Name of the generation as a table of the session; where it is, and its buckets, are fixed."""
    location = f"{path.rstrip('/')}/{_GENERATION}{number}-{buckets}"
    name = f"hash_cache_{hashlib.sha1(location.encode()).hexdigest()}"
    spark.sql(
        f"create table if not exists {name} ({_COLUMNS}) using parquet "
        f"clustered by (source_path) into {buckets} buckets location '{location}'"
    )
    return name


def _append(entries: DataFrame, name: str, buckets: int, delta: int) -> None:
    """One file a bucket: rows are dealt out as the table is."""
    rows = entries.select(*HASH_CACHE.fieldNames(), F.lit(delta).cast("bigint").alias("delta"))
    rows.repartition(buckets, "source_path").write.insertInto(name)


def _new_generation(spark: SparkSession, path: str, number: int, entries: DataFrame) -> None:
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    _append(entries, _table(spark, path, number, buckets), buckets, 0)
    put_if_absent(spark, f"{path.rstrip('/')}/{_WRITTEN}{number}-{buckets}/done")


def _open(spark: SparkSession, path: str) -> tuple[str, int, int] | None:
    """Table, buckets and last delta of the cache; None if it is missing or unreadable."""
    try:
        generations = _generations(spark, path)
        if not generations:
            return None
        number, buckets = generations[-1]
        name = _table(spark, path, number, buckets)
        spark.catalog.refreshTable(name)
        last = spark.table(name).agg(F.max("delta")).first()[0]
    except Exception as err:
        if not _unreadable(err):
            raise
        return None
    return name, buckets, -1 if last is None else last


def _unreadable(err: Exception) -> bool:
    if isinstance(err, AnalysisException):
        return err.getCondition() == "PATH_NOT_FOUND"
    return any(text in str(err) for text in ("CANNOT_READ_FILE_FOOTER", "is not a Parquet file", "CANNOT_READ_FILE"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Entries that count; a missing or unreadable cache is an empty one."""
    found = _open(spark, path)
    if found is None:
        return spark.createDataFrame([], HASH_CACHE)
    name, _, last = found
    rows = spark.table(name)
    if last > 0:
        value = F.max_by(F.struct("size", "mtime", "sha256"), "delta").alias("v")
        rows = rows.groupBy("source_path").agg(value).select("source_path", "v.*")
    return rows.filter("sha256 is not null").select(*HASH_CACHE.fieldNames())


def save_cache(spark: SparkSession, path: str, fresh: DataFrame) -> bool:
    """Append ``fresh``, whose entries replace those of the same path; False if it is empty.

    What is written is as large as ``fresh``, whatever the cache holds. Files are never
    rewritten, so readers are safe. ``fresh`` names a path once.
    """
    if fresh.isEmpty():
        return False
    found = _open(spark, path)
    if found is None:
        number = max([g for g, _ in _generations(spark, path)], default=-1) + 1
        _new_generation(spark, path, number, fresh)
    else:
        name, buckets, last = found
        _append(fresh, name, buckets, last + 1)
    return True


def drop_from_cache(spark: SparkSession, path: str, gone: DataFrame) -> bool:
    """Forget the paths in ``gone`` (source_path)."""
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in HASH_CACHE.fields if f.name != "source_path"}
    return save_cache(spark, path, gone.select("source_path").distinct().withColumns(nothing))


def compact_cache(spark: SparkSession, path: str) -> bool:
    """Start a generation with just the entries that count; False if there is no cache."""
    if _open(spark, path) is None:
        return False
    number = _generations(spark, path)[-1][0]
    _new_generation(spark, path, number + 1, read_cache(spark, path))
    return True
