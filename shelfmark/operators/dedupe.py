"""Exact duplicates by content.

Content is hashed once, in the projection of the scan, and never crosses a
shuffle: everything below works on a narrow table of hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.functions.skew import attach_groups
from shelfmark.operators.filters import is_quarantined
from shelfmark.functions.text import failing_on
from shelfmark.session import materialize

PREFIX_BYTES = 4096  # fixed value

BY_SIZE = ["size"]
BY_PREFIX = ["size", "partial_sha256"]
BY_CONTENT = ["sha256"]


def prefix_hash(content: Column | str) -> Column:
    return F.sha2(F.substring(content, 1, PREFIX_BYTES), 256)


def content_hash(content: Column | str) -> Column:
    return F.sha2(content, 256)


def hash_manifest(manifest: DataFrame, content: str = "content") -> DataFrame:
    """Replace the binary column ``content`` by its prefix hash and full hash."""
    return manifest.withColumns(
        {
            "partial_sha256": prefix_hash(F.col(content)),
            "sha256": content_hash(F.col(content)),
        }
    ).drop(content)


def group_counts(files: DataFrame, keys: list[str]) -> DataFrame:
    """Number of files and bytes per key; map-side combined."""
    return files.groupBy(*keys).agg(
        F.count("*").alias("n_files"), F.sum("size").alias("total_bytes")
    )


def candidates(files: DataFrame, keys: list[str]) -> DataFrame:
    """Keep files whose ``keys`` occur at least twice."""
    shared = materialize(
        files.groupBy(*keys).agg(F.count("*").alias("n_files")).filter("n_files > 1"), "shared"
    )
    return attach_groups(files, shared, keys, spread_by="source_path", how="inner").drop("n_files")


def duplicate_groups(hashed: DataFrame) -> DataFrame:
    """One row per content held by several files, with the file that stays.

    The survivor is the first in walk order. ``min`` combines map-side, so the
    size of a group (all empty files share one hash) does not matter.
    """
    first = F.min(paths.walk_key("source_path"))
    return (
        hashed.groupBy("sha256")
        .agg(
            F.count("*").alias("n_files"),
            F.sum("size").alias("total_bytes"),
            first.alias("first"),
        )
        .filter("n_files > 1")
        .select("sha256", "n_files", "total_bytes", paths.path_of_key("first").alias("keeper"))
    )


def _dedupe_ops(hashed: DataFrame, how: str) -> DataFrame:
    groups = materialize(
        duplicate_groups(hashed.filter(~is_quarantined())).select("sha256", "n_files", "keeper"),
        "duplicate-groups",
    )
    return attach_groups(hashed, groups, BY_CONTENT, spread_by="source_path", how=how)


def dedupe_plan(hashed: DataFrame) -> DataFrame:
    """One ``dedupe`` row per file whose content occurs earlier in walk order.

    ``hashed`` is read twice; pass a written table when hashing is dear.
    """
    extra = _dedupe_ops(hashed.filter(~is_quarantined()), "inner").filter(
        "source_path <> keeper"
    )
    return extra.select(
        "root_dir",
        "source_path",
        "size",
        F.lit("dedupe").alias("op_type"),
        paths.quarantine_path("root_dir", "source_path", "sha256").alias("dest_path"),
    )


def dedupe_full_plan(hashed: DataFrame) -> DataFrame:
    """One row per file of the manifest: ``dedupe`` or ``skip``.

    Skips keep their path and size, so they can be counted.
    """
    moved = (
        ~is_quarantined() & F.col("keeper").isNotNull() & (F.col("source_path") != F.col("keeper"))
    )
    target = paths.quarantine_path("root_dir", "source_path", "sha256")
    return _dedupe_ops(hashed, "left").select(
        "root_dir",
        "source_path",
        "size",
        F.when(moved, "dedupe").otherwise("skip").alias("op_type"),
        F.when(moved, target).alias("dest_path"),
    )


def missing_hashes(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """Files without a hash; must be empty before planning."""
    known = hashes.filter(F.col("sha256").isNotNull()).select("source_path")
    return files.join(known, "source_path", "left_anti")


def require_hashes(hashed: DataFrame) -> DataFrame:
    """Fail the job on the first file without a hash."""
    problem = F.when(F.col("sha256").isNull(), F.concat(F.lit("hash missing for "), F.coalesce("source_path", F.lit("?"))))
    return hashed.filter(failing_on(problem))


def cached_hashes(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Left join of the cache: a hit needs the same path, size and mtime.

    The join is by path alone, as the cache is bucketed; the rest is compared on the pairs.
    """
    entry = cache.select(
        F.col("source_path").alias("_path"), F.struct("size", "mtime").alias("_print"), F.col("sha256").alias("_cached")
    )
    same = F.struct("size", "mtime") == F.col("_print")
    return files.join(entry, files["source_path"] == F.col("_path"), "left").select(
        *files.columns, F.when(same, F.col("_cached")).alias("cached_sha256")
    )


def resolve_hashes(
    files: DataFrame, cache: DataFrame, hash_files: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Add ``sha256`` and ``from_cache``; only cache misses reach ``hash_files``.

    ``hash_files`` adds ``sha256`` to the rows it is given.
    """
    looked_up = materialize(cached_hashes(files, cache), "cache-lookup")
    hits = looked_up.filter("cached_sha256 is not null").withColumnRenamed("cached_sha256", "sha256")
    misses = looked_up.filter("cached_sha256 is null").drop("cached_sha256")
    return hits.withColumn("from_cache", F.lit(True)).unionByName(
        require_hashes(hash_files(misses)).withColumn("from_cache", F.lit(False))
    )


def scan_statistics(hashed: DataFrame) -> DataFrame:
    """Counters of the duplicate funnel in one row.

    ``hashed`` has one row per scanned file with ``partial_sha256``, ``sha256``
    and ``from_cache``. Files are combined per content first; the counters of
    the coarser keys follow from those groups, so there is one large shuffle.
    """
    valid = ~is_quarantined()
    per_content = (
        hashed.withColumn("valid", valid)
        .groupBy("valid", "size", "partial_sha256", "sha256")
        .agg(
            F.count("*").alias("n"),
            F.count_if("from_cache").alias("hits"),
        )
    )
    per_prefix = per_content.groupBy("valid", "size", "partial_sha256").agg(
        F.sum("n").alias("n"),
        F.sum("hits").alias("hits"),
        F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)).alias("dedupes"),
    )
    per_size = per_prefix.groupBy("valid", "size").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("full"),
        F.sum(F.when(F.col("n") > 1, F.col("hits")).otherwise(0)).alias("hits"),
        F.sum("dedupes").alias("dedupes"),
    )
    shared = F.col("valid") & (F.col("n") > 1)
    misses = F.col("full") - F.col("hits")

    def total(value: Column, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, value)), F.lit(0)).cast("bigint")

    return per_size.agg(
        total(F.col("n"), F.lit(True)).alias("files_seen"),
        total(F.col("n"), shared).alias("partial_hashed"),
        total(misses, shared).alias("full_hashed"),
        total(F.col("hits"), shared).alias("cache_hits"),
        total(misses, shared).alias("cache_misses"),
        total(misses * F.col("size"), shared).alias("bytes_hashed"),
        total(F.col("dedupes"), F.col("valid")).alias("dedupes"),
    )
