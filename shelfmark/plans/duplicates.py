"""The duplicate funnel over files: size, then prefix, then content.

Each stage reads content only for files the stage before could not tell apart,
and hashes of earlier runs are reused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import dedupe, filters
from shelfmark.session import materialize
from shelfmark.sources.content import with_content_hash, with_prefix_hash
from shelfmark.sources.hash_cache import read_cache, save_cache


def hash_candidates(manifest: DataFrame, cache_path: str | None = None) -> DataFrame:
    """Files that may be duplicates, with ``sha256`` and ``from_cache``.

    ``manifest`` needs ``mtime`` when a cache is used; new hashes are added to it.
    """
    spark = manifest.sparkSession
    files = filters.drop_quarantined(manifest)
    same_size = dedupe.candidates(files, dedupe.BY_SIZE)
    same_prefix = dedupe.candidates(
        materialize(with_prefix_hash(same_size), "prefix-hashes"), dedupe.BY_PREFIX
    )
    if cache_path is None:
        return materialize(with_content_hash(same_prefix), "hashed").withColumn(
            "from_cache", F.lit(False)
        )

    hashed = materialize(
        dedupe.resolve_hashes(same_prefix, read_cache(spark, cache_path), with_content_hash), "hashed"
    )
    save_cache(spark, cache_path, hashed.filter("not from_cache"))
    return hashed


def duplicates_plan(manifest: DataFrame, cache_path: str | None = None) -> DataFrame:
    """Dedupe plan of a scanned tree."""
    return dedupe.dedupe_plan(hash_candidates(manifest, cache_path))
