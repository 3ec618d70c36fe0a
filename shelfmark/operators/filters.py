"""Row filters over a manifest. All are map-only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths

DEFAULT_MAX_DEPTH = 1024  # fixed value


def drop_hidden(manifest: DataFrame) -> DataFrame:
    """Drop files below a hidden directory, hidden files, and hidden roots."""
    below = F.concat(F.lit("/"), paths.relative_path("source_path", "root_dir"))
    return manifest.filter(
        ~below.contains("/.") & ~paths.base_name(paths.clean_path("root_dir")).rlike("^[.].")
    )


def limit_depth(manifest: DataFrame, max_depth: int = DEFAULT_MAX_DEPTH) -> DataFrame:
    """Keep files at most ``max_depth`` directories below the root (0: root files only)."""
    rel = paths.relative_path("source_path", "root_dir")
    return manifest.filter(paths.depth(rel) <= max(max_depth, 0))


def drop_quarantined(manifest: DataFrame) -> DataFrame:
    """Drop direct children of ``<root>/duplicates``; deeper ones stay."""
    return manifest.filter(~is_quarantined())


def is_quarantined():
    path = F.col("source_path")
    return path == paths.joined_path("root_dir", paths.QUARANTINE, paths.base_name(path))


def effective(plan: DataFrame) -> DataFrame:
    """Drop operations that would change nothing: skips and moves onto themselves."""
    return plan.filter(
        (F.col("op_type") != "skip") & ~F.col("dest_path").eqNullSafe(F.col("source_path"))
    )
