"""Reports over manifests and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.functions.numbering import number_rows
from shelfmark.operators.filters import DEFAULT_MAX_DEPTH, drop_hidden, limit_depth

TOP = 5  # fixed value


def top_largest(
    manifest: DataFrame, n: int = TOP, max_depth: int = DEFAULT_MAX_DEPTH
) -> DataFrame:
    """The ``n`` largest visible files; ties go to the smaller path. Ignore rules do not apply."""
    visible = limit_depth(drop_hidden(manifest), max_depth)
    return (
        visible.orderBy(F.col("size").desc(), "source_path")
        .limit(n)
        .select(
            paths.relative_path("source_path", "root_dir").alias("rel_path"),
            "size",
            paths.human_size("size").alias("human_size"),
        )
    )


def in_walk_order(manifest: DataFrame) -> DataFrame:
    return manifest.orderBy(paths.walk_key("source_path"))


def walk_positions(manifest: DataFrame) -> DataFrame:
    """Add ``walk_seq``, the position of each file in walk order."""
    keyed = manifest.withColumn("_key", paths.walk_key("source_path"))
    return number_rows(keyed, ["_key"], name="walk_seq").drop("_key")


def error_class(message: Column | str) -> Column:
    text = F.lower(message)
    return (
        # Texts and classes, first match wins.
        F.when(text.contains("permission denied"), "permission")
        .when(text.contains("file exists"), "collision")
        .when(text.contains("no such file"), "not_found")
        .when(text.contains("directory not empty"), "dir_not_empty")
        .when(text.contains("invalid"), "invalid")
        .otherwise("other")
    )


def error_breakdown(errors: DataFrame) -> DataFrame:
    """Count and first message (by ``seq``) per error class."""
    return errors.groupBy(error_class("msg").alias("category")).agg(
        F.count("*").alias("n_errors"), F.min_by("msg", "seq").alias("example")
    )
