"""Lines of text files with their numbers, read in splits by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.session import materialize


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file, or of a folder of files, and where they are; for ``with_line_numbers``.

    A missing path is an analysis error.
    """
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("line"),
    )


def with_line_numbers(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``line_no`` (from 0 within the keys, blank lines count) and ``line``. The files
    of a key follow each other by name.

    A split knows where in the file it begins and gives its lines in order; how many lines
    the splits before it have makes the number.
    """
    lines = materialize(lines, "lines")  # else the numbers of a second reading need not be the same
    splits = lines.groupBy(*keys, "file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy(*keys).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    offset = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")
    offsets = splits.select(*keys, "file", "block", offset.alias("offset"))
    return lines.join(offsets, [*keys, "file", "block"]).select(
        *keys, (F.col("at") + F.col("offset")).alias("line_no"), "line"
    )
