"""Ignore rules from their ordered sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.text import numbered_lines, trim_space, without_return
from shelfmark.schemas import IGNORE_RULES
from shelfmark.sources.lines import file_lines, with_line_numbers

CONFIG_SOURCE = "config"  # fixed value: source of patterns from a rule file

# Order of a rule: file number and line number in one bigint. No row of text has 2^31 lines.
LINE_BITS = 32


def _ord(file_ord: Column, line_no: Column) -> Column:
    return F.shiftleft(file_ord.cast("bigint"), LINE_BITS) + line_no


def parse_ignore_files(files: DataFrame, text: str = "text") -> DataFrame:
    """Parse whole ignore files, one per row with ``file_ord`` and ``source``.

    Order is (file, line); blank lines and comments are dropped.
    """
    return _rules_of(numbered_lines(files, text, ["file_ord", "source"]))


def _rules_of(lines: DataFrame) -> DataFrame:
    return (
        lines.withColumn("pattern", trim_space(F.col("line")))
        .filter("pattern <> '' and not startswith(pattern, '#') and not startswith(pattern, '//')")
        .select(
            _ord(F.col("file_ord"), F.col("line_no")).alias("ord"),
            F.regexp_replace("pattern", r"/\z", "").alias("pattern"),
            "source",
        )
    )


def config_ignores(ignores: DataFrame) -> DataFrame:
    """Patterns of a rule file (``line_no``, ``pattern``) as ignore rules of source ``config``."""
    return ignores.filter("pattern <> ''").select(
        _ord(F.lit(0), F.col("line_no")).alias("ord"),
        F.regexp_replace("pattern", r"/\z", "").alias("pattern"),
        F.lit(CONFIG_SOURCE).alias("source"),
    )


def first_occurrences(rules: DataFrame) -> DataFrame:
    """One row per (source, pattern), ordered by its first occurrence."""
    return (
        rules.groupBy("source", "pattern")
        .agg(F.min("ord").alias("ord"))
        .select("ord", "pattern", "source")
    )


def load_ignore_rules(
    spark: SparkSession, files: Sequence[str], config: DataFrame | None = None
) -> DataFrame:
    """Rules of the rule file first, then of each existing file in the given order.

    A file may be as large as it likes: it is read in splits (``lines.with_line_numbers``),
    and may be a folder of files that follow each other by name.
    """
    present = None
    for i, path in enumerate(files, start=1):
        lines = _lines_if_present(spark, path)
        if lines is not None:
            lines = lines.select(F.lit(i).cast("bigint").alias("file_ord"), F.lit(path).alias("source"), "*")
            present = lines if present is None else present.unionByName(lines)
    found = None if config is None else config_ignores(config)
    if present is not None:
        lines = with_line_numbers(present, ["file_ord", "source"]).withColumns(
            {"line_no": F.col("line_no") + 1, "line": without_return(F.col("line"))}
        )
        found = _rules_of(lines) if found is None else found.unionByName(_rules_of(lines))
    return spark.createDataFrame([], IGNORE_RULES) if found is None else first_occurrences(found)


def _lines_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return file_lines(spark, path)
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
