"""Rule files: ``Folder=keyword,regex(pattern),*`` lines, ``!`` ignore lines."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.regexes import PatternError, to_java
from shelfmark.functions.text import numbered_lines, trim_space


@dataclass
class RuleSet:
    """``rules``: one row per matcher (a folder without a valid one keeps a row
    with ``raw`` null); ``ignores``: the ``!`` patterns; ``warnings``: per line."""

    rules: DataFrame
    ignores: DataFrame
    warnings: DataFrame


def _go_quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"'))


def _lines(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    line = F.col("line")
    parts = F.split(line, "=", 2)
    kind = (
        F.when(line.startswith("//") | line.startswith("#") | (trim_space(line) == ""), "comment")
        .when(line.startswith("!"), "ignore")
        .when(F.size(parts) < 2, "no_equals")
        .when(trim_space(parts[0]) == "", "no_folder")
        .otherwise("rule")
    )
    return numbered_lines(df, text, keys).select(
        *keys,
        "line_no",
        kind.alias("kind"),
        trim_space(F.substr(line, F.lit(2))).alias("pattern"),
        trim_space(parts[0]).alias("folder"),
        F.get(parts, F.lit(1)).alias("matchers"),
    )


def _with_matchers(lines: DataFrame) -> DataFrame:
    """Rule lines with their matchers: array of (matcher_idx, raw, is_regex, problem)."""

    def parsed(piece: Column, at: Column) -> Column:
        trimmed = trim_space(piece)
        opened, closed = trimmed.startswith("regex("), trimmed.endswith(")")
        inner = F.substr(trimmed, F.lit(7), F.length(trimmed) - 7)
        problem = F.when(trimmed == "", "empty").when(opened & ~closed, "malformed")
        return F.struct(
            at.alias("matcher_idx"),
            F.when(opened & closed, inner).otherwise(trimmed).alias("raw"),
            (opened & closed).alias("is_regex"),
            problem.alias("problem"),
        )

    ruled = lines.filter("kind = 'rule'").withColumn(
        "matchers", F.transform(F.split("matchers", ",", -1), parsed)
    )
    # Only lines with a regex matcher visit Python, where its syntax is checked.
    any_regex = F.exists("matchers", lambda m: m["is_regex"])
    patterns = F.transform("matchers", lambda m: F.when(m["is_regex"], m["raw"]))
    checked = F.zip_with(
        "matchers",
        _pattern_problems(patterns),
        lambda m, p: m.withField("problem", F.coalesce(m["problem"], p)),
    )
    return ruled.filter(~any_regex).unionByName(
        ruled.filter(any_regex).withColumn("matchers", checked)
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def _pattern_problems(lists: pd.Series) -> pd.Series:
    def problem(pattern: str | None) -> str | None:
        if pattern is not None:
            try:
                to_java(pattern)
            except PatternError:
                return "invalid"
        return None

    return lists.map(lambda patterns: [problem(p) for p in patterns])


def parse_rule_files(files: DataFrame, text: str = "text", keys: list[str] | None = None) -> RuleSet:
    """Parse whole rule files, one per row; ``keys`` tell files apart.

    ``rule_idx`` is the line number: earlier lines win.
    """
    keys = keys or []
    lines = _lines(files, text, keys)
    ruled = _with_matchers(lines)
    valid = F.filter("matchers", lambda m: m["problem"].isNull())
    rules = ruled.select(*keys, "line_no", "folder", F.explode_outer(valid).alias("m")).select(
        *keys,
        F.col("line_no").alias("rule_idx"),
        "m.matcher_idx",
        "folder",
        "m.raw",
        F.coalesce("m.is_regex", F.lit(False)).alias("is_regex"),
    )
    ignores = lines.filter("kind = 'ignore'").select(*keys, "line_no", "pattern")

    # The wording of warnings.
    line_no = F.col("line_no").cast("string")
    skipped = lines.filter("kind in ('no_equals', 'no_folder')").select(
        *keys,
        "line_no",
        F.lit(-1).alias("matcher_idx"),
        F.concat(
            F.lit("line "),
            line_no,
            F.when(F.col("kind") == "no_equals", F.lit(" ignored: missing '='")).otherwise(
                F.lit(" ignored: empty folder name")
            ),
        ).alias("message"),
    )
    message = (
        F.when(
            F.col("problem") == "empty",
            F.concat(F.lit("empty matcher in folder "), _go_quoted(F.col("folder"))),
        )
        .when(
            F.col("problem") == "malformed",
            F.concat(F.lit("malformed regex matcher "), _go_quoted(F.col("raw"))),
        )
        .otherwise(F.concat(F.lit("invalid regex "), _go_quoted(F.col("raw"))))
    )
    bad = F.filter("matchers", lambda m: m["problem"].isNotNull())
    dropped = ruled.select(*keys, "line_no", "folder", F.explode(bad).alias("m")).select(
        *keys, "line_no", "folder", "m.*"
    ).select(
        *keys,
        "line_no",
        "matcher_idx",
        F.concat(F.lit("line "), line_no, F.lit(": "), message).alias("message"),
    )
    return RuleSet(rules, ignores, skipped.unionByName(dropped))


def load_rules(spark: SparkSession, path: str) -> RuleSet:
    """Read one rule file; a file without any rule is an error."""
    found = parse_rule_files(spark.read.text(path, wholetext=True), "value")
    if found.rules.isEmpty():
        raise ValueError(f"no rules in {path}")
    return found


def parse_inline(df: DataFrame, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """Parse single rules given inline, one per row. Any bad matcher fails the job."""
    keys = keys or []
    trimmed = trim_space(F.col(text))
    parts = F.split(trimmed, "=", 2)
    bad = (F.size(parts) < 2) | (trim_space(parts[0]) == "")
    checked = F.when(
        bad,
        F.raise_error(
            F.concat(F.lit("invalid inline syntax "), _go_quoted(F.col(text)), F.lit(': expected "Folder=kw1,kw2"'))
        ).cast("string"),
    ).otherwise(trim_space(parts[0]))
    lines = df.select(
        *keys,
        F.lit(1).alias("line_no"),
        F.lit("rule").alias("kind"),
        checked.alias("folder"),
        F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("matchers"),
    )
    matchers = (
        _with_matchers(lines)
        .select(*keys, "folder", F.explode("matchers").alias("m"))
        .select(*keys, "folder", "m.*")
        .filter("problem is null or problem <> 'empty'")
    )
    raw = F.when(
        F.col("problem").isNotNull(),
        F.raise_error(F.concat(F.col("problem"), F.lit(" regex matcher "), _go_quoted(F.col("raw")))).cast("string"),
    ).otherwise(F.col("raw"))
    return matchers.select(
        *keys, F.lit(0).alias("rule_idx"), "matcher_idx", "folder", raw.alias("raw"), "is_regex"
    )


def rule_listing(rules: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per rule: its folder and its matchers in order, comma-joined.

    A group is one line of a rule file.
    """
    keys = keys or []
    shown = F.when(F.col("is_regex"), F.concat(F.lit("regex("), F.col("raw"), F.lit(")"))).otherwise(
        F.col("raw")
    )
    item = F.struct("matcher_idx", shown.alias("shown"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("raw").isNotNull(), item)))
    return rules.groupBy(*keys, "rule_idx", "folder").agg(
        F.array_join(F.transform(ordered, lambda x: x["shown"]), ", ").alias("matchers")
    )
