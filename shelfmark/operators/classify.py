"""Rule classification: each file goes to the folder of its first matching rule.

Matchers see the base name only. ``*`` is a fallback, and the last ``*`` rule
wins; a name that itself contains ``*`` hits it like any keyword.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import paths
from shelfmark.functions.fragments import regex_fragments
from shelfmark.functions.regexes import to_java
from shelfmark.functions.skew import attach_groups
from shelfmark.operators import matching
from shelfmark.session import materialize

CASE_LIMIT = 500


def _in_order(rules: Sequence[Row]) -> list[Row]:
    return sorted((r for r in rules if r.raw is not None), key=lambda r: (r.rule_idx, r.matcher_idx))


def _hit(name: Column, rule: Row) -> Column:
    # Literal patterns are compiled once per task.
    return name.rlike(to_java(rule.raw)) if rule.is_regex else name.contains(rule.raw)


def _fallback(rules: Sequence[Row]) -> str | None:
    stars = [r.folder for r in _in_order(rules) if r.raw == "*" and not r.is_regex]
    return stars[-1] if stars else None


def _first_hit(name: Column, rules: Sequence[Row], value) -> Column:
    """``value(rule)`` of the first matcher that hits, as one flat CASE of any length."""
    found = None
    for rule in rules:
        hit = _hit(name, rule)
        found = F.when(hit, value(rule)) if found is None else found.when(hit, value(rule))
    return F.lit(None) if found is None else found


def _plan(manifest: DataFrame, folder: Column) -> DataFrame:
    """Move plan from the folder of each file, null for none; the same for both forms."""
    dest = paths.joined_path("root_dir", F.col("_folder"), paths.base_name("source_path"))
    moves = F.col("_folder").isNotNull()
    return manifest.withColumn("_folder", folder).select(
        "root_dir",
        "source_path",
        "size",
        F.when(moves, "move").otherwise("skip").alias("op_type"),
        F.when(moves, dest).alias("dest_path"),
    )


def classify_case(manifest: DataFrame, rules: Sequence[Row]) -> DataFrame:
    """Move plan by rules known when the plan is built: map-only, no shuffle."""
    name = paths.base_name("source_path")
    folder = _first_hit(F.col("_name"), _in_order(rules), lambda r: F.lit(r.folder)).cast("string")
    fallback = F.lit(_fallback(rules)).cast("string")
    return _plan(manifest.withColumn("_name", name), F.coalesce(folder, fallback))


@F.pandas_udf(
    T.StructType([T.StructField("regex", T.StringType()), T.StructField("fragments", T.ArrayType(T.StringType()))])
)
def _translated(patterns: pd.Series) -> pd.DataFrame:
    """Patterns as Java's, with their fragments."""
    return pd.DataFrame(
        {"regex": patterns.map(to_java), "fragments": patterns.map(regex_fragments)}, columns=["regex", "fragments"]
    )


def classify_join(manifest: DataFrame, rules: DataFrame) -> DataFrame:
    """Move plan by a rule table of any size.

    Distinct names meet keywords and regular expressions by fragments they must hold
    (``matching.matches``): no nested loop over rules, except for patterns without any
    certain character, and no rule passes the driver.
    """
    rules = rules.filter("raw is not null")
    hit = F.struct("rule_idx", "matcher_idx", "folder")
    by_raw = materialize(
        rules.groupBy("raw", F.coalesce("is_regex", F.lit(False)).alias("is_regex")).agg(F.min(hit).alias("hit")), "matchers"
    )
    star = rules.filter("raw = '*' and not is_regex").agg(F.max(hit).alias("hit")).first().hit
    keywords = by_raw.filter("not is_regex").select(
        "hit", F.lit(matching.CONTAINS).alias("test"), F.col("raw").alias("fragment"), F.lit(None).cast("string").alias("regex")
    )
    patterns = by_raw.filter("is_regex").select("hit", _translated("raw").alias("t"))
    patterns = patterns.select(
        "hit", F.lit(matching.REGEX).alias("test"), F.explode_outer("t.fragments").alias("fragment"), "t.regex"
    )
    names = materialize(
        manifest.groupBy(paths.base_name("source_path").alias("text")).agg(F.count("*").alias("n_files")), "names"
    )
    hits = matching.matches(names.select("text"), materialize(keywords.unionByName(patterns), "patterns"))
    first = hits.groupBy("text").agg(F.min("hit").alias("hit"))
    fallback = F.lit(star.folder if star else None).cast("string")
    folders = materialize(
        names.join(first, "text", "left").select(
            F.col("text").alias("_name"), "n_files", F.coalesce(F.col("hit.folder"), fallback).alias("_to")
        ),
        "name-folders",
    )
    named = manifest.withColumn("_name", paths.base_name("source_path"))
    found = attach_groups(named, folders, ["_name"], spread_by="source_path")
    return _plan(found, F.col("_to"))


def classify(manifest: DataFrame, rules: DataFrame) -> DataFrame:
    """Pick the form by the checked size of the rule table; both give the same rows."""
    head = rules.limit(CASE_LIMIT + 1).collect()
    return classify_case(manifest, head) if len(head) <= CASE_LIMIT else classify_join(manifest, rules)
