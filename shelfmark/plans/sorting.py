"""Sorting a scanned tree by its rule file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from shelfmark.operators import filters
from shelfmark.operators.classify import classify
from shelfmark.operators.ignore import hide
from shelfmark.plans.planning import plan
from shelfmark.sources.ignore_files import load_ignore_rules
from shelfmark.sources.rule_files import RuleSet


def sort_plan(
    manifest: DataFrame,
    rules: RuleSet,
    ignore_files: Sequence[str] = (),
    max_depth: int = filters.DEFAULT_MAX_DEPTH,
) -> DataFrame:
    """Effective moves, in plan order, of the visible files of a manifest.

    The ``!`` lines of the rule file come before the patterns of ``ignore_files``.
    """
    ignored = load_ignore_rules(manifest.sparkSession, ignore_files, rules.ignores)
    visible = filters.limit_depth(hide(filters.drop_hidden(manifest), ignored), max_depth)
    return filters.effective(plan(visible, lambda files: classify(files, rules.rules)))
