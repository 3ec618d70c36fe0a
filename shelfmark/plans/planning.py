"""Plans as tables: making, ordering, summarising.

A planner maps a manifest to a plan (``schemas.PLAN``); any function of that
shape can be used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.functions.numbering import number_rows
from shelfmark.schemas import OP_TYPES

Planner = Callable[[DataFrame], DataFrame]


def op_code(op_type: str) -> Column:
    """Number of an operation type, as in the log."""
    names = F.array(*[F.lit(t) for t in OP_TYPES])
    return (F.array_position(names, F.col(op_type)) - 1).cast("int")


def op_name(code: Column | str) -> Column:
    names = F.array(*[F.lit(t) for t in OP_TYPES])
    return F.get(names, code)


def _order() -> dict[str, Column]:
    return {
        "_src": paths.clean_path("source_path"),
        "_dst": paths.clean_path(F.coalesce("dest_path", F.lit(""))),
        "_op": op_code("op_type"),
        "_size": F.col("size"),
    }


def ordered(plan: DataFrame) -> DataFrame:
    """Sort by source, destination, type and size: a range-partitioned sort."""
    return plan.orderBy(*_order().values())


def plan(manifest: DataFrame, planner: Planner) -> DataFrame:
    """Run a planner and put its plan in order."""
    return ordered(manifest.transform(planner))


def numbered(plan: DataFrame) -> DataFrame:
    """Add ``op_seq``, the position of each operation in plan order."""
    keys = _order()
    return number_rows(plan.withColumns(keys), list(keys), name="op_seq").drop(*keys)


def plan_summary(plan: DataFrame) -> DataFrame:
    """Operations per type, and in total."""
    is_total = F.grouping("op_type") == 1
    return plan.rollup("op_type").agg(F.count("*").alias("n_ops"), is_total.alias("_total")).select(
        F.when(F.col("_total"), F.lit("total")).otherwise(F.col("op_type")).alias("op_type"), "n_ops"
    )


def apply_summary(plan: DataFrame, purged: DataFrame | None = None) -> DataFrame:
    """What applying the plan does, in one row. Moves onto themselves do not count.

    ``purged`` (root_dir, n_entries; see ``catalog.purge_count``) counts as deleted, if
    quarantine folders are purged after the plan.
    """
    changes = ~F.col("dest_path").eqNullSafe(F.col("source_path"))

    def done(op_type: str, name: str) -> Column:
        return F.count_if((F.col("op_type") == op_type) & changes).alias(name)

    counts = plan.agg(
        done("move", "moved"),
        done("rename", "renamed"),
        done("dedupe", "deduped"),
        F.count_if(F.col("op_type") == "delete").alias("deleted"),
        F.count_if(F.col("op_type") == "skip").alias("skipped"),
    )
    if purged is None:
        return counts
    none = [F.lit(0).cast("bigint").alias(c) for c in ("moved", "renamed", "deduped")]
    gone = purged.select(*none, F.col("n_entries").alias("deleted"), F.lit(0).cast("bigint").alias("skipped"))
    both = counts.unionByName(gone)
    return both.agg(*[F.sum(c).alias(c) for c in counts.columns])
