"""Row numbers and running counts without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import materialize

# Bits of monotonically_increasing_id that hold the position within a partition.
POSITION_BITS = 33


def number_rows(
    df: DataFrame,
    order_by: Sequence[str],
    *,
    group_by: Sequence[str] = (),
    counting: Column | None = None,
    name: str = "row_no",
) -> DataFrame:
    """Add the running count of ``counting`` rows (default: all) within each group.

    The table is range-partitioned by (group, order), sorted and written once: one
    shuffle and sort (two when only some rows count), and no task holds a whole hot group. The
    id a row gets at writing is its partition and its position there; the rest are
    offsets, one row per partition, or per group and partition it touches.

    ``order_by`` should be unique within a group, else equal rows are in any order.
    """
    spark = df.sparkSession
    groups = list(group_by)
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    flagged = df if counting is None else df.withColumn("_counts", F.coalesce(counting, F.lit(False)))
    ranged = materialize(
        flagged.repartitionByRange(pieces, *groups, *order_by)
        .sortWithinPartitions(*groups, *order_by)
        .withColumn("_at", F.monotonically_increasing_id()),
        "ranged",
    )
    if counting is not None:
        return _running(ranged, groups, name, F.col("_counts").cast("long"))
    ranged = ranged.withColumn("_piece", F.shiftright("_at", POSITION_BITS))
    before = Window.partitionBy(*groups).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*groups, "_piece")
        .agg(F.count("*").alias("_piece_count"), F.min("_at").alias("_first"))
        .select(
            *[F.col(g).alias(f"_of_{g}") for g in groups],
            F.col("_piece").alias("_of_piece"),
            (F.coalesce(F.sum("_piece_count").over(before), F.lit(0)) - F.col("_first") + 1).alias("_offset"),
        )
    )
    if not groups:
        offsets = F.broadcast(offsets)  # one row per partition
    same = F.col("_piece") == F.col("_of_piece")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    return ranged.join(offsets, same).select(*df.columns, (F.col("_at") + F.col("_offset")).alias(name))


def running_sum(
    df: DataFrame, order_by: Sequence[str], value: str, *, group_by: Sequence[str] = (), name: str = "so_far"
) -> DataFrame:
    """Add the sum of ``value`` over the rows of the group up to and including this one.

    As in ``number_rows``: no task holds a whole hot group, if ``order_by`` tells its rows apart.
    """
    groups = list(group_by)
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(
        df.repartitionByRange(pieces, *groups, *order_by)
        .sortWithinPartitions(*groups, *order_by)
        .withColumn("_at", F.monotonically_increasing_id()),
        "ranged",
    )
    return _running(ranged, groups, name, F.col(value))


def _running(ranged: DataFrame, groups: list[str], name: str, flag: Column) -> DataFrame:
    """Running sum of ``flag``: in the piece by a window, plus what earlier pieces have."""
    keys = [*groups, "_piece"]
    ranged = ranged.withColumn("_piece", F.shiftright("_at", POSITION_BITS))
    before = Window.partitionBy(*groups).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys)
        .agg(F.sum(flag).alias("_piece_count"))
        .select(
            *[F.col(k).alias(f"_of_{k}") for k in keys],
            F.coalesce(F.sum("_piece_count").over(before), F.lit(0)).alias("_offset"),
        )
    )
    within = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    columns = [c for c in ranged.columns if c not in ("_counts", "_at", "_piece")]
    return (
        ranged.withColumn("_so_far", F.sum(flag).over(within))
        .join(offsets, same)
        .select(*columns, (F.col("_so_far") + F.col("_offset")).alias(name))
    )


def running_max(df: DataFrame, order_by: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the largest ``value`` of all rows up to and including this one, in order.

    As in ``number_rows``: one range partitioning and sort, a window within each piece, and
    what earlier pieces reached, one row for each piece. Null values count for nothing.
    """
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(
        df.repartitionByRange(pieces, *order_by).sortWithinPartitions(*order_by).withColumn("_at", F.monotonically_increasing_id()),
        "ranged",
    ).withColumn("_piece", F.shiftright("_at", POSITION_BITS))
    up_to = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    reached = ranged.groupBy("_piece").agg(F.max(value).alias("_m"))
    reached = reached.select(F.col("_piece").alias("_of_piece"), F.max("_m").over(up_to).alias("_before"))
    within = Window.partitionBy("_piece").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.withColumn("_in_piece", F.max(value).over(within))
        .join(F.broadcast(reached), F.col("_piece") == F.col("_of_piece"))  # one row per partition
        .select(*df.columns, F.greatest("_in_piece", "_before").alias(name))
    )
