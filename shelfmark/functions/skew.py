"""Joining per-group values back to rows when a group may be huge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A group is hot when it holds at least 1/HOT_GROUPS of all grouped rows, so
# there can never be more than HOT_GROUPS hot groups: that bounds the broadcast.
HOT_GROUPS = 1024
SPREAD = 4096


def attach_groups(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    *,
    spread_by: Column | str,
    weight: str = "n_files",
    how: str = "left",
) -> DataFrame:
    """Join ``groups`` (one row per ``keys``, ``weight`` = its row count) to ``rows``.

    Rows of hot groups meet their group by broadcast. They still pass through
    the second join, with an empty key and a spreading number instead, so no
    task receives a whole hot group and no row takes two paths.

    ``groups`` is read three times: pass a written table, not a dear plan.
    """
    values = [c for c in groups.columns if c not in keys]
    total = groups.agg(F.sum(weight).alias("total")).scalar()
    packed = groups.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], F.struct(*values).alias("_group")
    )
    is_hot = F.col(f"_group.{weight}") * HOT_GROUPS >= total
    hot = F.broadcast(packed.filter(is_hot).withColumnRenamed("_group", "_hot"))
    # Always 0, but no constant to the optimizer, which would drop a constant from the join key.
    slot = F.pmod(F.xxhash64(*[f"_key_{k}" for k in keys]), F.lit(1)).cast("int")
    cold = packed.filter(~is_hot).withColumnRenamed("_group", "_cold").withColumn("_slot", slot)

    on_hot = [F.col(k) == F.col(f"_key_{k}") for k in keys]
    done = F.col("_hot").isNotNull()
    keyless = done
    for k in keys:
        keyless = keyless | F.col(k).isNull()
    spread = F.pmod(F.xxhash64(spread_by), F.lit(SPREAD)).cast("int")
    looked_up = (
        rows.join(hot, on_hot, "left")
        .drop(*[f"_key_{k}" for k in keys])
        .withColumns(
            {
                **{f"_probe_{k}": F.when(~done, F.col(k)) for k in keys},
                "_slot_probe": F.when(keyless, spread).otherwise(F.lit(0)),
            }
        )
    )
    on_cold = [F.col(f"_probe_{k}") == F.col(f"_key_{k}") for k in keys]
    on_cold.append(F.col("_slot_probe") == F.col("_slot"))
    both = looked_up.join(cold, on_cold, "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    if how == "inner":
        both = both.filter(F.col("_found").isNotNull())
    return both.select(*rows.columns, *[F.col(f"_found.{v}").alias(v) for v in values])
