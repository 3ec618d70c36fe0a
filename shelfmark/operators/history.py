"""History and undo over the transaction log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.numbering import number_rows
from shelfmark.functions.skew import attach_groups
from shelfmark.schemas import TXN_OPS, TXN_UNDO
from shelfmark.session import materialize


def type_label(ttype: str) -> Column:
    return F.when(F.col(ttype) == TXN_UNDO, "undo").otherwise("action")


def history_listing(transactions: DataFrame) -> DataFrame:
    """One row per transaction of a nested log: id, type, number of operations, root.

    Lines of one ``txn_seq`` are one transaction; its root is that of its first operation.
    Lines without ``txn_seq`` stand for themselves. ``compact_id`` is the id with blanks
    replaced, for one-line output.
    """
    alone = F.when(F.col("txn_seq").isNull(), F.monotonically_increasing_id())
    n_ops = F.greatest(F.coalesce(F.size("Operations"), F.lit(0)), F.lit(0)).cast("bigint")
    root = F.get("Operations", F.lit(0))["File"]["RootDir"]
    lines = transactions.select(
        "txn_seq", alone.alias("_alone"), F.col("ID").alias("id"), "TType", n_ops.alias("n"), root.alias("root"),
        F.coalesce("first_op", F.lit(0)).alias("first_op"),
    )
    return (
        lines.groupBy("txn_seq", "_alone")
        .agg(
            F.any_value("id").alias("id"),
            F.any_value("TType").alias("ttype"),
            F.sum("n").alias("n_operations"),
            F.min_by("root", "first_op").alias("root"),
        )
        .select(
            "txn_seq",
            "id",
            F.replace("id", F.lit(" "), F.lit("_")).alias("compact_id"),
            type_label("ttype").alias("type"),
            "n_operations",
            F.coalesce("root", F.lit("")).alias("root_dir"),
        )
    )


def transactions(log: DataFrame) -> DataFrame:
    """One row per transaction of a flat log; its root is that of its first operation."""
    return log.groupBy("txn_seq").agg(
        F.any_value("id").alias("id"),
        F.any_value("ttype").alias("ttype"),
        F.any_value("irreversible").alias("irreversible"),
        F.count("*").alias("n_operations"),
        F.min_by("root_dir", "op_seq").alias("root_dir"),
    )


def flat_history_listing(log: DataFrame) -> DataFrame:
    """The same listing of a flat log, one row per transaction."""
    return transactions(log).select(
        "txn_seq",
        "id",
        F.replace("id", F.lit(" "), F.lit("_")).alias("compact_id"),
        type_label("ttype").alias("type"),
        "n_operations",
        F.coalesce("root_dir", F.lit("")).alias("root_dir"),
    )


def last_transactions(headers: DataFrame) -> DataFrame:
    """Last transaction of each root and whether it can be undone."""
    last = F.max_by(F.struct("txn_seq", "id", "ttype", "irreversible", "n_operations"), "txn_seq")
    status = (
        F.when(F.col("ttype") == TXN_UNDO, "already_undone")
        .when(F.col("irreversible"), "irreversible")
        .otherwise("undoable")
    )
    return (
        headers.filter("n_operations > 0")
        .groupBy("root_dir")
        .agg(last.alias("last"))
        .select("root_dir", "last.*")
        .withColumn("status", status)
    )


def _undoable(last: DataFrame) -> DataFrame:
    return last.filter("status = 'undoable'").select(
        "txn_seq", F.col("n_operations").alias("n_ops")
    )


def _operations_of(log: DataFrame, undoable: DataFrame) -> DataFrame:
    """Log rows of the given transactions, one of which may hold most of the log."""
    return attach_groups(
        log,
        materialize(undoable, "undoable"),
        ["txn_seq"],
        spread_by="source_path",
        weight="n_ops",
        how="inner",
    )


def undo_plan(log: DataFrame, last: DataFrame) -> DataFrame:
    """Operations that revert the last transaction of every root that can be undone."""
    return _operations_of(log, _undoable(last)).select(
        "txn_seq",
        "op_seq",
        "op_type",
        "root_dir",
        F.col("dest_path").alias("source_path"),
        "size",
        F.col("source_path").alias("dest_path"),
    )


def undo_log(log: DataFrame, last: DataFrame, first_txn_seq: int) -> DataFrame:
    """Log rows that record those undos: same ids and operations, type undo."""
    undone = number_rows(_undoable(last), ["txn_seq"], name="undo_no")
    return (
        _operations_of(log, undone)
        .withColumn("txn_seq", F.col("undo_no") + (first_txn_seq - 1))
        .withColumn("ttype", F.lit(TXN_UNDO))
        .select(*TXN_OPS.fieldNames())
    )
