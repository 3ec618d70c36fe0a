"""The transaction log.

Two layouts: JSON lines with nested operations, to exchange logs, and a flat
table with one row per operation, which is what operators work on.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.plans.planning import op_code, op_name
from shelfmark.schemas import TXN_ACTION, TXN_JSON, TXN_OPS
from shelfmark.sources.lines import file_lines, with_line_numbers
from shelfmark.sources.listing import put_if_absent

# Most operations on one line of a nested log written here.
LINE_OPERATIONS = 10_000


def append_json_log(transactions: DataFrame, path: str) -> None:
    """Append transactions (``nest_operations``) as gzipped JSON lines; existing files stay untouched.

    Names of fields and the beginnings of paths repeat in every operation, so the fastest level will do.
    """
    writer = transactions.select(*TXN_JSON.fieldNames()).write.mode("append").option("zlib.compress.level", "BEST_SPEED")
    writer.json(path, compression="gzip")


def read_json_log(spark: SparkSession, path: str) -> DataFrame:
    """Read JSON lines; blank lines are skipped, a malformed line fails the job."""
    return spark.read.schema(TXN_JSON).option("mode", "FAILFAST").json(path)


def import_json_log(spark: SparkSession, path: str) -> DataFrame:
    """Read a log whose lines carry no ``txn_seq``: the line number (from 0, blank lines
    count) is the order. ``path`` is a file, or a folder of files that follow each other by name.

    A file is read in splits by many tasks (``lines.with_line_numbers``).
    """
    parsed = F.from_json("line", TXN_JSON, {"mode": "FAILFAST"})
    return (
        with_line_numbers(file_lines(spark, path), [])
        .filter("trim(line) <> ''")
        .select("line_no", parsed.alias("txn"))
        .select("txn.*", "line_no")
        .withColumn("txn_seq", F.coalesce("txn_seq", "line_no"))
        .drop("line_no")
    )


def flatten_log(transactions: DataFrame) -> DataFrame:
    """Nested log to one row per operation; transactions without operations vanish.

    Lines that continue a transaction go on where the line before stopped.
    """
    return transactions.select(
        "txn_seq",
        F.col("ID").alias("id"),
        F.col("TType").alias("ttype"),
        F.col("Irreversible").alias("irreversible"),
        F.coalesce("first_op", F.lit(0)).alias("first_op"),
        F.posexplode("Operations").alias("pos", "op"),
    ).select(
        "txn_seq",
        "id",
        "ttype",
        "irreversible",
        (F.col("first_op") + F.col("pos")).alias("op_seq"),
        op_name("op.OpType").alias("op_type"),
        F.col("op.File.RootDir").alias("root_dir"),
        F.col("op.File.SourcePath").alias("source_path"),
        F.col("op.File.Size").alias("size"),
        F.col("op.DestPath").alias("dest_path"),
    )


def nest_operations(log: DataFrame, line_operations: int = LINE_OPERATIONS) -> DataFrame:
    """Flat log as JSON transactions, their operations in order of ``op_seq``.

    A transaction is one line up to ``line_operations``; larger ones continue on further
    lines with the same txn_seq, so that no task has to hold a whole transaction. They still
    are one transaction: ``history.history_listing`` and ``flatten_log`` put them together.
    Reading back counts operations from 0; if they were counted so, without gaps, ``op_seq`` returns.
    """
    op = F.struct(
        op_code("op_type").alias("OpType"),
        F.struct(
            F.col("root_dir").alias("RootDir"),
            F.col("source_path").alias("SourcePath"),
            F.col("size").alias("Size"),
        ).alias("File"),
        F.col("dest_path").alias("DestPath"),
        F.col("size").alias("Size"),
    )
    line = F.floor(F.col("op_seq") / line_operations)
    ordered = F.array_sort(F.collect_list(F.struct("op_seq", op.alias("op"))))
    return (
        log.groupBy("txn_seq", "id", "ttype", "irreversible", line.alias("line"))
        .agg(F.transform(ordered, lambda x: x["op"]).alias("Operations"))
        .select(
            F.col("id").alias("ID"),
            F.col("ttype").alias("TType"),
            "Operations",
            F.col("irreversible").alias("Irreversible"),
            "txn_seq",
            (F.col("line") * line_operations).cast("bigint").alias("first_op"),
        )
    )


def next_txn_seq(log: DataFrame) -> int:
    last = log.agg(F.max("txn_seq")).first()[0]
    return 0 if last is None else last + 1


def transaction(
    numbered_plan: DataFrame, txn_id: str, txn_seq: int, irreversible: bool = False
) -> DataFrame:
    """Flat log rows of one applied plan (with ``op_seq``)."""
    return numbered_plan.select(
        F.lit(txn_seq).cast("bigint").alias("txn_seq"),
        F.lit(txn_id).alias("id"),
        F.lit(TXN_ACTION).alias("ttype"),
        F.lit(irreversible).alias("irreversible"),
        "op_seq",
        "op_type",
        "root_dir",
        "source_path",
        "size",
        "dest_path",
    )


def append_log(ops: DataFrame, path: str) -> None:
    """Append flat rows as new files; a failed job leaves the log as it was."""
    ops.select(*TXN_OPS.fieldNames()).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TXN_OPS).option("recursiveFileLookup", "true").parquet(path)


def claim_txn_seq(spark: SparkSession, path: str) -> int:
    """The next free sequence number of a log, claimed for the caller alone.

    Writers may append at the same time: a number is taken by creating a file that must not
    be there yet, and who comes second tries the next one. A writer that fails afterwards
    leaves its number unused. Claims lie in a folder that readers of the log skip.
    """
    try:
        seq = next_txn_seq(read_log(spark, path))
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        seq = 0
    while not put_if_absent(spark, f"{path.rstrip('/')}/_claims/{seq:019d}"):
        seq += 1
    return seq


def append_transaction(
    spark: SparkSession, path: str, numbered_plan: DataFrame, txn_id: str, irreversible: bool = False
) -> int:
    """Append one applied plan (with ``op_seq``) under a number of its own; returns the number.

    It goes to a folder of its own: jobs that write to one folder at the same time would
    clear away each other's temporary files.
    """
    seq = claim_txn_seq(spark, path)
    append_log(transaction(numbered_plan, txn_id, seq, irreversible), f"{path.rstrip('/')}/{seq:019d}")
    return seq
