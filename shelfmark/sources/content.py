"""Hashing the content of files where they lie, on the executors.

Rows are small but their files are not, so files are dealt to tasks by bytes: in path
order, the bytes so far are cut into equal shares, and a file belongs to the share its
middle byte lies in. No task reads more than one share and half a file at either end; a
file that covers whole shares has one of them to itself.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.numbering import running_sum
from shelfmark.operators.dedupe import PREFIX_BYTES
from shelfmark.sources.listing import hashes_of

OPEN_BYTES = 1 << 16  # opening a file costs as much as reading this many bytes
SHARE_BYTES = 4 << 30  # most bytes wanted in a task, beyond one task for each shuffle partition


def in_shares(files: DataFrame, read_bytes: Column, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """Deal files to tasks so that each has about the same ``read_bytes`` to read.

    Null sizes and paths are fine: they count as an opened file. Rows of equal path count
    one after the other. The partitions are numbered, so adaptive execution leaves them.
    """
    spark = files.sparkSession
    cost = F.coalesce(read_bytes, F.lit(0)).cast("bigint") + OPEN_BYTES
    dealt = running_sum(files.withColumn("_cost", cost), ["source_path"], "_cost", name="_so_far")
    total = dealt.agg(F.max("_so_far")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // share_bytes))
    middle = F.col("_so_far") - F.col("_cost") / 2
    share = F.least(F.floor(middle * tasks / max(total, 1)), F.lit(tasks - 1)).cast("int")
    return dealt.withColumn("_share", share).repartitionById(tasks, "_share").select(*files.columns)


def _hashed(files: DataFrame, read_bytes: Column, columns: dict[str, int], prefix: bool, whole: bool) -> DataFrame:
    """Add the named items of ``hashes_of``."""

    def add_hashes(batches: Iterator) -> Iterator:
        for batch in batches:
            found = [hashes_of(p, PREFIX_BYTES if prefix else None, whole) for p in batch["source_path"]]
            yield batch.assign(**{c: [h[i] for h in found] for c, i in columns.items()})

    added = [T.StructField(c, T.StringType()) for c in columns]
    schema = T.StructType([*files.schema.fields, *added])
    return in_shares(files, read_bytes).mapInPandas(add_hashes, schema)


def with_prefix_hash(files: DataFrame) -> DataFrame:
    """Add ``partial_sha256`` of the first bytes; an unreadable file fails the job."""
    return _hashed(files, F.least("size", F.lit(PREFIX_BYTES)), {"partial_sha256": 0}, True, False)


def with_content_hash(files: DataFrame) -> DataFrame:
    """Add ``sha256`` of the whole file, read in chunks."""
    return _hashed(files, F.col("size"), {"sha256": 1}, False, True)


def with_hashes(files: DataFrame) -> DataFrame:
    """Add ``partial_sha256`` and ``sha256``, both from one read of each file."""
    return _hashed(files, F.col("size"), {"partial_sha256": 0, "sha256": 1}, True, True)
