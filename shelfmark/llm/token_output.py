"""Token ids as ORC: integer run-length encoding, row indexes, Bloom filters on doc_id."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import arrow_rows, as_bytes
from shelfmark.llm.tokens import AT_ONCE, encoder

# doc_id and piece say where a row is; at is the number of ids before it in its piece.
SCHEMA = "doc_id long, piece int, at long, n_tokens long, ids array<int>"
OPTIONS = {
    "orc.compress": "ZSTD",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
# Bytes of text in a piece, which is one task and one file.
PIECE_BYTES = 64 << 20
# Rows that go to and come from a Python worker at once.
BATCH_ROWS = 1_000


def _row_groups(sizes: np.ndarray):
    """Stretches of rows with at most AT_ONCE bytes, or of one row."""
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > AT_ONCE:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def _encoded(tokenizer: str, end_id: int):
    def run(batches):
        encode, at = encoder(tokenizer), 0
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            sizes = np.array([len(t or b"") for t in texts], np.int64)
            for start, end in _row_groups(sizes):
                ids, counts = encode.encode(texts[start:end])
                ends = np.cumsum(counts + 1)
                whole = np.empty(len(ids) + len(counts), np.int32)
                is_end = np.zeros(len(whole), bool)
                is_end[ends - 1] = True
                whole[is_end] = end_id
                whole[~is_end] = ids
                some = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("doc_id"),
                        some.column("piece"),
                        pa.array(at + ends - counts - 1),
                        pa.array(counts + 1),
                        pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), whole),
                    ],
                    names=["doc_id", "piece", "at", "n_tokens", "ids"],
                )
                at += int(ends[-1])

    return run


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 2, order_by: Sequence[str] = ("doc_id",)
) -> None:
    """Write the ids of every whole text, with ``end_id`` after each, in ascending order of ``order_by``.

    ``docs`` has doc_id, text and the columns of ``order_by``; others are not read. Null texts
    are empty texts, so each document has at least its end id. Nulls come first; rows equal
    in ``order_by`` are in the order of the hash of their text, equal texts in any. An
    empty table makes files without rows. A piece is a range of the order, holds about
    PIECE_BYTES of text and is one file (Spark may retry a task: only committed files
    count). Rows that repeat a doc_id and text may be in several pieces.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).alias(f"_by_{i}") for i, c in enumerate(order_by)]
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PIECE_BYTES))
    order = [*[f"_by_{i}" for i in range(len(order_by))], "_tie", "_row"]
    ordered = (
        rows.withColumn("_tie", F.xxhash64("text"))
        .withColumn("_row", F.monotonically_increasing_id())  # parts even rows that are all alike
        .repartitionByRange(pieces, *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text", F.spark_partition_id().alias("piece"))
    )
    with arrow_rows(spark, BATCH_ROWS):
        encoded = ordered.mapInArrow(_encoded(tokenizer, end_id), SCHEMA)
        encoded.write.options(**OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows as written, with ``start``: ids of all documents before."""
    rows = spark.read.schema(SCHEMA).orc(path)
    sums = rows.groupBy("piece").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return rows.join(F.broadcast(offsets), "piece").select(  # one row for each piece
        "doc_id", (F.col("_offset") + F.col("at")).alias("start"), "n_tokens", "ids"
    )


def find_documents(spark: SparkSession, path: str, doc_ids: Sequence[int]) -> DataFrame:
    """doc_id, n_tokens, ids of some documents: files and stripes that cannot hold them are not read.

    Spark passes the ids to the ORC reader, which asks row indexes (least and largest id of
    a thousand rows) and Bloom filters. Ids that no row has give no row.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows.filter(F.col("doc_id").isin([int(i) for i in doc_ids])).select("doc_id", "n_tokens", "ids")


def _digests(batches):
    for batch in batches:
        ids = batch.column("ids")
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        offsets = ids.offsets.to_numpy() - ids.offsets[0].as_py()
        sums = [zlib.crc32(flat[i:j]) for i, j in zip(offsets[:-1], offsets[1:])]
        columns = [batch.column(c) for c in ("doc_id", "start", "n_tokens")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
        )


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    return tokens.mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
