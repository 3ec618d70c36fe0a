"""Exact deduplication as a stateful stream.

The stream keeps, for each content digest and byte length ever seen, a row of state
without expiry, in RocksDB on disk: the largest doc_id (stable identifier), where its
text is (file and row: content locator), and the number of rows. Hits are rows whose
digest has another row; their bytes are compared with the text at the locator.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.skew import attach_groups
from shelfmark.session import materialize, new_work_path

# All RocksDB instances of an executor, one for each state partition it holds, share a
# bounded cache and bounded write buffers; the state itself is on disk.
ROCKSDB = "spark.sql.streaming.stateStore.rocksdb"
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{ROCKSDB}.boundedMemoryUsage": "true",
    f"{ROCKSDB}.maxMemoryUsageMB": "256",
    f"{ROCKSDB}.writeBufferSizeMB": "4",
    f"{ROCKSDB}.changelogCheckpointing.enabled": "true",
    f"{ROCKSDB}.allowFAllocate": "false",  # no disk ahead of need, whatever the number of partitions
}
# Members compared with one copy of the text they should equal.
MEMBERS = 1_000


@contextmanager
def state_settings(spark: SparkSession):
    """The settings of the state store, for streams and for reading their state."""
    before = {key: spark.conf.get(key, None) for key in STATE_SETTINGS}
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _rows(df: DataFrame, digest) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        digest(text).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
        ).alias("locator"),
    )


def update_state(
    spark: SparkSession, path: str, state: str, *, files_per_batch: int = 8, digest=sha256
) -> None:
    """Take in the files below ``path`` that the state has not seen yet.

    ``state`` is a folder all executors share. It survives a lost driver: a later call
    goes on after the last batch that was committed.
    """
    path = path.rstrip("/")
    with state_settings(spark):
        stream = (
            spark.readStream.schema(spark.read.parquet(path).schema)
            .option("maxFilesPerTrigger", files_per_batch)
            .parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, it may also be a single file
        )
        seen = (
            _rows(stream, digest)
            .groupBy("digest", "n_bytes")
            .agg(F.max(F.struct("doc_id", "locator")).alias("last"), F.count("*").alias("n"))
        )
        run = (
            seen.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()


def read_state(spark: SparkSession, state: str) -> DataFrame:
    """digest, n_bytes, keep_id, keep_at (locator of the row that stays), n_files (its rows)."""
    rows = spark.read.format("statestore").load(state).select("key.*", "value.*")
    return rows.toDF("digest", "n_bytes", "last", "n_files").select(
        "digest",
        "n_bytes",
        F.col("last.doc_id").alias("keep_id"),
        F.col("last.locator").alias("keep_at"),
        "n_files",
    )


def _differing(spark: SparkSession, path: str, hits: DataFrame) -> DataFrame:
    """Rows of ``hits`` whose bytes differ from those of the row that stays, with their text.

    A text that many rows should equal is copied once for each MEMBERS of them.
    """
    texts = spark.read.parquet(path).select(
        F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
        ).alias("locator"),
        F.coalesce("text", F.lit("")).cast("binary").alias("bytes"),
    )
    copies = F.greatest(F.ceil(F.col("n_files") / MEMBERS), F.lit(1))
    found = hits.withColumn("copies", copies).join(texts, "locator")
    is_kept = F.col("locator") == F.col("keep_at")
    kept = found.filter(is_kept).select(
        F.col("digest").alias("of"),
        F.col("n_bytes").alias("of_bytes"),
        F.col("bytes").alias("kept_bytes"),
        F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"),
    )
    members = found.filter(~is_kept).withColumn("own", F.pmod(F.xxhash64("locator"), F.col("copies")))
    same = (
        (F.col("digest") == F.col("of"))
        & (F.col("n_bytes") == F.col("of_bytes"))
        & (F.col("own") == F.col("copy"))
    )
    return members.join(kept, same).filter("bytes <> kept_bytes").select(
        "digest", "n_bytes", "doc_id", "locator", "bytes"
    )


def deduplicate(
    spark: SparkSession, path: str, *, state: str | None = None, files_per_batch: int = 8, digest=sha256
) -> DataFrame:
    """What happens to each row of the documents below ``path``; the largest doc_id stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256 (what ``digest`` gives), one
    row for each input row.
    Texts are equal if all bytes are; null is the empty text. Of rows with the same text
    and doc_id, the one at the last place (file, row) stays, so that every text is kept
    exactly once. A row without doc_id only stays if no equal text has one. Other columns
    are not read. An empty table gives no rows.
    """
    state = state or new_work_path(spark, "dedup-state")
    update_state(spark, path, state, files_per_batch=files_per_batch, digest=digest)
    with state_settings(spark):
        groups = materialize(read_state(spark, state), "groups")
    rows = _rows(spark.read.parquet(path), digest)
    decided = materialize(
        attach_groups(rows, groups, ["digest", "n_bytes"], spread_by="locator"), "decided"
    )
    differing = materialize(_differing(spark, path, decided.filter("n_files > 1")), "differing")
    if not differing.isEmpty():
        decided = _apart(decided, differing)
    return decided.select(
        "doc_id",
        "keep_id",
        F.col("n_files").alias("group_size"),
        (F.col("locator") == F.col("keep_at")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def _apart(decided: DataFrame, differing: DataFrame) -> DataFrame:
    """Rows that only share a digest form groups by their bytes; the others' group shrinks."""
    own = differing.groupBy("digest", "n_bytes", "bytes").agg(
        F.max(F.struct("doc_id", "locator")).alias("last"), F.count("*").alias("own_files")
    )
    apart = differing.join(own, ["digest", "n_bytes", "bytes"]).select(
        "locator",
        F.col("last.doc_id").alias("own_id"),
        F.col("last.locator").alias("own_at"),
        "own_files",
    )
    fewer = differing.groupBy("digest", "n_bytes").agg(F.count("*").alias("gone"))
    found = decided.join(apart, "locator", "left").join(fewer, ["digest", "n_bytes"], "left")
    is_apart = F.col("own_at").isNotNull()
    rest = F.col("n_files") - F.coalesce("gone", F.lit(0))
    return found.select(
        "doc_id",
        "digest",
        "n_bytes",
        "locator",
        F.when(is_apart, F.col("own_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(is_apart, F.col("own_at")).otherwise(F.col("keep_at")).alias("keep_at"),
        F.when(is_apart, F.col("own_files")).otherwise(rest).alias("n_files"),
    )
