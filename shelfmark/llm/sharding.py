"""Sharding by proportional stratified interleaving.

Rows are put in a seeded order within their source; row ``r`` of ``n`` gets the fraction
``(2r - 1) / 2n``. Sorted by fraction, every stretch of the table holds the sources in
proportion, so equal cuts give shards that match the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.numbering import number_rows
from shelfmark.functions.skew import attach_groups
from shelfmark.llm.common import shuffled_key, source_key
from shelfmark.session import materialize


def shard_rows(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Shard and slot of each document, by row counts: at most one row apart.

    ``docs`` has doc_id, text, source. Returns doc_id, size (UTF-8 bytes of the text
    plus 1; a null text has none), text_crc32 (0 for null and empty texts), shard (0 to
    ``shards - 1``), slot (0, 1, ... in each shard, in interleaved order). Null sources are
    one source. With fewer rows than shards the last shards stay empty. Rows that
    repeat a doc_id are separate rows, put in order by their text.
    """
    rows = materialize(
        docs.select(
            "doc_id",
            source_key(F.col("source")).alias("_key"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"),
            shuffled_key(F.col("doc_id")).alias("_order"),
            F.xxhash64("text").alias("_tie"),
        ).withColumn("_row", F.monotonically_increasing_id()),
        "rows",
    )
    rank = F.col("_rank")
    totals = materialize(rows.groupBy("_key").agg(F.count("*").alias("n_files")), "source-rows")
    numbered = number_rows(rows, ["_order", "doc_id", "_tie", "_row"], group_by=["_key"], name="_rank")
    ranked = (
        attach_groups(numbered, totals, ["_key"], spread_by="_row")
        .withColumn("_fraction", (2 * rank - 1) / (2.0 * F.col("n_files")))
        .select("doc_id", "size", "text_crc32", "_fraction", "_key", "_order", "_tie", "_row")
    )
    placed = number_rows(ranked, ["_fraction", "_key", "_order", "doc_id", "_tie", "_row"], name="_place")
    total = rows.count()
    place = F.col("_place") - 1
    shard = F.floor(place * shards / F.lit(max(total, 1)))
    first = F.ceil(F.col("shard") * F.lit(total) / F.lit(shards))
    return (
        placed.withColumn("shard", shard.cast("int"))
        .withColumn("slot", (place - first).cast("long"))
        .select("doc_id", "size", "text_crc32", "shard", "slot")
    )
