"""Token counts: exact histogram of encoded lengths, and what its suffix sums answer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import as_bytes
from shelfmark.llm.tokens import encoder
from shelfmark.session import materialize

# Lengths that share a block; suffix sums run over blocks, then within them.
BLOCK = 256


def encoded_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and n_tokens of every whole text; null and empty texts have 0.

    ``tokenizer`` is the path of a file of the tokenizers library on every machine.
    """

    def run(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            counts = encode.count(as_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts.astype(np.int64))], names=["doc_id", "n_tokens"]
            )

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row for each length that occurs: what a context limit of that length means.

    n_tokens, docs (of this length), docs_longer, docs_up_to, tokens_up_to (of documents
    of at most this length), tokens_truncated (of all documents, each cut to this
    length). An empty table gives no rows. Every document counts, those of length 0 too.
    """
    counts = materialize(
        lengths.groupBy("n_tokens")
        .agg(F.count("*").alias("docs"))
        .withColumn("_tokens", F.col("docs") * F.col("n_tokens"))
        .withColumn("_block", F.floor(F.col("n_tokens") / BLOCK)),
        "histogram",
    )
    later = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("_block").agg(F.sum("docs").alias("d"), F.sum("_tokens").alias("t"))
    whole = Window.partitionBy()
    blocks = blocks.select(
        "_block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("_later_docs"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("_later_tokens"),
        F.sum("d").over(whole).alias("_all_docs"),
        F.sum("t").over(whole).alias("_all_tokens"),
    )
    within = Window.partitionBy("_block").orderBy(F.desc("n_tokens"))
    within = within.rowsBetween(Window.unboundedPreceding, -1)
    longer = F.col("_later_docs") + F.coalesce(F.sum("docs").over(within), F.lit(0))
    longer_tokens = F.col("_later_tokens") + F.coalesce(F.sum("_tokens").over(within), F.lit(0))
    up_to = F.col("_all_tokens") - longer_tokens
    return counts.join(blocks, "_block").select(
        "n_tokens",
        "docs",
        longer.alias("docs_longer"),
        (F.col("_all_docs") - longer).alias("docs_up_to"),
        up_to.alias("tokens_up_to"),
        (up_to + longer * F.col("n_tokens")).alias("tokens_truncated"),
    )


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For any context limits: limit, docs_longer, tokens_truncated, from the histogram alone.

    One aggregation over the histogram for all limits; an empty histogram gives no rows.
    """
    least = F.min(F.struct("n_tokens", (F.col("docs") + F.col("docs_longer")).alias("docs")))
    last = F.struct("n_tokens", "docs_longer", "tokens_up_to")
    asked = [
        F.struct(F.lit(int(x)).cast("long").alias("limit"), F.max(F.when(F.col("n_tokens") <= int(x), last)).alias("at"))
        for x in limits
    ]
    found = histogram.agg(least.alias("_least"), F.array(*asked).alias("_asked")).filter("_least is not null")
    found = found.select("_least", F.explode("_asked").alias("_a"))
    longer = F.coalesce("_a.at.docs_longer", "_least.docs")
    return found.select(
        F.col("_a.limit").alias("limit"),
        longer.alias("docs_longer"),
        (F.coalesce("_a.at.tokens_up_to", F.lit(0)) + longer * F.col("_a.limit")).alias("tokens_truncated"),
    )


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """Smallest length that at least the share ``q`` of documents does not exceed, as one row n_tokens."""
    share = F.col("docs_up_to") >= q * (F.col("docs_up_to") + F.col("docs_longer"))
    return histogram.filter(share).agg(F.min("n_tokens").alias("n_tokens"))
