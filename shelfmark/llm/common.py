"""What the operators share: tables, ids, words, prefix sums, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions.skew import attach_groups
from shelfmark.session import materialize

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_BYTES = bytes.maketrans(UPPER_ASCII.encode(), UPPER_ASCII.lower().encode())

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER_ASCII, UPPER_ASCII.lower())


def word_count(text: Column) -> Column:
    """Number of words as long; null counts as no word."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffled_key(*columns: Column) -> Column:
    """Seeded pseudo-random order that any engine can reproduce: MD5 in hex."""
    return F.md5(F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def source_key(source: Column) -> Column:
    """Sources as a key without nulls; sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a long that tells them apart, whatever they hold, and its name.

    It is the row's place in its file and the number of the file by name, so it grows in the
    order of the files and stays the same whenever they are read. Rows that are not read
    from Parquet files are written first.
    """
    place = [F.col("_metadata.file_path").alias("_of_file"), F.col("_metadata.row_index").alias("_in_file")]
    try:
        docs.select(*place)
    except AnalysisException:
        docs = materialize(docs, "keyed")
    name = "_row_key"
    while name in docs.columns:
        name += "_"
    files = docs.select(place[0]).distinct()
    files = files.select(
        F.col("_of_file").alias("_file"), F.row_number().over(Window.orderBy("_of_file")).cast("long").alias("_file_no")
    )
    rows = docs.select(F.struct(*docs.columns).alias("_all"), *place)
    both = rows.join(F.broadcast(files), F.col("_of_file") == F.col("_file"))  # one row a file, which the driver lists anyway
    key = F.shiftleft("_file_no", 40) + F.col("_in_file")
    return both.select(*[F.col(f"_all.`{c}`") for c in docs.columns], key.alias(name)), name


_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xD6E8FEB86659FD93)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MIX2
    values = (values ^ (values >> np.uint64(29))) * _MIX
    return values ^ (values >> np.uint64(32))


def chained(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of the pair (first, second), element by element."""
    return mixed(first) * _MIX + second


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Bytes hashed at once; texts are cut at white space.
STRETCH = 1 << 16
# Words of more bytes are hashed one by one.
LONG_WORD = 128
# What 8 bytes read from a place keep of a word that has 0 to 8 more.
_OWN = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class WordHashes:
    """64-bit hashes of the words of a text, all words of a stretch at once.

    A word is its length and its bytes in chunks of 8. Each chunk is joined to the hash of
    what is before it by exclusive or and goes through a bijection that mixes all bits. So
    words of one length up to 8 never share a hash; others do with the chance of random 64
    bits: two of ``n`` distinct words with about n * n / 2 ** 65 (3 % for 10 ** 9 words).
    """

    def of(self, text: bytes) -> np.ndarray:
        parts = [hash_words(data)[0] for data in stretches(text)]
        return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.uint64), *parts])


def stretches(text: bytes) -> Iterator[np.ndarray]:
    """The text in parts of STRETCH bytes or less, or of one long word, cut at white space."""
    start = 0
    while len(text) - start > STRETCH:
        data = np.frombuffer(text, np.uint8, STRETCH, start)
        spaces = np.flatnonzero(_SPACE[data])
        if len(spaces):
            yield data[: spaces[-1] + 1]
            start += int(spaces[-1]) + 1
            continue
        end = start + STRETCH  # one long word: the stretch ends where the word does
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield np.frombuffer(text, np.uint8, end - start, start)
        start = end
    if start < len(text):
        yield np.frombuffer(text, np.uint8, len(text) - start, start)


def chunks_of(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as integers; zeros follow the end."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def own_bytes(chunks: np.ndarray, left: np.ndarray) -> np.ndarray:
    """What of each chunk belongs to a word that has ``left`` more bytes."""
    return chunks & _OWN[np.minimum(left, 8)]


def hash_words(
    data: np.ndarray, splits: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, where they start, how long they are, and the chunks of the data.

    ``splits`` marks places within words where another word begins.
    """
    n = len(data)
    word = ~_SPACE[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    if splits is not None:
        begins |= splits
        ends[:-1] |= splits[1:]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    chunks = chunks_of(data)
    first = own_bytes(chunks[starts], lengths)
    out = mixed(mixed(lengths.astype(np.uint64) * _MIX) ^ first)
    those = np.flatnonzero((lengths > 8) & (lengths <= LONG_WORD))
    done = 8
    while len(those):
        out[those] = mixed(out[those] ^ own_bytes(chunks[starts[those] + done], lengths[those] - done))
        done += 8
        those = those[lengths[those] > done]
    for i in np.flatnonzero(lengths > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + lengths[i]].tobytes())
    return out, starts, lengths, chunks


def shingle_set(text: bytes | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    A-Z are lower-cased. A text of fewer words is one shingle, without words none.
    """
    codes = hashes.of(text.translate(LOWER_BYTES)) if text else ()
    if not len(codes):
        return np.empty(0, np.uint64)
    size = min(size, len(codes))
    n = len(codes) - size + 1
    out = codes[:n] + np.uint64(size)
    for i in range(1, size):
        out = (out ^ (out >> np.uint64(31))) * _MIX + codes[i : n + i]
    out = mixed(out)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


# Bytes that go to or come from a Python worker at once, one row more or less. Both sides keep
# what their largest batch took: the worker while it lives, the JVM outside its heap.
BATCH_BYTES = 2 << 20


@contextmanager
def _arrow(spark: SparkSession, limit: str, value: int):
    key = f"spark.sql.execution.arrow.{limit}"
    before = spark.conf.get(key)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def arrow_rows(spark: SparkSession, rows: int):
    """While it holds, so many rows at most go to a Python worker at once; for rows of many bytes."""
    return _arrow(spark, "maxRecordsPerBatch", rows)


def arrow_bytes(spark: SparkSession, size: int = BATCH_BYTES):
    """While it holds, a batch for a Python worker ends with the row that reaches so many bytes.

    For texts of any length. It counts when a query runs, not when it is built.
    """
    return _arrow(spark, "maxBytesPerBatch", size)


def in_batches(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about BATCH_BYTES."""
    step = max(1, rows.num_rows * BATCH_BYTES // max(rows.nbytes, 1))
    for start in range(0, rows.num_rows, step):
        yield rows.slice(start, step)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def _hung(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (u, w) with ``m``, the least of u and all its neighbours by ``edges`` (u, v).

    A node may have most of the edges: its rows are spread (``skew.attach_groups``).
    """
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n_files"))
    return attach_groups(rows, materialize(least, "least"), ["u"], spread_by="w")


def components(edges: DataFrame) -> DataFrame:
    """Label every node of the edges ``a``, ``b`` (long) by the smallest node it reaches.

    Alternating stars: each node hangs its larger neighbours, then its smaller
    ones, on the smallest; a logarithmic number of rounds in practice. A round is
    aggregations with map-side combine and joins that spread hot nodes; its result is
    written to the shared folder.
    """
    current = materialize(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    print_before = None
    while True:
        print_now = current.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if print_now == print_before or not print_now[0]:
            break
        print_before = print_now
        both = current.union(current.select("v", "u"))
        turned = current.select(F.col("v").alias("u"), F.col("u").alias("w"))
        large = _hung(turned, both).select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "edges")
        small = _hung(large.select("u", F.col("v").alias("w")), large)
        small = small.filter("w <> m").select(F.col("w").alias("u"), F.col("m").alias("v"))
        small = small.union(large.groupBy("u").agg(F.min("v").alias("v")))
        current = materialize(
            small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
            "edges",
        )
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
