"""Benchmark decontamination with SimHash over item-sized windows.

1. Word shingles of the items fill a filter of fixed size. A document's shingles that
   pass it mark places that may match; a window without any shared shingle cannot
   reach the threshold, so nothing is lost.
2. A shingle that an item really has fixes where a window as long as that item begins.
3. A window's fingerprint is the SimHash of its weighted shingles. Fingerprints of equal
   window length meet on at least one of RADIUS + 1 blocks if they differ in at most
   RADIUS bits: joining on blocks finds them all.
4. Candidates within the radius are compared exactly: weighted Jaccard similarity of the
   shingles themselves, a shingle weighing as many letters and digits as it has.

Everything is a DataFrame expression or join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
# Windows of similarity 0.8 are 10 to 11 bits off, with a deviation of 3: one in a million is
# further off than this. Other texts are 32 bits off, with a deviation of 4.
RADIUS = 26
BLOCKS = RADIUS + 1
# Where the blocks begin: of 64 bits each has two or three.
STARTS = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
# Bits of the filter: 128 KB, or up to 4 MB for large benchmarks.
FILTER_BITS = (20, 25)


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _starts(words: Column, size: int) -> Column:
    """1-based starts of the shingles of a size."""
    last = F.size(words) - size + 1
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def shingles_of(words: Column) -> Column:
    """Distinct shingles as strings; fewer words than SHINGLE are one shingle, none have none."""
    some = F.transform(_starts(words, SHINGLE), lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))
    whole = F.when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.when(F.size(words) >= SHINGLE, some).otherwise(whole))


def _hashes(words: Column, size: int) -> Column:
    return F.transform(_starts(words, size), lambda i: F.xxhash64(F.slice(words, i, size)))


def weight_of(shingles: Column) -> Column:
    """Letters and digits of all shingles together."""
    letters = lambda s: F.length(F.translate(s, " ", "")).cast("long")
    return F.aggregate(shingles, F.lit(0).cast("long"), lambda n, s: n + letters(s))


def simhash(shingles: Column) -> Column:
    """64 weighted majority bits of the hashes of the shingles."""
    hashed = F.transform(
        shingles,
        lambda s: F.struct(F.xxhash64(s).alias("h"), F.length(F.translate(s, " ", "")).alias("w")),
    )
    return F.aggregate(
        F.transform(
            F.sequence(F.lit(63), F.lit(0)),
            lambda b: F.aggregate(
                hashed, F.lit(0), lambda n, x: n + F.when(F.getbit(x.h, b) == 1, x.w).otherwise(-x.w)
            ),
        ),
        F.lit(0).cast("long"),
        lambda bits, n: F.shiftleft(bits, 1).bitwiseOR(F.when(n > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")),
    )


def _block(fingerprint: Column, i: int) -> Column:
    mask = (1 << (STARTS[i + 1] - STARTS[i])) - 1
    return F.shiftrightunsigned(fingerprint, STARTS[i]).bitwiseAND(F.lit(mask))


def _blocks(fingerprint: Column) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("i"), _block(fingerprint, i).alias("bits")) for i in range(BLOCKS)])


def _first_common_block(apart: Column) -> Column:
    """The first block without a differing bit; a pair that meets on several counts there."""
    return F.coalesce(*[F.when(_block(apart, i) == 0, F.lit(i)) for i in range(BLOCKS)])


def item_table(benchmark: DataFrame) -> DataFrame:
    """Items with words: item_id, words, n_words, shingles, weight, fingerprint."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("words"))
    return (
        words.filter(F.size("words") > 0)
        .select("item_id", "words", F.size("words").alias("n_words"), shingles_of(F.col("words")).alias("shingles"))
        .withColumns({"weight": weight_of(F.col("shingles")), "fingerprint": simhash(F.col("shingles"))})
    )


def _anchors(items: DataFrame) -> DataFrame:
    """Hash of each shingle of the items, with its length, the item's length and its place in it."""
    size = F.least("n_words", F.lit(SHINGLE))
    starts = F.sequence(F.lit(1), F.col("n_words") - size + 1)
    return items.select("words", "n_words", size.alias("size"), F.explode(starts).alias("place")).select(
        F.xxhash64(F.slice("words", F.col("place"), F.col("size"))).alias("hash"), "size", "n_words", "place"
    ).distinct()


def _filter(anchors: DataFrame, bits: int) -> Column:
    """The anchors' hashes as an array of 64-bit words, two bits for each hash."""
    mask = F.lit((1 << bits) - 1).cast("long")
    places = F.explode(
        F.array(F.col("hash").bitwiseAND(mask), F.shiftrightunsigned("hash", 64 - bits).bitwiseAND(mask))
    )
    words = (
        anchors.select(places.alias("p"))
        .groupBy(F.shiftright("p", 6).cast("int").alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("word"))
        .collect()  # at most 2 ** (bits - 6) rows
    )
    full = ["0"] * (1 << (bits - 6))
    for row in words:
        full[row["at"]] = str(row["word"])
    return F.split(F.lit(",".join(full)), ",").cast("array<bigint>")


def _passes(hash_: Column, table: Column, bits: int) -> Column:
    mask = F.lit((1 << bits) - 1).cast("long")

    def is_set(place: Column) -> Column:
        word = F.get(table, F.shiftright(place, 6).cast("int"))
        return F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1

    return is_set(hash_.bitwiseAND(mask)) & is_set(F.shiftrightunsigned(hash_, 64 - bits).bitwiseAND(mask))


def _windows(docs: DataFrame, anchors: DataFrame, sizes: list[int], longest: int, bits: int) -> DataFrame:
    """Windows as long as an item, where a shared shingle places them: doc_id, n_words, start, words."""
    table = _filter(anchors, bits)
    words = docs.select(F.col("doc_id"), words_of(F.col("text")).alias("words"))
    found = None
    for size in sizes:
        hashes = _hashes(F.col("words"), size)
        marked = F.transform(
            hashes, lambda h, i: F.when(_passes(h, table, bits), F.struct((i + 1).alias("at"), h.alias("hash")))
        )
        marked = F.filter(marked, lambda x: x.isNotNull())
        # The words around a marked place go along, so no text is read or shuffled again.
        first = F.greatest(F.col("mark.at") - longest, F.lit(1))
        part = (
            words.withColumn("marked", marked)
            .select("doc_id", "words", F.explode_outer("marked").alias("mark"))
            .filter(F.col("mark").isNotNull())
            .select(
                "doc_id",
                F.col("mark.at").alias("at"),
                F.col("mark.hash").alias("hash"),
                F.lit(size).alias("size"),
                F.size("words").alias("n_doc"),
                first.alias("first"),
                F.slice("words", first, F.col("mark.at") - first + longest + size).alias("around"),
            )
        )
        found = part if found is None else found.unionByName(part)
    latest = F.col("n_doc") - F.col("n_words") + 1
    start = F.greatest(F.least(F.col("at") - F.col("place") + 1, latest), F.lit(1))
    return (
        found.join(anchors, ["hash", "size"])
        .withColumn("start", start)
        .select(
            "doc_id",
            "n_words",
            "start",
            F.slice("around", F.col("start") - F.col("first") + 1, F.col("n_words")).alias("words"),
        )
        .distinct()
    )


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """Documents that hold a benchmark item: doc_id, item_id, similarity, first_word.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are not
    read. One row for each pair with a window whose weighted Jaccard similarity to the
    item reaches ``similarity``: the best window, the first if equal (first_word counts
    from 1). Case and all but letters and digits do not matter. Items without words, and
    null or empty texts, match nothing; items of under five words match as a whole.
    Rows that repeat a doc_id or item_id add up. Either table may be empty.
    """
    items = materialize(item_table(benchmark), "items")
    facts = items.agg(
        F.max("n_words").alias("longest"),
        F.sum("n_words").alias("total"),
        F.collect_set(F.least("n_words", F.lit(SHINGLE))).alias("sizes"),  # at most SHINGLE values
    ).first()
    if facts.longest is None:
        return docs.select("doc_id").join(benchmark.select("item_id"), F.lit(False)).select(
            "doc_id", "item_id", F.lit(0.0).alias("similarity"), F.lit(0).alias("first_word")
        )
    bits = min(max(FILTER_BITS[0], (facts.total * 64).bit_length()), FILTER_BITS[1])
    anchors = materialize(_anchors(items), "anchors")
    windows = _windows(docs, anchors, sorted(facts.sizes), facts.longest, bits)
    windows = windows.withColumn("shingles", shingles_of(F.col("words")))
    windows = materialize(windows.withColumn("fingerprint", simhash(F.col("shingles"))), "windows")
    keyed = windows.select(
        "doc_id", "n_words", "start", "shingles", "fingerprint", F.explode(_blocks(F.col("fingerprint"))).alias("block")
    )
    items = items.select(
        "item_id",
        F.col("n_words").alias("item_words"),
        F.col("shingles").alias("item_shingles"),
        F.col("weight").alias("item_weight"),
        F.col("fingerprint").alias("item_fingerprint"),
        F.explode(_blocks(F.col("fingerprint"))).alias("item_block"),
    )
    apart = F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))
    candidates = keyed.join(
        items, (F.col("n_words") == F.col("item_words")) & (F.col("block") == F.col("item_block"))
    ).filter((F.bit_count(apart) <= RADIUS) & (_first_common_block(apart) == F.col("block.i")))
    shared = weight_of(F.array_intersect("shingles", "item_shingles"))
    verified = (
        candidates.withColumn("_shared", shared)
        .withColumn(
            "similarity",
            F.col("_shared") / (weight_of(F.col("shingles")) + F.col("item_weight") - F.col("_shared")),
        )
        .filter(F.col("similarity") >= similarity)
    )
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start")))
    return verified.groupBy("doc_id", "item_id").agg(best.alias("_best")).select(
        "doc_id", "item_id", F.col("_best.similarity").alias("similarity"), (-F.col("_best.start")).alias("first_word")
    )


def without_leaks(docs: DataFrame, leaks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents no leak names, all their columns kept.

    ``leaks`` names them by doc_id, which is ``key`` in ``docs``; null ids are compared as
    equal, so rows that share a key share a fate. A key that tells rows apart is
    ``common.with_row_key``.
    """
    named = leaks.select(F.col("doc_id").alias("_leaking")).distinct()
    return docs.join(named, docs[key].eqNullSafe(F.col("_leaking")), "left_anti")
