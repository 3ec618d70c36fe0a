"""Line deduplication by winnowing over line hashes.

Passages are runs of whole lines. A line weighs as many as it has words, but LEAST at
least, and 1 without words. A gram is the shortest run of lines from a line on that weighs
GRAM. The grams that start at the lines of a gram are its window, and the one with the
least hash is a fingerprint. Any run that weighs 2 * GRAM holds the whole window of its
first line, whatever stands around it, so wherever it stands the same fingerprint of it is
chosen: all repeated runs of that weight, and so all of 50 words, share one.

Fingerprints are joined by hash. From each that also stands elsewhere the match is extended
line by line both ways, against every other place: each longer run that starts, or ends,
with the fingerprint is looked up by its own hash, and counts if it has an earlier place.
Two fingerprints of a run are at most GRAM apart, and lie at most GRAM from its beginning
and twice that from its end. So no run has to be extended further than that, and all lines
of a repeated run are reached from one of its fingerprints. Later places are deleted.
Everything is a DataFrame expression or join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.skew import attach_groups
from shelfmark.llm.common import word_count
from shelfmark.session import materialize

# Weight of a gram, and the least of a line with words.
GRAM, LEAST = 25, 4
NO_ID = -(1 << 63)

KEY = ["_id", "_tie"]


def _key(docs: DataFrame) -> list[Column]:
    return [
        F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64(docs["text"]).alias("_tie"),
    ]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_weight(line: Column) -> Column:
    words = word_count(line)
    return F.when(words == 0, 1).otherwise(F.greatest(words, F.lit(LEAST))).cast("int")


def _reach(weights: Column, at: Column, weight: int, step: int, most: int) -> Column:
    """How many lines from ``at`` on (or back) weigh less than ``weight`` together."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(most - 1)),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum")),
        lambda so_far, k: F.struct(
            F.when(
                (so_far["n"] == k) & (so_far["sum"] + F.coalesce(F.get(weights, at + step * k), F.lit(weight)) < weight),
                k + 1,
            )
            .otherwise(so_far["n"])
            .alias("n"),
            (so_far["sum"] + F.coalesce(F.get(weights, at + step * k), F.lit(weight))).alias("sum"),
        ),
        lambda end: end["n"],
    )


def grams(hashes: Column, weights: Column) -> Column:
    """For each line the gram that starts there as a struct (hash, start, n), null if the text ends before."""

    def length(i: Column) -> Column:
        total = F.get(weights, i)
        found = F.when(total >= GRAM, 1)
        for k in range(1, GRAM):  # a line weighs 1 at least
            total = total + F.get(weights, i + k)  # null beyond the lines
            found = found.when(total >= GRAM, k + 1)
        return found

    lengths = F.transform(weights, lambda _, i: length(i))
    return F.transform(
        lengths,
        lambda n, i: F.when(
            n.isNotNull(),
            F.struct(F.xxhash64(F.slice(hashes, i + 1, n)).alias("hash"), i.alias("start"), n.alias("n")),
        ),
    )


def fingerprints(all_grams: Column) -> Column:
    """The least gram of each window, once each."""
    window = lambda g: F.filter(F.slice(all_grams, g["start"] + 1, g["n"]), lambda x: x.isNotNull())
    chosen = F.transform(F.filter(all_grams, lambda g: g.isNotNull()), lambda g: F.array_min(window(g)))
    return F.array_distinct(chosen)


def _occurrences(docs: DataFrame) -> DataFrame:
    """Fingerprints that stand in several places: KEY, start, n, low, around.

    ``around`` are the hashes of the lines from ``low`` on: those that a match of the
    fingerprint may extend over.
    """
    lines = docs.select(*_key(docs), _lines(docs["text"]).alias("lines")).select(
        *KEY,
        F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"),
        F.transform("lines", line_weight).alias("weights"),
    )
    chosen = lines.withColumn("grams", grams(F.col("hashes"), F.col("weights")))
    chosen = chosen.select(*KEY, "hashes", "weights", F.explode(fingerprints(F.col("grams"))).alias("g"))
    before = _reach(F.col("weights"), F.col("g.start") - 1, GRAM, -1, GRAM)
    behind = _reach(F.col("weights"), F.col("g.start") + 1, 2 * GRAM, 1, 2 * GRAM)
    low = F.col("g.start") - before
    high = F.greatest(F.col("g.start") + behind, F.col("g.start") + F.col("g.n") - 1)
    places = materialize(
        chosen.select(
            *KEY, "g.hash", "g.start", "g.n", low.alias("low"), F.slice("hashes", low + 1, high - low + 1).alias("around")
        ),
        "places",
    )
    # Rows that repeat a document have the same places, of which none comes after the other.
    shared = materialize(places.groupBy("hash").agg(F.count("*").alias("n_files")).filter("n_files > 1"), "shared")
    found = attach_groups(places, shared, ["hash"], spread_by=F.struct(*KEY, "start"), how="inner")
    return found.select(*KEY, "start", "n", "low", "around")


def _runs(found: DataFrame) -> DataFrame:
    """Runs that start or end with a fingerprint: KEY, start (of the fingerprint), hash, first, last (lines)."""
    start, low, around = F.col("start"), F.col("low"), F.col("around")
    end = start + F.col("n") - 1
    high = low + F.size(around) - 1

    def run(first: Column, last: Column) -> Column:
        hash_ = F.xxhash64(F.slice(around, first - low + 1, last - first + 1))
        return F.struct(hash_.alias("hash"), first.alias("first"), last.alias("last"))

    ahead = F.transform(F.sequence(end, high), lambda k: run(start, k))
    back = F.when(low < start, F.transform(F.sequence(low, start - 1), lambda k: run(k, end)))
    runs = F.concat(ahead, F.coalesce(back, F.array().cast("array<struct<hash:bigint,first:int,last:int>>")))
    return found.select(*KEY, "start", F.explode(runs).alias("run")).select(*KEY, "start", "run.*")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Lines in runs that also stand at an earlier place: KEY, gone (counted from 0)."""
    runs = materialize(_runs(_occurrences(docs)), "runs")
    firsts = runs.groupBy("hash").agg(F.min(F.struct(*KEY, "first")).alias("earliest"), F.count("*").alias("n_files"))
    firsts = materialize(firsts.filter("n_files > 1"), "firsts")
    later = attach_groups(runs, firsts, ["hash"], spread_by=F.struct(*KEY, "start", "last"), how="inner")
    later = later.filter(F.struct(*KEY, "first") > F.col("earliest"))
    # The longest match of each fingerprint ahead and back; shorter ones are within.
    longest = later.groupBy(*KEY, "start").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return longest.groupBy(*KEY).agg(
        F.array_distinct(F.flatten(F.collect_list(F.sequence("first", "last")))).alias("gone")  # lines of one document
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents without repeated passages of whole lines; ``n_lines`` and ``n_removed`` added.

    ``docs`` has doc_id and text; all columns stay (n_lines and n_removed are replaced).
    Every line goes that is in a run of lines weighing 2 * GRAM (so of 50 words or more) that
    also stands at an earlier place; no line goes that is not in such a run weighing GRAM. In
    between it depends on the fingerprints. The order of documents is that of doc_id, null
    first, so the smallest id keeps a run; within a document the first place does. Lines are
    equal if their 64-bit hashes are. Null texts stay null; empty lines are lines. A text
    may become empty. Rows that repeat both doc_id and text count as one document and get
    the same result; rows with one doc_id and other texts are told apart by the hash of the
    text. An empty table gives no rows.
    """
    gone = materialize(repeated_lines(docs), "gone")
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), *_key(docs))
    # The same join at every size: what is found grows with the documents.
    both = keyed.join(gone.hint("merge"), KEY, "left")
    some = F.col("gone").isNotNull()
    all_lines = _lines(F.col("_row.text"))
    left = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("gone"))
    kept = F.transform(left, lambda i: F.get(all_lines, i))
    text = F.when(~some, F.col("_row.text")).otherwise(F.array_join(F.col("_kept"), "\n"))
    n_lines = F.when(F.col("_row.text").isNull(), 0).otherwise(F.size(all_lines))
    n_kept = F.when(~some, n_lines).otherwise(F.size("_kept"))
    added = ("n_lines", "n_removed")
    return both.withColumn("_kept", F.when(some, kept)).select(
        *[text.alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns if c not in added],
        n_lines.alias("n_lines"),
        (n_lines - n_kept).alias("n_removed"),
    )
