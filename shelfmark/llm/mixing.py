"""Mixing sources to target weights along a time-varying curriculum.

Each source has a piecewise linear weight schedule over training time 0 to 1. Its
integral is the source's weight: all words are shared by weight, a source gives at
most ``repeats`` times its words, and what it cannot give is shared among the rest.
The integral up to ``t``, scaled to the target, is the words demanded by then; a copy
of a document sits where the demand reaches its words, in the source's seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.numbering import number_rows, running_sum
from shelfmark.functions.skew import attach_groups
from shelfmark.llm.common import shuffled_key, source_key, word_count
from shelfmark.session import materialize

# Weights in turn, and first and last weight relative to the mean.
WEIGHTS = (5.0, 2.0, 1.0)
SLOPES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def cyclic_schedules(sources: DataFrame) -> DataFrame:
    """Schedules for sources in code point order: weights 5, 2, 1 in turn; falling, flat, rising."""
    turn = (F.row_number().over(Window.orderBy("_key")) - 1) % len(WEIGHTS)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_turn") + 1)
    weight = pick(WEIGHTS)
    ends = [(0.0, pick([a for a, _ in SLOPES])), (1.0, pick([b for _, b in SLOPES]))]
    points = F.array(*[F.struct(F.lit(t).alias("t"), (weight * w).alias("w")) for t, w in ends])
    return sources.select("_key", turn.cast("int").alias("_turn")).select("_key", points.alias("points"))


def segments(points: Column) -> Column:
    """Pieces of a schedule: start, length, first and last weight, integral before."""
    pieces = F.transform(
        F.sequence(F.lit(1), F.size(points) - 1),
        lambda i: F.struct(
            F.element_at(points, i).t.alias("t"),
            (F.element_at(points, i + 1).t - F.element_at(points, i).t).alias("h"),
            F.element_at(points, i).w.alias("a"),
            F.element_at(points, i + 1).w.alias("b"),
        ),
    )
    area = lambda s: (s.a + s.b) / 2.0 * s.h
    before = lambda i: F.aggregate(F.slice(pieces, 1, i), F.lit(0.0), lambda x, s: x + area(s))
    return F.transform(
        pieces,
        lambda s, i: F.struct(
            s.t.alias("t"), s.h.alias("h"), s.a.alias("a"), s.b.alias("b"), before(i).alias("before")
        ),
    )


def integral(points: Column) -> Column:
    last = F.element_at(segments(points), -1)
    return last.before + (last.a + last.b) / 2.0 * last.h


def time_of(area: Column, pieces: Column) -> Column:
    """Time at which the integral of the schedule reaches ``area``."""
    piece = F.element_at(F.filter(pieces, lambda s: s.before <= area), -1)
    rest = area - piece.before
    slope = (piece.b - piece.a) / piece.h
    root = F.sqrt(F.greatest(piece.a * piece.a + 2.0 * slope * rest, F.lit(0.0)))
    step = F.when(rest > 0, 2.0 * rest / (piece.a + root)).otherwise(F.lit(0.0))
    return piece.t + F.least(step, piece.h)


def targets(sources: DataFrame, repeats: int) -> DataFrame:
    """Words to take from each source: ``_key``, ``_total``, ``weight`` in, ``target`` added.

    By most words per weight, sources fill up first; the first that does not sets the
    share per weight of all that follow. The table has one row for each source.
    """
    most = (F.col("_total") * repeats).cast("double")
    order = Window.orderBy(F.col("_most") / F.col("weight"), "_key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sources.withColumn("_all", F.sum("_total").over(Window.partitionBy()))
        .withColumn("_most", most)
        .withColumn("_given", F.coalesce(F.sum("_most").over(before), F.lit(0.0)))
        .withColumn("_weights", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_share", (F.col("_all") - F.col("_given")) / F.col("_weights"))
    )
    full = F.col("_most") <= F.col("_share") * F.col("weight")
    share = F.max(F.when(~full, F.col("_share"))).over(Window.partitionBy())
    return (
        ranked.withColumn("_final", share)
        .withColumn("target", F.when(full, F.col("_most")).otherwise(F.col("_final") * F.col("weight")))
        .select(*sources.columns, "target")
    )


def mix(docs: DataFrame, schedules=cyclic_schedules, *, repeats: int = 3, key: str | None = None) -> DataFrame:
    """Training positions of the documents: doc_id, size, source_size, target, positions, ``_tie``, ``_key``.

    ``docs`` has doc_id, text, source; ``schedules`` maps a table of source keys
    (``_key``, see common.source_key) to ``_key``, ``points`` (array of t, w). One row
    for each input row; ``key`` names a column that tells rows apart and is returned too.
    size is the number of words, 0 for null. A document has one position in 0 to 1 for each
    time it is taken, so ``positions`` may be empty. A copy is taken if its middle word is
    within the target: a source's words differ from its target by less than half a document.
    Documents without words are taken once at most. Null sources are one source, the last.
    Rows that repeat a doc_id are separate documents, put in order by the hash of their text
    (``_tie``), equal ones in any order. The table may be empty.
    """
    sizes = docs.select(
        "doc_id",
        source_key(F.col("source")).alias("_key"),
        word_count(F.col("text")).alias("size"),
        shuffled_key(F.col("doc_id")).alias("_order"),
        F.xxhash64("text").alias("_tie"),
        (F.monotonically_increasing_id() if key is None else F.col(key)).alias("_row"),
    )
    sizes = materialize(sizes, "sizes")
    totals = sizes.groupBy("_key").agg(F.sum("size").alias("_total"), F.count("*").alias("n_files"))
    weighed = schedules(totals.select("_key")).join(totals, "_key").select(
        "_key", "_total", "n_files", integral(F.col("points")).alias("weight"), segments(F.col("points")).alias("_pieces")
    )
    plan = materialize(targets(weighed, repeats), "targets")
    order = ["_order", "doc_id", "_tie", "_row"]
    placed = running_sum(sizes, order, "size", group_by=["_key"], name="_up_to")
    placed = attach_groups(placed, plan, ["_key"], spread_by="_row", how="inner")
    placed = placed.withColumn("_middle", F.col("_up_to") - F.col("size") + F.col("size") / 2.0)
    middles = F.transform(
        F.sequence(F.lit(0), F.when(F.col("size") > 0, F.lit(repeats - 1)).otherwise(F.lit(0))),
        lambda e: F.col("_middle") + e * F.col("_total"),
    )
    taken = F.filter(middles, lambda m: m < F.col("target"))
    positions = F.transform(
        taken, lambda m: time_of(m / F.col("target") * F.col("weight"), F.col("_pieces"))
    )
    return placed.select(
        "doc_id",
        "size",
        F.col("_total").alias("source_size"),
        "target",
        positions.alias("positions"),
        "_tie",
        "_key",
        *([] if key is None else [F.col("_row").alias(key)]),
    )


def training_places(plan: DataFrame, key: str) -> DataFrame:
    """``plan`` (of ``mix`` with ``key``) with first_place and last_place in training order.

    All copies of all documents are range-sorted by position, then doc_id, and numbered
    from 1. Documents that are not taken have no place (null).
    """
    copies = plan.select(key, "doc_id", "_tie", F.explode("positions").alias("_position"))
    numbered = number_rows(copies, ["_position", "doc_id", "_tie", key], name="_place")
    places = numbered.groupBy(F.col(key).alias("_of")).agg(F.min("_place").alias("first_place"), F.max("_place").alias("last_place"))
    return plan.join(places, F.col(key) == F.col("_of"), "left").drop("_of")


def training_order(docs: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """The documents in training order, each as often as it is taken.

    ``plan`` is the result of ``mix`` for ``docs`` with ``key``, which is left out of the
    result. All other columns of ``docs`` stay; ``training_position`` is added (or replaced).
    A range sort by position, then doc_id.
    """
    columns = [c for c in docs.columns if c not in ("training_position", key)]
    left = docs.select(F.col(key).alias("_of"), F.struct(*columns).alias("_row"))
    right = plan.select(F.col(key).alias("_plan_of"), "positions").filter(F.size("positions") > 0)
    return (
        left.join(right, F.col("_of") == F.col("_plan_of"))
        .select("_of", "_row", F.explode("positions").alias("_position"))
        .orderBy("_position", "_row.doc_id", "_of")
        .select("_row.*", F.col("_position").alias("training_position"))
    )
