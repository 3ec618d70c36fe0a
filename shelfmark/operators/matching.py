"""Texts against a table of patterns, by equality on fragments.

A pattern's fragment (see ``functions.fragments``) is looked up by one gram of its literals, of
up to eight characters: the one that the fewest texts hold. Grams that long keep the pairs
near the number of matches also for names that count up, where every gram of three is in a
share of all names. A fragment with a gram that no text holds matches nothing and is dropped.
Texts yield their grams, join the chosen ones, and the pairs are verified: first by the
fragment, then by the pattern itself, as a column. Whole texts and beginnings are joined as
they are. Patterns stay rows: none passes the driver, and none becomes part of the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.fragments import BETWEEN
from shelfmark.functions.numbering import number_rows
from shelfmark.session import materialize

GRAM = 8
# Literals shorter than this are looked up only if the fragment has no longer one.
SHORT = 3
# Parts that the texts of a gram are spread over: a gram may be in all of them.
PARTS = 16
# Patterns without fragment that all texts are tried against at once.
SLICE = 256

EQUALS, CONTAINS, PREFIX, REGEX = "equals", "contains", "prefix", "regex"


def _grams(text: Column, size: int) -> Column:
    last = F.char_length(text) - (size - 1)
    some = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(last >= 1, some).otherwise(F.array().cast("array<string>"))


def _literals(fragment: str) -> Column:
    return F.split(fragment, BETWEEN)


def _held(fragment: str) -> Column:
    """The literals a fragment may be looked up by."""
    literals = _literals(fragment)
    longest = F.array_max(F.transform(literals, F.char_length))
    return F.filter(literals, lambda x: F.char_length(x) >= F.least(longest, F.lit(SHORT)))


def _size(literal: Column) -> Column:
    """Length of the grams a literal is looked up by."""
    return F.least(F.char_length(literal), F.lit(GRAM))


def _own_grams(literal: Column) -> Column:
    starts = F.sequence(F.lit(1), F.char_length(literal) - _size(literal) + 1)
    return F.transform(starts, lambda i: F.substring(literal, i, _size(literal)))


def matches(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Pairs of texts and patterns that match; a pair may be there several times.

    ``texts`` has ``text``, each once. ``patterns`` has ``test`` and ``fragment``, and
    ``regex`` for tests that are regular expressions (of Java); ``fragment`` is null if there
    is none. One row for each fragment of a pattern. Texts match if they are the fragment (``equals``),
    hold its literals (``contains``), begin with it (``prefix``), or hold it and match (``regex``). The result
    has ``text`` and all other columns of ``patterns``. Both tables are read several times.
    """
    values = [c for c in patterns.columns if c not in ("test", "fragment", "regex")]
    is_known = F.coalesce(F.col("fragment") != "", F.lit(False))
    by_gram = is_known & F.col("test").isin(CONTAINS, REGEX)
    known = patterns.filter(by_gram)
    facts = patterns.agg(
        F.array_distinct(F.flatten(F.collect_set(F.when(by_gram, F.transform(_held("fragment"), _size))))).alias("sizes"),
        F.count_if(~is_known).alias("loose"),
        F.count_if(is_known & (F.col("test") == EQUALS)).alias("equal"),
        F.count_if(is_known & (F.col("test") == PREFIX)).alias("begin"),
    ).first()
    sizes = sorted(facts.sizes)  # at most GRAM
    found = [_tried(texts, patterns.filter(~is_known), facts.loose, values)]
    if facts.equal:
        whole = patterns.filter(is_known & (F.col("test") == EQUALS)).select(F.col("fragment").alias("text"), *values)
        found.append(texts.join(whole, "text").select("text", *values))
    if facts.begin:
        starts = F.transform(F.sequence(F.lit(1), F.char_length("text")), lambda n: F.left("text", n))
        begin = patterns.filter(is_known & (F.col("test") == PREFIX)).select("fragment", *values)
        found.append(texts.select("text", F.explode(starts).alias("fragment")).join(begin, "fragment").select("text", *values))
    if sizes:
        grams = F.array_distinct(F.flatten(F.array(*[_grams(F.col("text"), n) for n in sizes])))
        part = F.pmod(F.xxhash64("text"), F.lit(PARTS)).cast("int")
        pieces = texts.select("text", part.alias("part"), F.explode(grams).alias("gram"))
        counts = pieces.groupBy("gram").agg(F.count("*").alias("n"))
        own = F.flatten(F.transform(_held("fragment"), _own_grams))
        asked = known.select("fragment").distinct().select("fragment", F.explode(own).alias("gram"))
        chosen = (
            asked.join(counts, "gram", "left")
            .groupBy("fragment")
            .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"))
            .filter("rarest.n > 0")
            .select("fragment", "rarest.gram")
        )
        index = materialize(known.join(chosen, "fragment"), "fragments")
        index = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        # A table small enough is sent to the texts by Spark's own check of its size.
        pairs = pieces.join(index, ["gram", "part"])
        fits = (F.col("test") != REGEX) | F.expr("text rlike regex")
        holds = F.forall(_literals("fragment"), lambda x: F.contains("text", x))
        found.append(pairs.filter(holds & fits).select("text", *values))
    out = found[0]
    for more in found[1:]:
        out = more if out is None else out.unionByName(more)
    return texts.select("text", *[F.lit(None).cast(patterns.schema[v].dataType).alias(v) for v in values]).limit(0) if out is None else out


def _tried(texts: DataFrame, loose: DataFrame, n: int, values: list[str]) -> DataFrame | None:
    """Pairs for the ``n`` patterns without fragment: every text is tried, SLICE patterns at a time."""
    if not n:
        return None
    numbered = materialize(number_rows(loose.select("regex", *values), ["regex"], name="_no"), "loose")
    out = None
    for start in range(0, n, SLICE):
        some = F.broadcast(numbered.filter(f"_no > {start} and _no <= {start + SLICE}"))  # SLICE rows
        part = texts.join(some, F.expr("text rlike regex")).select("text", *values)
        out = part if out is None else out.unionByName(part)
    return out
