"""Ignore rules applied to a manifest.

A file is hidden when it, or any directory between it and the root, matches a
rule. Rules known when the plan is built are two literal regular expressions over
the relative path, so the usual case is a map-only filter.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import globs, paths
from shelfmark.functions.numbering import running_max
from shelfmark.functions.skew import attach_groups
from shelfmark.functions.text import trim_space
from shelfmark.operators import matching
from shelfmark.session import materialize

LITERAL_LIMIT = 1000
_GLOB_CHARS = r"[*?\[\\]"


def _any(hits: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def is_ignored(rel: Column, patterns: Sequence[str]) -> Column:
    return _any([rel.rlike(r) for r in globs.tree_regexes(patterns)])


def drop_ignored(manifest: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Keep files no pattern hides."""
    rel = paths.relative_path("source_path", "root_dir")
    return manifest.filter(~is_ignored(rel, patterns))


_PARSED = T.StructType(
    [
        T.StructField("is_path", T.BooleanType()),
        *[T.StructField(n, T.StringType()) for n in ("literal", "regex")],
        T.StructField("fragments", T.ArrayType(T.StringType())),
        T.StructField("folder", T.StringType()),
        T.StructField("folder_fragments", T.ArrayType(T.StringType())),
        T.StructField("last", T.StringType()),
    ]
)


@F.pandas_udf(_PARSED)
def _parsed(patterns: pd.Series) -> pd.DataFrame:
    nothing = (None,) * len(_PARSED)
    return pd.DataFrame([globs.parsed(p) or nothing for p in patterns], columns=_PARSED.names)


@F.pandas_udf(T.StringType())
def _name_regex(last: pd.Series) -> pd.Series:
    return last.map(lambda glob: f"^{globs.glob_regex(glob)}\\z")


def _rule_table(rules: DataFrame) -> DataFrame:
    """Rules in their parts, with ``rule`` (ord, pattern, source), the first of each pattern only."""
    first = rules.select(trim_space(F.col("pattern")).alias("trimmed"), F.struct("ord", "pattern", "source").alias("rule"))
    first = first.filter("trimmed <> ''").groupBy("trimmed").agg(F.min("rule").alias("rule"))
    return materialize(first.select("rule", _parsed("trimmed").alias("p")).select("rule", "p.*"), "ignore-rules")


def _least(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("rule").alias("rule"))


def _regex_rows(rows: DataFrame, regex: str, fragments: str, *values: str) -> DataFrame:
    return rows.select(
        F.lit(matching.REGEX).alias("test"), F.explode_outer(fragments).alias("fragment"), F.col(regex).alias("regex"), *values
    )


def _literal_rows(rows: DataFrame, test: str, literal: Column, *values: str) -> DataFrame:
    return rows.select(F.lit(test).alias("test"), literal.alias("fragment"), F.lit(None).cast("string").alias("regex"), *values)


def _name_hits(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """_name, _is_dir and the first name rule: a glob of the name, or how a directory's name begins."""
    names = materialize(entries.groupBy(F.col("_name").alias("text")).agg(F.max("_is_dir").alias("of_dir")), "entry-names")
    is_glob = F.col("literal").rlike(_GLOB_CHARS)
    globs_ = rules.filter(F.col("regex").isNotNull() & is_glob)
    plain = rules.filter(F.col("regex").isNotNull() & ~is_glob)
    of_all = _regex_rows(globs_, "regex", "fragments", "rule").unionByName(_literal_rows(plain, matching.EQUALS, F.col("literal"), "rule"))
    both = F.explode(F.array(F.lit(False), F.lit(True))).alias("_is_dir")
    hits = _least(matching.matches(names.select("text"), of_all), "text").select(F.col("text").alias("_name"), both, "rule")
    begin = _literal_rows(rules, matching.PREFIX, F.col("literal"), "rule")
    of_dirs = _least(matching.matches(names.filter("of_dir").select("text"), begin), "text")
    of_dirs = of_dirs.select(F.col("text").alias("_name"), F.lit(True).alias("_is_dir"), "rule")
    return _least(hits.unionByName(of_dirs), "_name", "_is_dir")


def _path_hits(entries: DataFrame, rules: DataFrame, kinds: Row, deep: bool) -> DataFrame:
    """_rel, _is_dir and the first path rule of entries that have one.

    With ``deep``, directories below one that a rule names are hit too.
    """
    rel, is_dir = F.col("_rel"), F.col("_is_dir")
    above = F.array_append(_ancestors(rel), rel) if deep else F.array(rel)
    dirs = entries.filter(is_dir).select("_rel", F.explode(above).alias("literal"))
    found = [dirs.join(_least(rules, "literal"), "literal").select("_rel", F.lit(True).alias("_is_dir"), "rule")]

    # Patterns that cannot be cut at a slash are matched with whole paths.
    odd = rules.filter("regex is not null")
    if kinds.odd:
        whole = materialize(entries.select(F.col("_rel").alias("text"), "_is_dir").distinct(), "paths")
        hits = matching.matches(whole.select("text").distinct(), _regex_rows(odd, "regex", "fragments", "rule"))
        found.append(whole.join(_least(hits, "text"), "text").select(F.col("text").alias("_rel"), "_is_dir", "rule"))

    cut = rules.filter("last is not null").select("rule", "literal", "folder", "folder_fragments", "last", "fragments")
    below = cut.filter("folder <> ''")
    if not kinds.below:
        placed = cut.select(F.lit("").alias("_dir"), "rule", "last", "fragments")
    else:
        texts = entries.filter("_dir <> ''").select(F.col("_dir").alias("text")).distinct()
        texts = materialize(texts, "folder-paths")
        values = ["rule", "last", "fragments"]
        # What stands before the last slash, if that is plain, is the folder's path itself.
        path = F.expr("left(literal, length(literal) - instr(reverse(literal), '/'))")
        is_glob = path.rlike(_GLOB_CHARS) | F.contains("literal", F.lit("\\"))
        patterns = _regex_rows(below.filter(is_glob), "folder", "folder_fragments", *values)
        patterns = patterns.unionByName(_literal_rows(below.filter(~is_glob), matching.EQUALS, path, *values))
        placed = matching.matches(texts, patterns).select(F.col("text").alias("_dir"), *values)
        placed = cut.filter("folder = ''").select(F.lit("").alias("_dir"), *values).unionByName(placed)
    placed = materialize(_least(placed, "_dir", "last", "fragments"), "placed-patterns")

    full = F.when(F.col("_dir") == "", F.col("name")).otherwise(F.concat("_dir", F.lit("/"), "name"))
    plain = placed.filter(~F.col("last").rlike(_GLOB_CHARS)).withColumn("name", F.col("last"))
    plain = _least(plain.select(full.alias("_rel"), "rule"), "_rel")
    found.append(entries.join(plain, "_rel").select("_rel", "_is_dir", "rule"))
    # Any name: one rule for a folder.
    if kinds.any_name:
        hit = entries.join(_least(placed.filter("last = '*'"), "_dir"), "_dir")
        found.append(hit.select("_rel", "_is_dir", "rule"))
    other = placed.filter(F.col("last").rlike(_GLOB_CHARS) & (F.col("last") != "*"))
    if kinds.other:
        there = entries.join(other.select("_dir").distinct(), "_dir", "left_semi")
        globs_ = other.select("last", "fragments").distinct().withColumn("regex", _name_regex("last"))
        names = materialize(there.select(F.col("_name").alias("text")).distinct(), "folder-names")
        fits = matching.matches(names, materialize(_regex_rows(globs_, "regex", "fragments", "last"), "last-patterns"))
        fits = fits.distinct().select(F.col("text").alias("_name"), "last")
        hit = there.join(fits, "_name").join(other.select("_dir", "last", "rule"), ["_dir", "last"])
        found.append(hit.select("_rel", "_is_dir", "rule"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return _least(out, "_rel", "_is_dir")


def _ancestors(rel: Column) -> Column:
    """Relative paths of the directories above an entry."""
    parts = F.split(rel, "/", -1)
    return F.transform(
        F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(
            F.array().cast("array<int>")
        ),
        lambda n: F.array_join(F.slice(parts, 1, n), "/"),
    )


def _with_parts(entries: DataFrame, is_dir: Column) -> DataFrame:
    rel = F.col("_rel")
    return entries.withColumns({"_is_dir": is_dir, "_name": paths.base_name(rel)}).withColumn(
        "_dir",
        F.when(rel.contains("/"), F.substr(rel, F.lit(1), F.length(rel) - F.length("_name") - 1)).otherwise(""),
    )


def _rules_of(entries: DataFrame, rules: DataFrame, deep: bool) -> tuple[DataFrame | None, DataFrame | None]:
    """First name rule by (_name, _is_dir), and first path rule by (_rel, _is_dir), written; None: no such rules."""
    last = F.col("last")
    kinds = rules.agg(
        F.count_if(~F.col("is_path")).alias("names"),
        F.count_if("is_path").alias("paths"),
        F.count_if(F.col("is_path") & F.col("regex").isNotNull()).alias("odd"),
        F.count_if(F.col("folder") != "").alias("below"),
        F.count_if(last == "*").alias("any_name"),
        F.count_if(last.rlike(_GLOB_CHARS) & (last != "*")).alias("other"),
    ).first()
    by_name = by_path = None
    if kinds.names:
        by_name = materialize(_name_hits(entries, rules.filter("not is_path")), "name-hits")
    if kinds.paths:
        by_path = materialize(_path_hits(entries, rules.filter("is_path"), kinds, deep), "path-hits")
    return by_name, by_path


def explain_ignored_table(entries: DataFrame, rules: DataFrame, is_dir: Column | None = None) -> DataFrame:
    """``explain_ignored`` with a rule table of any size (ord, pattern, source).

    Distinct names meet name patterns, and folders and names meet the two parts of path
    patterns, by fragments; the least ``ord`` of what hits is the first rule. Names that many
    entries share are spread (``skew.attach_groups``).
    """
    rel = paths.relative_path("source_path", "root_dir")
    whole = F.struct(*entries.columns).alias("_row")
    flag = F.lit(False) if is_dir is None else F.coalesce(is_dir, F.lit(False))
    rows = _with_parts(entries.select(whole, rel.alias("_rel"), flag.alias("_flag")), F.col("_flag"))
    rows = materialize(rows.drop("_flag"), "entries")
    by_name, by_path = _rules_of(rows, _rule_table(rules), deep=True)
    best = F.lit(None).cast("struct<ord:bigint,pattern:string,source:string>")
    found = rows.withColumn("_best", best)
    if by_name is not None:
        counts = rows.groupBy("_name", "_is_dir").agg(F.count("*").alias("n_files"))
        named = materialize(counts.join(by_name, ["_name", "_is_dir"]), "named-rules")
        found = attach_groups(found, named, ["_name", "_is_dir"], spread_by="_rel")
        found = found.withColumn("_best", F.col("rule")).drop("rule", "n_files")
    if by_path is not None:
        path_rule = by_path.select(F.col("_rel").alias("_of"), F.col("_is_dir").alias("_kind"), F.col("rule").alias("_path_rule"))
        found = found.join(path_rule, (F.col("_rel") == F.col("_of")) & (F.col("_is_dir") == F.col("_kind")), "left")
        found = found.withColumn("_best", F.least("_best", F.col("_path_rule")))
    return found.select(
        *[F.col(f"_row.`{c}`") for c in entries.columns], F.col("_best.pattern").alias("pattern"), F.col("_best.source").alias("source")
    )


def drop_ignored_join(manifest: DataFrame, rules: DataFrame) -> DataFrame:
    """Keep files no rule of a table hides, for rule tables of any size.

    Directories are made distinct; those a rule hits hide all below them: an interval in
    walk order. So a directory is hidden just if the furthest end of the intervals that
    began up to it is beyond it, which is a running maximum, whatever the tree looks like.
    The verdict is attached to the directory's files; files can still be hit themselves.
    """
    none = [F.lit(None).cast(t).alias(c) for c, t in (("ord", "bigint"), ("source", "string"))]
    table = _rule_table(rules.select("pattern", *none))
    rel = paths.relative_path("source_path", "root_dir")
    rows = _with_parts(manifest.select(F.struct(*manifest.columns).alias("_row"), rel.alias("_rel")), F.lit(False))
    folders = materialize(rows.groupBy("_dir").agg(F.count("*").alias("n_files")), "dirs")
    chain = F.array_append(_ancestors(F.col("_dir")), F.col("_dir"))
    dirs = folders.filter("_dir <> ''").select(F.explode(chain).alias("_rel")).distinct()
    dirs = materialize(_with_parts(dirs, F.lit(True)), "all-dirs")
    files = rows.select("_rel", "_is_dir", "_name", "_dir")
    by_name, by_path = _rules_of(files.unionByName(dirs.select(files.columns)), table, deep=False)

    hit = dirs.select("_rel", "_is_dir", "_name")
    is_hit = F.lit(False)
    if by_name is not None:
        hit = hit.join(by_name.select("_name", "_is_dir", F.lit(True).alias("_n")), ["_name", "_is_dir"], "left")
        is_hit = is_hit | F.col("_n").isNotNull()
    if by_path is not None:
        hit = hit.join(by_path.select("_rel", "_is_dir", F.lit(True).alias("_p")), ["_rel", "_is_dir"], "left")
        is_hit = is_hit | F.col("_p").isNotNull()
    # A directory's key, the separator and more is what all below it begin with.
    key = paths.walk_key("_rel")
    marked = hit.select("_rel", key.alias("_key"), F.when(is_hit, F.concat(key, F.lit("\1"))).alias("_end"))
    reached = running_max(marked, ["_key"], "_end", "_reach")
    hidden = reached.filter("_reach > _key").select(F.col("_rel").alias("_dir"), F.lit(True).alias("hidden"))
    verdicts = materialize(folders.join(hidden, "_dir", "left"), "hidden-dirs")
    kept = attach_groups(rows, verdicts, ["_dir"], spread_by="_rel").filter("hidden is null").drop("n_files", "hidden")
    if by_name is not None:
        counts = files.groupBy("_name").agg(F.count("*").alias("n_files"))
        named = counts.join(by_name.filter("not _is_dir").select("_name", F.lit(True).alias("hidden")), "_name")
        kept = attach_groups(kept, materialize(named, "hidden-names"), ["_name"], spread_by="_rel").filter("hidden is null")
    if by_path is not None:
        kept = kept.join(by_path.filter("not _is_dir").select("_rel"), "_rel", "left_anti")
    return kept.select(*[F.col(f"_row.`{c}`") for c in manifest.columns])


def hide(manifest: DataFrame, rules: DataFrame) -> DataFrame:
    """Pick the form by the checked size of the rule table; both give the same rows."""
    head = rules.select("pattern").limit(LITERAL_LIMIT + 1).collect()
    if len(head) <= LITERAL_LIMIT:
        return drop_ignored(manifest, [r.pattern for r in head])
    return drop_ignored_join(manifest, rules)


def explain_ignored(
    entries: DataFrame, rules: Sequence[Row], is_dir: Column | None = None
) -> DataFrame:
    """First rule (by ``ord``) that matches each path by itself, parents aside.

    Null pattern and source: not ignored. ``is_dir`` tells directories apart;
    by default every entry is a file.
    """
    rel = paths.relative_path("source_path", "root_dir")
    none = F.lit(None).cast("struct<pattern:string,source:string>")
    found = None  # one flat CASE, however many rules there are
    for rule in sorted(rules, key=lambda r: r.ord):
        hit = _entry_hit(rel, rule.pattern, is_dir)
        this = F.struct(F.lit(rule.pattern).alias("pattern"), F.lit(rule.source).alias("source"))
        found = F.when(hit, this) if found is None else found.when(hit, this)
    found = none if found is None else found
    return entries.withColumn("_rule", found).select(
        *entries.columns, F.col("_rule.pattern").alias("pattern"), F.col("_rule.source").alias("source")
    )


def _entry_hit(rel: Column, pattern: str, is_dir: Column | None) -> Column:
    def hit(as_dir: bool) -> Column:
        regex = globs.entry_regex(pattern, as_dir)
        return F.lit(False) if regex is None else rel.rlike(regex)

    if is_dir is None:
        return hit(False)
    return F.when(is_dir, hit(True)).otherwise(hit(False))
