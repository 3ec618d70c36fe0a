"""Bulk renames: mapping files to names, and numbering names that collide.

In input (walk) order each file takes its new name, or, if that is taken, the
name with the first free ``_v1``, ``_v2``, ... before the extension. The scope is
the whole batch.

Done one file at a time this is a loop over a set. As tables: only names that are
proposed more than once overflow, and the k-th overflow of a name takes its k-th
free suffix. Suffixes are not free when the suffixed name was itself proposed
earlier. Those proposals ("explicit versions") are few; they are settled first,
and everything else is counting.
"""

from __future__ import annotations

from bisect import bisect_right, insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.functions.numbering import number_rows
from shelfmark.functions.skew import attach_groups
from shelfmark.functions.text import failing_on, trim_space
from shelfmark.session import materialize, new_work_path


def mapped_names(files: DataFrame, names: DataFrame) -> DataFrame:
    """Attach ``new_name`` by path; both sides must name the same files, once each.

    A blank new name keeps the old one. The job fails on an unknown or missing path and on
    a path that is named or listed twice, whatever columns are read.
    """
    wanted = names.groupBy(F.col("source_path").alias("_for")).agg(
        F.first("new_name").alias("_new"), F.count("*").alias("_names")
    )
    listed = files.groupBy("source_path").agg(F.count("*").alias("_files"))
    both = listed.withColumnRenamed("source_path", "_path").join(wanted, F.col("_path") == F.col("_for"), "full")
    problem = (
        F.when(F.col("_path").isNull(), F.concat(F.lit("name for an unknown file: "), F.col("_for")))
        .when(F.col("_for").isNull(), F.concat(F.lit("no name for "), F.col("_path")))
        .when(F.col("_names") > 1, F.concat(F.lit("several names for "), F.col("_path")))
        .when(F.col("_files") > 1, F.concat(F.lit("listed twice: "), F.col("_path")))
    )
    checked = materialize(both.filter(failing_on(problem)).select("_path", "_new"), "mapped-names")
    name = F.when(trim_space(F.col("_new")) == "", None).otherwise(F.col("_new"))
    return files.join(checked, F.col("source_path") == F.col("_path")).select(
        *files.columns, F.coalesce(name, paths.base_name("source_path")).alias("new_name")
    )


def rename_plan(named: DataFrame) -> DataFrame:
    """Rename plan for files with a ``new_name``; collisions are numbered."""
    folder = paths.parent_dir("source_path")
    prefix = F.when(folder == "/", F.lit("")).otherwise(folder)
    return resolve_collisions(named).select(
        "root_dir",
        "source_path",
        "size",
        F.lit("rename").alias("op_type"),
        paths.clean_path(F.concat(prefix, F.lit("/"), F.col("final_name"))).alias("dest_path"),
    )


_VERSION = "_v[1-9][0-9]*"  # fixed value: the suffix that numbering appends


def resolve_collisions(named: DataFrame) -> DataFrame:
    """Add ``final_name``, unique over the batch. ``source_path`` gives the order."""
    stem, ext = paths.stem("new_name"), paths.extension("new_name")
    versions = F.regexp_extract(stem, rf"((?:{_VERSION})*)\z", 1)
    parent = F.concat(F.regexp_replace(stem, rf"{_VERSION}\z", ""), ext)
    # Versions in a row at the end of the stem: "a_v1_v2" has depth 2.
    depth_of = F.size(F.split(versions, "_v")) - 1
    rows = named.select(
        "source_path",
        "new_name",
        F.col("new_name").alias("_name"),
        paths.walk_key("source_path").alias("_order"),
        depth_of.alias("depth"),
    )
    stats = materialize(
        rows.groupBy("_name", "new_name", "depth")
        .agg(F.count("*").alias("n_files"), F.min("_order").alias("first"))
        .select(
            "_name",
            "n_files",
            "first",
            "depth",
            F.when(F.col("depth") > 0, parent).alias("parent"),
            # Numbers beyond a bigint are never reached by counting.
            F.regexp_extract(stem, r"_v([1-9][0-9]*)\z", 1).try_cast("bigint").alias("version"),
        ),
        "name-counts",
    )
    deepest = stats.agg(F.max("depth")).first()[0]
    if deepest is None:
        return named.withColumn("final_name", F.col("new_name"))

    # An overflow of depth d takes a name of depth d + 1 and may so displace
    # that name's own first proposal: settle depths in turn.
    claimed = None
    settled: list[DataFrame] = []
    for depth in range(deepest + 1):
        busy = stats.filter(F.col("depth") == depth)
        if claimed is None:
            busy = busy.filter("n_files > 1").withColumn("claimed", F.lit(0))
        else:
            busy = (
                busy.join(claimed, "_name", "left")
                .withColumn("claimed", F.coalesce("claimed", F.lit(0)))
                .filter("n_files > 1 or claimed = 1")
            )
        busy = materialize(busy.select("_name", "n_files", "claimed"), "busy-names")
        if busy.isEmpty():
            claimed = None
            continue
        overflow, claimed = _settle(
            rows.filter(F.col("depth") == depth),
            busy,
            stats.filter(F.col("depth") == depth + 1),
        )
        settled.append(overflow)

    final = None
    for part in settled:
        final = part if final is None else final.unionByName(part)
    if final is None:
        return named.withColumn("final_name", F.col("new_name"))
    # Paths are unique: no hot key.
    return named.join(final, "source_path", "left").withColumn(
        "final_name",
        F.when(F.col("_suffix").isNull(), F.col("new_name")).otherwise(
            F.concat(stem, F.lit("_v"), F.col("_suffix").cast("string"), ext)
        ),
    ).drop("_suffix")


def _settle(rows: DataFrame, busy: DataFrame, below: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Settle the names of one depth.

    Returns (source_path, _suffix) of every overflow, and the names of the next
    depth that overflows take before their own first proposal.
    """
    proposals = (
        attach_groups(rows, busy, ["_name"], spread_by="source_path", how="inner")
        .select("_name", "_order", "source_path", "claimed")
        .withColumn("version", F.lit(None).cast("bigint"))
    )
    # Explicit versions of busy names enter the count as markers at their first proposal.
    marks = (
        below.filter("version is not null")
        .join(busy.select(F.col("_name").alias("parent"), "claimed"), "parent")
        .select(
            F.col("parent").alias("_name"),
            F.col("first").alias("_order"),
            F.lit(None).cast("string").alias("source_path"),
            "claimed",
            "version",
        )
    )
    has_marks = not marks.isEmpty()
    counted = number_rows(
        proposals.unionByName(marks) if has_marks else proposals,
        ["_order"],
        group_by=["_name"],
        counting=F.col("source_path").isNotNull(),
        name="seen",
    )
    # Unless an overflow of the shorter name took it, the first proposal keeps the name.
    counted = counted.withColumn("turn", F.col("seen") - (1 - F.col("claimed")))
    if not has_marks:
        return counted.filter("turn > 0").select("source_path", F.col("turn").alias("_suffix")), None
    counted = materialize(counted, "counted")
    overflow = counted.filter("source_path is not null and turn > 0")
    marked = counted.filter("source_path is null").select(
        "_name", "version", F.greatest("turn", F.lit(0)).alias("before")
    )

    sizes = busy.select("_name", (F.col("n_files") - 1 + F.col("claimed")).alias("turns"))
    versions = materialize(_walked_versions(marked.join(sizes, "_name")), "versions")
    claimed = (
        versions.filter("not skipped and version - skips <= turns")
        .select(_versioned("_name", F.col("version")).alias("_name"), F.lit(1).alias("claimed"))
    )
    # A skipped version v, the i-th of its name, shifts every turn beyond v - i.
    gaps = versions.filter("skipped").select(
        "_name",
        F.lit(None).cast("string").alias("source_path"),
        (F.col("version") - F.col("skips") - 1).alias("turn"),
        F.col("version").alias("tie"),
    )
    shifted = gaps.groupBy("_name").agg(F.count("*").alias("n_gaps")).join(sizes, "_name")
    weights = materialize(
        shifted.select("_name", F.col("turns").alias("n_files"), "n_gaps"), "shifted-names"
    )
    if weights.isEmpty():
        return overflow.select("source_path", F.col("turn").alias("_suffix")), claimed
    split = attach_groups(
        overflow.select("_name", "source_path", "turn"), weights, ["_name"], spread_by="source_path"
    )
    straight = split.filter("n_gaps is null").select("source_path", F.col("turn").alias("_suffix"))
    events = (
        split.filter("n_gaps is not null")
        .select("_name", "source_path", "turn", F.lit(-1).cast("bigint").alias("tie"))
        .unionByName(gaps)
    )
    pushed = (
        number_rows(
            events,
            ["turn", "tie"],
            group_by=["_name"],
            counting=F.col("source_path").isNull(),
            name="skipped",
        )
        .filter("source_path is not null")
        .select("source_path", (F.col("turn") + F.col("skipped")).alias("_suffix"))
    )
    return straight.unionByName(pushed), claimed


def _versioned(name: str, version: Column) -> Column:
    return F.concat(paths.stem(name), F.lit("_v"), version.cast("string"), paths.extension(name))


VERSION_BLOCK = 1 << 17  # explicit versions that one task walks


def _walked_versions(marks: DataFrame) -> DataFrame:
    """Which explicit versions are taken when the numbering reaches them: ``skipped``, and
    ``skips``, the number of versions of the name skipped before.

    ``marks`` has _name, version, turns and ``before``, the number of overflows before the
    version's own first proposal. With s versions skipped so far, version v falls to overflow
    v - s unless it was proposed before that one: it is skipped if s < v - before.

    All versions in order are cut into blocks of equal length, whatever the names. A name that
    goes on in the next block hands its count over. What a block adds to a count s is the number
    of thresholds above s, so a block's thresholds are found without knowing s; then the counts
    at the starts of blocks follow, one small aggregation for each block of the longest name.
    """
    spark = marks.sparkSession
    limit = F.col("version") - F.col("before")
    numbered = number_rows(marks, ["_name", "version"], name="_no")
    blocks = materialize(
        numbered.withColumns({"_block": F.floor((F.col("_no") - 1) / VERSION_BLOCK), "_limit": limit}), "version-blocks"
    )
    spans = blocks.groupBy("_name").agg(F.min("_block").alias("_from"), F.max("_block").alias("_to"))
    spans = spans.filter("_from < _to")  # one row at most for each end of a block
    reach = [(r["_from"], r["_to"]) for r in spans.select("_from", "_to").collect()]
    starts: list[tuple[int, int]] = []
    if reach:
        handed_on = blocks.join(F.broadcast(spans), "_name").filter("_block < _to").select("_block", "_no", "_limit")
        path = new_work_path(spark, "thresholds")
        found = handed_on.groupBy("_block").applyInPandas(_thresholds, "_block bigint, above bigint")
        found.write.partitionBy("_block").parquet(path)
        thresholds = spark.read.schema("above bigint, _block bigint").parquet(path)
        counts = [(at, 0, to) for at, to in reach]
        while counts:
            now = spark.createDataFrame([(at, s) for at, s, _ in counts], "_at bigint, s bigint")
            added = (
                thresholds.filter(F.col("_block").isin([at for at, _, _ in counts]))
                .join(F.broadcast(now), F.col("_block") == F.col("_at"))
                .groupBy("_block")
                .agg(F.count_if(F.col("above") > F.col("s")).alias("n"))
            )
            more = {r["_block"]: r["n"] for r in added.collect()}
            counts = [(at + 1, s + more.get(at, 0), to) for at, s, to in counts]
            starts += [(at, s) for at, s, _ in counts]
            counts = [c for c in counts if c[0] < c[2]]
    start = spark.createDataFrame(starts, "_at bigint, _start bigint")
    with_start = blocks.join(F.broadcast(start), F.col("_block") == F.col("_at"), "left").drop("_at")
    return with_start.groupBy("_block").applyInPandas(
        _walk_block, "_name string, version bigint, turns bigint, skipped boolean, skips bigint"
    )


def _walk_block(block):
    """The only state is the name and its count, which ``_start`` gives for the first name of a
    block if it began in an earlier one."""
    block = block.sort_values("_no")
    first = block["_start"].iloc[0]
    current, skips = block["_name"].iloc[0], 0 if first != first or first is None else int(first)
    flags, counts = [], []
    for name, limit in zip(block["_name"], block["_limit"]):
        if name != current:
            current, skips = name, 0
        counts.append(skips)
        flags.append(skips < limit)
        skips += skips < limit
    return block.assign(skipped=flags, skips=counts)[["_name", "version", "turns", "skipped", "skips"]]


def _thresholds(block):
    import pandas as pd

    above = added_above(block.sort_values("_no")["_limit"].tolist())
    return pd.DataFrame({"_block": block["_block"].iloc[0], "above": pd.Series(above, dtype="int64")})


def added_above(limits: list[int]) -> list[int]:
    """Thresholds of the steps "add 1 to s if s < limit", done in order: from s >= 0 they add
    as many as there are thresholds greater than s.

    What steps give together never falls as s grows, so one more step adds 1 below some point,
    which becomes its threshold, and nothing from there on.
    """
    found: list[int] = []
    for limit in limits:
        low, high = 0, limit
        while low < high:
            s = (low + high) // 2
            if s + len(found) - bisect_right(found, s) < limit:
                low = s + 1
            else:
                high = s
        if low > 0:
            insort(found, low)
    return found
