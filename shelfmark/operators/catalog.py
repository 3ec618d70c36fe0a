"""Applying a plan to a catalog, and what is left behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.functions.text import failing_on
from shelfmark.operators.filters import effective

MOVES = ("move", "rename", "dedupe")


def _problem(n_files: Column, n_sources: Column, n_targets: Column) -> list[Column]:
    """What is wrong with a path, by the number of files, sources and destinations it is."""
    stays = (n_files > 0) & (n_sources == 0)
    return [
        F.when((n_targets > 1) | ((n_targets > 0) & stays), "destination_taken"),
        F.when((n_targets > 0) & (n_sources > 0), "chained"),
        F.when(n_sources > 1, "several_operations"),
        F.when((n_sources > 0) & (n_files == 0), "no_such_file"),
    ]


def plan_conflicts(catalog: DataFrame, plan: DataFrame) -> DataFrame:
    """(path, problem) for everything that makes operations depend on each other.

    A destination that repeats or is the path of a file that stays would be
    overwritten; a destination that is also a source makes the result depend on
    the order of operations.
    """
    ops = effective(plan)

    def tally(df: DataFrame, path: str, role: str) -> DataFrame:
        ones = [F.lit(int(r == role)).cast("bigint").alias(r) for r in ("n_files", "n_sources", "n_targets")]
        return df.select(F.col(path).alias("path"), *ones)

    # Every path by the roles it plays: one shuffle, combined map-side.
    roles = (
        tally(catalog, "source_path", "n_files")
        .unionByName(tally(ops, "source_path", "n_sources"))
        .unionByName(tally(ops.filter(F.col("op_type").isin(*MOVES)), "dest_path", "n_targets"))
        .groupBy("path")
        .agg(*[F.sum(r).alias(r) for r in ("n_files", "n_sources", "n_targets")])
    )
    problems = F.array(*_problem(F.col("n_files"), F.col("n_sources"), F.col("n_targets")))
    return roles.select("path", F.explode(F.array_compact(problems)).alias("problem"))


def apply_plan(catalog: DataFrame, plan: DataFrame) -> DataFrame:
    """The catalog after the plan: moved files carry their new path, deleted ones go.

    Files, sources and destinations meet by path in one shuffle, and both tables are read
    once. A conflict (see ``plan_conflicts``) fails the job that reads the result, whatever
    columns it reads.
    """
    kind = "struct<path:string,op:string,dest:string,file:int,source:int,target:int>"
    files = catalog.select(
        F.col("source_path").alias("_path"),
        F.struct(*catalog.columns).alias("_row"),
        *[F.lit(v).alias(c) for c, v in (("_file", 1), ("_source", 0), ("_target", 0))],
        F.lit(None).cast("struct<op:string,dest:string>").alias("_op"),
    )
    one = lambda path, op, source, target: F.struct(path, *op, F.lit(0), F.lit(source), F.lit(target)).cast(kind)
    roles = F.array_compact(
        F.array(
            one(F.col("source_path"), (F.col("op_type"), F.col("dest_path")), 1, 0),
            F.when(F.col("op_type").isin(*MOVES), one(F.col("dest_path"), (F.lit(None), F.lit(None)), 0, 1)),
        )
    )
    ops = effective(plan).select(F.explode(roles).alias("r")).select(
        F.col("r.path").alias("_path"),
        F.lit(None).cast(catalog.schema).alias("_row"),
        *[F.col(f"r.{c}").alias(f"_{c}") for c in ("file", "source", "target")],
        F.when(F.col("r.source") == 1, F.struct("r.op", "r.dest")).alias("_op"),
    )
    same = Window.partitionBy("_path")
    counts = [F.sum(c).over(same) for c in ("_file", "_source", "_target")]
    met = files.unionByName(ops).select(
        "_path", "_row", "_file", *[n.alias(f"_n{i}") for i, n in enumerate(counts)], F.max("_op").over(same).alias("_op")
    )
    problem = F.coalesce(*_problem(F.col("_n0"), F.col("_n1"), F.col("_n2")))
    told = F.concat(F.lit("plan conflict: "), F.coalesce("_path", F.lit("no path")), F.lit(": "), problem)
    stays = met.filter(failing_on(told)).filter("_file = 1 and (_op is null or _op.op <> 'delete')")
    moved = F.coalesce(F.when(F.col("_op.op").isin(*MOVES), F.col("_op.dest")), F.col("_path"))
    return stays.select(*[moved.alias(c) if c == "source_path" else F.col(f"_row.`{c}`") for c in catalog.columns])


def write_by_folder(catalog: DataFrame, path: str) -> None:
    """Write file rows (with any content columns) into one partition per folder."""
    catalog.withColumn("dest_folder", paths.parent_dir("source_path")).write.partitionBy(
        "dest_folder"
    ).parquet(path)


def _in_quarantine() -> Column:
    return F.col("source_path").startswith(
        F.concat(paths.root_prefix("root_dir"), F.lit(f"/{paths.QUARANTINE}/"))
    )


def purge_duplicates(catalog: DataFrame) -> DataFrame:
    """Drop everything below ``<root>/duplicates``, whatever put it there."""
    return catalog.filter(~_in_quarantine())


def purge_count(catalog: DataFrame) -> DataFrame:
    """Direct entries of ``<root>/duplicates`` per root."""
    rel = paths.relative_path("source_path", "root_dir")
    return (
        catalog.filter(_in_quarantine())
        .select("root_dir", F.get(F.split(rel, "/", -1), F.lit(1)).alias("entry"))
        .groupBy("root_dir")
        .agg(F.countDistinct("entry").alias("n_entries"))
    )


def directories(catalog: DataFrame) -> DataFrame:
    """Every directory between a root and its files, root excluded."""
    parts = F.split(paths.relative_path("source_path", "root_dir"), "/", -1)
    # A file at the root has no directory; sequence(1, 0) would count down.
    levels = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1))
    return (
        catalog.select("root_dir", parts.alias("parts"), F.explode(levels).alias("level"))
        .select(
            "root_dir",
            F.concat(paths.root_prefix("root_dir"), F.lit("/"), F.array_join(F.slice("parts", F.lit(1), F.col("level")), "/")).alias("dir"),
        )
        .distinct()
    )


def emptied_directories(before: DataFrame, after: DataFrame) -> DataFrame:
    """Directories that hold no file any more, at any level.

    A lone ``.DS_Store`` does not keep a directory. Both catalogs must include
    hidden files.
    """
    kept = after.filter(paths.base_name("source_path") != ".DS_Store")
    return directories(before).join(directories(kept), ["root_dir", "dir"], "left_anti")
