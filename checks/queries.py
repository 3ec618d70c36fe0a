"""Registered queries: every operator over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from checks.views import manifest, table, view, with_content
from shelfmark.functions import names, paths
from shelfmark.operators import catalog, classify, dedupe, filters, history, ignore, rename, report
from shelfmark.plans import duplicates, planning, sorting
from shelfmark.session import materialize, new_work_path
from shelfmark.sources import content, hash_cache, listing, txn_log
from shelfmark.sources import manifest as scanning
from shelfmark.sources.ignore_files import config_ignores, first_occurrences, load_ignore_rules, parse_ignore_files
from shelfmark.sources.rule_files import parse_inline, parse_rule_files, rule_listing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def hashed(spark, sf_dir, name="v_docs") -> DataFrame:
    """Content is read once; everything downstream uses the written hashes."""
    return materialize(dedupe.hash_manifest(with_content(spark, sf_dir, name)), "hashed")


# --- duplicates -----------------------------------------------------------


@query
def dedupe_plan(spark, sf_dir):
    return dedupe.dedupe_plan(hashed(spark, sf_dir))


@query
def dedupe_full_plan(spark, sf_dir):
    return dedupe.dedupe_full_plan(hashed(spark, sf_dir, "v_mix"))


@query
def hash_partial(spark, sf_dir):
    df = dedupe.hash_manifest(with_content(spark, sf_dir, "v_docs"))
    return df.select("source_path", "partial_sha256")


@query
def hash_full(spark, sf_dir):
    df = dedupe.hash_manifest(with_content(spark, sf_dir, "v_pages"))
    return df.select("source_path", "size", "sha256")


@query
def size_groups(spark, sf_dir):
    return dedupe.group_counts(manifest(spark, sf_dir, "v_line"), dedupe.BY_SIZE)


@query
def partial_groups(spark, sf_dir):
    df = dedupe.hash_manifest(with_content(spark, sf_dir, "v_docs"))
    return dedupe.group_counts(df, dedupe.BY_PREFIX)


@query
def dup_groups(spark, sf_dir):
    return dedupe.duplicate_groups(dedupe.hash_manifest(with_content(spark, sf_dir, "v_docs")))


@query
def dup_candidates(spark, sf_dir):
    by_size = dedupe.candidates(hashed(spark, sf_dir), dedupe.BY_SIZE)
    by_prefix = dedupe.candidates(by_size, dedupe.BY_PREFIX)
    return by_prefix.select("source_path", "size", "partial_sha256")


@query
def hash_missing(spark, sf_dir):
    """Hashes are known for labelled documents only; report the others."""
    docs = view(spark, sf_dir, "v_docs")
    known = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select(
        "source_path", F.sha2(F.col("text").cast("binary"), 256).alias("sha256")
    )
    files = docs.select("root_dir", "source_path", "size")
    return dedupe.missing_hashes(files, known)


# --- rules and classification ---------------------------------------------

RULE_TEXT = """\
Pipes=ring,rod
Papers=regex(^cold.*[.]pdf$)
Misc=*
Hot=hot
Rest=*
"""


def fixture_rules(spark) -> DataFrame:
    one = spark.range(1).select(F.lit(RULE_TEXT).alias("text"))
    return parse_rule_files(one).rules


@query
def rules_load(spark, sf_dir):
    return parse_rule_files(view(spark, sf_dir, "v_rulefiles"), keys=["file_key"]).rules


@query
def rules_warnings(spark, sf_dir):
    """Every line of every document read as a rule file."""
    files = view(spark, sf_dir, "v_rulefiles").select("file_key", "text")
    docs = table(spark, sf_dir, "documents").select(
        (-F.col("doc_id") - 1).alias("file_key"), "text"
    )
    return parse_rule_files(files.unionByName(docs), keys=["file_key"]).warnings


@query
def rules_ignores(spark, sf_dir):
    return parse_rule_files(view(spark, sf_dir, "v_rulefiles"), keys=["file_key"]).ignores


@query
def rules_inline(spark, sf_dir):
    lines = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(
            F.lit("  "), "p_type", F.lit(" = "), F.replace("p_name", F.lit(" "), F.lit(",, ")),
            F.lit(",regex(^"), "p_brand", F.lit("$)"),
        ).alias("text"),
    )
    return parse_inline(lines, keys=["p_partkey"])


@query
def rules_list(spark, sf_dir):
    rules = parse_rule_files(view(spark, sf_dir, "v_rulefiles"), keys=["file_key"]).rules
    return rule_listing(rules, ["file_key"])


@query
def classify_case(spark, sf_dir):
    rules = fixture_rules(spark).collect()
    return classify.classify_case(manifest(spark, sf_dir, "v_part"), rules)


@query
def classify_join(spark, sf_dir):
    return classify.classify_join(manifest(spark, sf_dir, "v_part"), fixture_rules(spark))


@query
def classify_table(spark, sf_dir):
    """Rule table taken from the data: a keyword rule per part, patterns and fallbacks."""
    rules = view(spark, sf_dir, "v_partrules")
    return classify.classify_join(manifest(spark, sf_dir, "v_part"), rules)


def both_forms(one: DataFrame, other: DataFrame) -> DataFrame:
    """Results of two forms of an operator, which must be the same rows."""
    return one.withColumn("form", F.lit("auto")).unionByName(other.withColumn("form", F.lit("join")))


@query
def classify_auto(spark, sf_dir):
    """Few rules: the form picked by size is the literal one."""
    files = view(spark, sf_dir, "v_roots")
    rules = [
        Row(rule_idx=i, matcher_idx=0, folder=folder, raw=raw, is_regex=is_regex)
        for i, (folder, raw, is_regex) in enumerate([("a/./b", "_1", False), ("../up", "7.t", False), ("odd", "[13579][.]txt$", True)])
    ]
    rules = spark.createDataFrame(rules, "rule_idx int, matcher_idx int, folder string, raw string, is_regex boolean")
    return both_forms(classify.classify(files, rules), classify.classify_join(files, rules))


@query
def classify_auto_large(spark, sf_dir):
    """A rule table from data: the form picked by size depends on the scale, the rows do not."""
    files, rules = manifest(spark, sf_dir, "v_part"), view(spark, sf_dir, "v_partrules")
    return both_forms(classify.classify(files, rules), classify.classify_join(files, rules))


# --- filters and ignore rules ---------------------------------------------


@query
def roots_quarantine(spark, sf_dir):
    return filters.drop_quarantined(manifest(spark, sf_dir, "v_roots"))


@query
def roots_rename(spark, sf_dir):
    return rename.rename_plan(view(spark, sf_dir, "v_roots").select("root_dir", "source_path", "size", "new_name"))


@query
def ignore_auto(spark, sf_dir):
    """Padded patterns, in both forms."""
    rules = view(spark, sf_dir, "v_mixrules").select(F.concat(F.lit("\t "), "pattern", F.lit("\u00a0")).alias("pattern"))
    files = manifest(spark, sf_dir, "v_mix")
    return both_forms(ignore.hide(files, rules), ignore.drop_ignored_join(files, rules))


@query
def filter_hidden(spark, sf_dir):
    return filters.drop_hidden(manifest(spark, sf_dir, "v_mix"))


@query
def filter_depth(spark, sf_dir):
    return filters.limit_depth(manifest(spark, sf_dir, "v_mix"), 2)


@query
def filter_quarantine(spark, sf_dir):
    return filters.drop_quarantined(manifest(spark, sf_dir, "v_mix"))


LINE_PATTERNS = ["/A/F", "R/*/li_1*.dat"]
MIX_PATTERNS = ["build", "/src1", "src2/*.txt"]


@query
def filter_ignore(spark, sf_dir):
    return ignore.drop_ignored(manifest(spark, sf_dir, "v_line"), LINE_PATTERNS)


@query
def filter_ignore_join(spark, sf_dir):
    """Rules from data, one of each document: names, paths and folders, plain and as globs."""
    rules = view(spark, sf_dir, "v_mixrules")
    return ignore.drop_ignored_join(manifest(spark, sf_dir, "v_mix"), rules)


@query
def ignore_explain(spark, sf_dir):
    patterns = ["*.tmp", "promo", "/src1", "src2/*.txt", "doc_1?.txt", "build", "s*/e?/*"]
    rules = [Row(ord=i, pattern=p, source="config") for i, p in enumerate(patterns)]
    entries = manifest(spark, sf_dir, "v_mix").unionByName(manifest(spark, sf_dir, "v_part"))
    return ignore.explain_ignored(entries, rules)


@query
def ignore_explain_table(spark, sf_dir):
    """Files and the directories above them against the rules of all documents."""
    files = manifest(spark, sf_dir, "v_mix").select("root_dir", "source_path", F.lit(False).alias("is_dir"))
    dirs = catalog.directories(files).select("root_dir", F.col("dir").alias("source_path"), F.lit(True).alias("is_dir"))
    rules = view(spark, sf_dir, "v_mixrules")
    return ignore.explain_ignored_table(files.unionByName(dirs), rules, F.col("is_dir"))


def document_ignores(spark, sf_dir) -> DataFrame:
    """Each document is an ignore file; its lines are patterns."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_ord"), "source", "text"
    )
    return parse_ignore_files(docs)


@query
def ignore_load(spark, sf_dir):
    """Rule-file patterns first, then every document as an ignore file."""
    found = parse_rule_files(view(spark, sf_dir, "v_rulefiles"), keys=["file_key"]).ignores
    config = config_ignores(found)
    return first_occurrences(config.unionByName(document_ignores(spark, sf_dir)))


@query
def ignore_dedupe(spark, sf_dir):
    return first_occurrences(document_ignores(spark, sf_dir))


@query
def ignore_sources(spark, sf_dir):
    """A rule file, then ignore files on disk, one a language, and one that is not there."""
    root = new_work_path(spark, "ignore-files")
    rules = view(spark, sf_dir, "v_mixrules").withColumn("lang", F.regexp_extract("source", "-(.*)$", 1))
    text = F.when(F.col("ord") % 13 == 0, F.concat(F.lit("# "), "pattern")).otherwise(
        F.concat(F.lit("\t"), "pattern", F.when(F.col("ord") % 7 == 0, F.lit("/ \r\n\r")).otherwise(F.lit(" ")))
    )
    lines = rules.repartitionByRange("lang", "ord").sortWithinPartitions("lang", "ord")
    lines.select("lang", text.alias("value")).write.partitionBy("lang").text(root)
    langs = sorted(r.lang for r in table(spark, sf_dir, "documents").select("lang").distinct().collect())
    files = [f"{root}/none", *[f"{root}/lang={lang}" for lang in langs]]
    found = parse_rule_files(view(spark, sf_dir, "v_rulefiles"), keys=["file_key"]).ignores
    loaded = load_ignore_rules(spark, files, found)
    return loaded.withColumn("source", paths.base_name("source"))


# --- plans and catalogs ---------------------------------------------------

LINE_RULES = """\
ones=_1.dat
odd/deep=regex(_[357][.]dat$)
.=li_12
"""


def line_rules(spark) -> list[Row]:
    one = spark.range(1).select(F.lit(LINE_RULES).alias("text"))
    return parse_rule_files(one).rules.collect()


def line_plan(spark, files) -> DataFrame:
    """Moves of line items by rule; the cheapest of them are deleted instead.

    Names may repeat over folders, so a moved file takes its old folders into its name.
    """
    plan = classify.classify_case(files, line_rules(spark))
    cheap = F.expr("op_type = 'move' and size < 2000000")
    own_name = F.replace(paths.relative_path("source_path", "root_dir"), F.lit("/"), F.lit("_"))
    target = F.concat(paths.parent_dir("dest_path"), F.lit("/"), own_name)
    return plan.withColumns(
        {
            "op_type": F.when(cheap, "delete").otherwise(F.col("op_type")),
            "dest_path": F.when(~cheap, target),
        }
    )


def part_plan(spark, sf_dir) -> DataFrame:
    """Moves by the first two rules only, so that some files match nothing."""
    rules = [r for r in fixture_rules(spark).collect() if r.folder in ("Pipes", "Papers")]
    return classify.classify_case(manifest(spark, sf_dir, "v_part"), rules)


@query
def plan_effective(spark, sf_dir):
    """Folders are named after the types, so some files already are where they belong."""
    rules = [
        Row(rule_idx=0, matcher_idx=0, folder="promo", raw="ring", is_regex=False),
        Row(rule_idx=1, matcher_idx=0, folder="./x/../economy", raw="bolt", is_regex=False),
        Row(rule_idx=2, matcher_idx=0, folder="../out", raw="gear", is_regex=False),
    ]
    return filters.effective(classify.classify_case(manifest(spark, sf_dir, "v_part"), rules))


@query
def plan_summary(spark, sf_dir):
    return planning.plan_summary(line_plan(spark, manifest(spark, sf_dir, "v_line")))


@query
def apply_summary(spark, sf_dir):
    return planning.apply_summary(line_plan(spark, manifest(spark, sf_dir, "v_line")))


@query
def plan_ordered(spark, sf_dir):
    return planning.numbered(part_plan(spark, sf_dir))


@query
def plan_planners(spark, sf_dir):
    """Planner interface: filters, then a planner, then plan order."""

    def planner(files: DataFrame) -> DataFrame:
        return classify.classify(files, fixture_rules(spark))

    visible = filters.drop_hidden(manifest(spark, sf_dir, "v_mix"))
    return filters.effective(planning.plan(ignore_some(visible), planner))


@query
def plan_pipeline(spark, sf_dir):
    """From scan to the counts of what is to be done: filters, planner, order, no-ops left out."""
    visible = ignore_some(filters.drop_hidden(manifest(spark, sf_dir, "v_mix")))
    plan = planning.plan(visible, lambda files: classify.classify(files, fixture_rules(spark)))
    return planning.plan_summary(filters.effective(plan))


@query
def sort_files(spark, sf_dir):
    """Rule file with ignore lines, from scan to effective plan."""
    text = RULE_TEXT + "".join(f"!{p}\n" for p in MIX_PATTERNS)
    rules = parse_rule_files(spark.range(1).select(F.lit(text).alias("text")))
    return sorting.sort_plan(manifest(spark, sf_dir, "v_mix"), rules)


def ignore_some(files: DataFrame) -> DataFrame:
    return ignore.drop_ignored(files, MIX_PATTERNS)


@query
def plan_apply(spark, sf_dir):
    files = manifest(spark, sf_dir, "v_line")
    return catalog.apply_plan(files, materialize(line_plan(spark, files), "plan"))


def deduped_mix(spark, sf_dir) -> DataFrame:
    hashes = hashed(spark, sf_dir, "v_mix")
    files = hashes.select("root_dir", "source_path", "size")
    return catalog.apply_plan(files, materialize(dedupe.dedupe_plan(hashes), "plan"))


@query
def dup_purge(spark, sf_dir):
    return catalog.purge_duplicates(deduped_mix(spark, sf_dir))


@query
def dup_purge_count(spark, sf_dir):
    return catalog.purge_count(deduped_mix(spark, sf_dir))


@query
def apply_summary_purged(spark, sf_dir):
    """Duplicates are moved to quarantine and purged with what was there before."""
    hashes = hashed(spark, sf_dir, "v_mix")
    plan = materialize(dedupe.dedupe_full_plan(hashes), "plan")
    after = catalog.apply_plan(hashes.select("root_dir", "source_path", "size"), plan)
    return planning.apply_summary(plan, catalog.purge_count(after))


@query
def dirs_emptied(spark, sf_dir):
    """Turns and pages move to one folder; conversations and sites may lose all their files."""
    files = manifest(spark, sf_dir, "v_conv").unionByName(manifest(spark, sf_dir, "v_pages"))
    pattern = "^[0-3]_|^page_[0-9]*[0-4][.]html$"
    rules = [Row(rule_idx=0, matcher_idx=0, folder="moved", raw=pattern, is_regex=True)]
    own_name = F.concat(F.sha1("source_path"), F.lit("_"), paths.base_name("source_path"))
    plan = classify.classify_case(files, rules).withColumn(
        "dest_path", F.when(F.col("op_type") == "move", paths.joined_path("root_dir", "moved", own_name))
    )
    return catalog.emptied_directories(files, catalog.apply_plan(files, materialize(plan, "plan")))


# --- reports --------------------------------------------------------------


@query
def top_largest(spark, sf_dir):
    return report.top_largest(manifest(spark, sf_dir, "v_line"))


@query
def human_sizes(spark, sf_dir):
    files = manifest(spark, sf_dir, "v_line").unionByName(manifest(spark, sf_dir, "v_docs"))
    scaled = F.expr("case when size % 3 = 0 then size * 1000003 else size end")
    return files.select("source_path", paths.human_size(scaled).alias("human_size"))


@query
def walk_order(spark, sf_dir):
    return report.walk_positions(manifest(spark, sf_dir, "v_line"))


@query
def path_parts(spark, sf_dir):
    """Path expressions over names with many kinds of extension."""
    files = manifest(spark, sf_dir, "v_part").unionByName(manifest(spark, sf_dir, "v_pages"))
    path = F.col("source_path")
    name = paths.base_name(path)
    crooked = F.concat(path, F.lit("/../"), paths.stem(name), F.lit("/./x//"))
    return files.select(
        "source_path",
        name.alias("base"),
        paths.parent_dir(path).alias("parent"),
        paths.extension(name).alias("ext"),
        paths.stem(name).alias("stem"),
        paths.depth(paths.relative_path(path, "root_dir")).alias("depth"),
        paths.clean_path(crooked).alias("cleaned"),
    )


@query
def error_breakdown(spark, sf_dir):
    return report.error_breakdown(view(spark, sf_dir, "v_err"))


# --- history --------------------------------------------------------------


def event_log(spark, sf_dir) -> DataFrame:
    """Transactions of one operation each, as nested log rows."""
    ops = view(spark, sf_dir, "v_txn").withColumns(
        {"op_type": F.lit("move"), "size": F.col("txn_seq") * 10, "op_seq": F.lit(0)}
    )
    return txn_log.nest_operations(ops)


def written_event_log(spark, sf_dir) -> DataFrame:
    """The same, appended in two goes and read back."""
    path = new_work_path(spark, "txn-json")
    log = event_log(spark, sf_dir)
    txn_log.append_json_log(log.filter("TType = 0"), path)
    txn_log.append_json_log(log.filter("TType = 1"), path)
    return txn_log.read_json_log(spark, path)


@query
def txn_append(spark, sf_dir):
    """Flat log: two appends, read back."""
    path = new_work_path(spark, "txn-log")
    log = view(spark, sf_dir, "v_log")
    txn_log.append_log(log.filter("not irreversible"), path)
    txn_log.append_log(log.filter("irreversible"), path)
    return txn_log.read_log(spark, path)


@query
def txn_read(spark, sf_dir):
    return txn_log.flatten_log(written_event_log(spark, sf_dir))


@query
def txn_nested(spark, sf_dir):
    """Transactions of many operations: nested, written as JSON lines, read and flattened."""
    path = new_work_path(spark, "txn-json")
    txn_log.append_json_log(txn_log.nest_operations(view(spark, sf_dir, "v_log"), line_operations=1000), path)
    return txn_log.flatten_log(txn_log.read_json_log(spark, path))


@query
def txn_import(spark, sf_dir):
    """JSON lines without positions, blank lines among them; the order of lines is all there is."""
    path = new_work_path(spark, "txn-text")
    line = F.to_json(F.struct("ID", "TType", "Operations", "Irreversible"))
    blank = F.when(F.col("txn_seq") % 5 == 0, F.lit("\n")).otherwise("")
    log = event_log(spark, sf_dir).orderBy("txn_seq").select(F.concat(line, blank).alias("value"))
    log.write.text(path)
    return txn_log.flatten_log(txn_log.import_json_log(spark, path))


@query
def txn_commit(spark, sf_dir):
    """Two plans appended one after the other, each under a number of its own."""
    path = new_work_path(spark, "txn-log")
    plan = planning.numbered(part_plan(spark, sf_dir))
    txn_log.append_transaction(spark, path, plan.filter("op_type = 'skip'"), "first")
    txn_log.append_transaction(spark, path, plan.filter("op_type = 'move'"), "second", irreversible=True)
    return txn_log.read_log(spark, path)


@query
def history_nested(spark, sf_dir):
    """Transactions cut into lines of two operations are listed as one each."""
    path = new_work_path(spark, "txn-json")
    txn_log.append_json_log(txn_log.nest_operations(view(spark, sf_dir, "v_log"), line_operations=2), path)
    return history.history_listing(txn_log.read_json_log(spark, path))


@query
def history_flat(spark, sf_dir):
    return history.flat_history_listing(view(spark, sf_dir, "v_log"))


@query
def history_list(spark, sf_dir):
    return history.history_listing(written_event_log(spark, sf_dir))


@query
def last_txn(spark, sf_dir):
    return history.last_transactions(history.transactions(view(spark, sf_dir, "v_log")))


@query
def undo_plan(spark, sf_dir):
    log = view(spark, sf_dir, "v_log")
    last = history.last_transactions(history.transactions(log))
    return history.undo_plan(log, last)


@query
def undo_log(spark, sf_dir):
    log = view(spark, sf_dir, "v_log")
    last = history.last_transactions(history.transactions(log))
    return history.undo_log(log, last, txn_log.next_txn_seq(log))


# --- renames --------------------------------------------------------------


@query
def rename_map(spark, sf_dir):
    """Names per turn; blank ones keep the old name."""
    chats = view(spark, sf_dir, "v_chats")
    names = chats.select("source_path", "new_name")
    return rename.mapped_names(chats.select("root_dir", "source_path", "size"), names)


@query
def rename_collisions(spark, sf_dir):
    """Base names repeat over all conversations."""
    files = manifest(spark, sf_dir, "v_conv").withColumn("new_name", paths.base_name("source_path"))
    return rename.rename_plan(files)


@query
def rename_versions(spark, sf_dir):
    """Names that carry versions themselves and repeat."""
    files = view(spark, sf_dir, "v_versions")
    return rename.rename_plan(files)


@query
def normalize_names(spark, sf_dir):
    return names.with_normalized_name(view(spark, sf_dir, "v_names"), "name")


# --- hash cache -----------------------------------------------------------


def docs_with_mtime(spark, sf_dir) -> DataFrame:
    """Documents as files; every file has its own modification time."""
    return view(spark, sf_dir, "v_docs").withColumn("mtime", F.timestamp_seconds("doc_id"))


def older_cache(spark, sf_dir) -> DataFrame:
    """A cache that knows labelled documents; toxic ones have changed since."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return docs_with_mtime(spark, sf_dir).join(labels, "doc_id").select(
        "source_path",
        "size",
        (F.col("mtime") - F.make_dt_interval(mins=F.col("toxic"))).alias("mtime"),
        F.when(F.col("toxic") == 0, F.sha2(F.col("text").cast("binary"), 256))
        .otherwise("stale")
        .alias("sha256"),
    )


def incremental(spark, sf_dir) -> DataFrame:
    """Hashes through the cache; misses hash their text in the scan of the documents."""
    path = new_work_path(spark, "hash-cache")
    hash_cache.save_cache(spark, path, older_cache(spark, sf_dir))
    texts = docs_with_mtime(spark, sf_dir)

    def hash_misses(misses: DataFrame) -> DataFrame:
        content = texts.select("source_path", F.col("text").cast("binary").alias("content"))
        return misses.join(content, "source_path").select(*misses.columns, dedupe.content_hash("content").alias("sha256"))

    files = texts.select(
        "root_dir",
        "source_path",
        "size",
        "mtime",
        dedupe.prefix_hash(F.col("text").cast("binary")).alias("partial_sha256"),
    )
    cache = hash_cache.read_cache(spark, path)
    return materialize(dedupe.resolve_hashes(files, cache, hash_misses), "resolved")


@query
def dedupe_incremental(spark, sf_dir):
    return dedupe.dedupe_plan(incremental(spark, sf_dir))


@query
def dedupe_stats(spark, sf_dir):
    return dedupe.scan_statistics(incremental(spark, sf_dir))


@query
def cache_upsert(spark, sf_dir):
    path = new_work_path(spark, "hash-cache")
    hash_cache.save_cache(spark, path, older_cache(spark, sf_dir))
    fresh = docs_with_mtime(spark, sf_dir).filter("lang = 'en'").select(
        "source_path", "size", "mtime", F.sha2(F.col("text").cast("binary"), 256).alias("sha256")
    )
    hash_cache.save_cache(spark, path, fresh)
    return hash_cache.read_cache(spark, path).select(
        "source_path", "size", F.unix_micros("mtime").alias("mtime_us"), "sha256"
    )


@query
def cache_deltas(spark, sf_dir):
    """A cache, a delta over it, tombstones, compaction, and a delta on top."""
    path = new_work_path(spark, "hash-cache")
    docs = docs_with_mtime(spark, sf_dir)
    fresh = docs.select("source_path", "size", "mtime", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "doc_id")
    hash_cache.save_cache(spark, path, older_cache(spark, sf_dir))
    hash_cache.save_cache(spark, path, fresh.filter("doc_id % 3 = 0"))
    hash_cache.drop_from_cache(spark, path, fresh.filter("doc_id % 5 = 0"))
    hash_cache.compact_cache(spark, path)
    hash_cache.save_cache(spark, path, fresh.filter("doc_id % 10 = 0"))
    return hash_cache.read_cache(spark, path).select(
        "source_path", "size", F.unix_micros("mtime").alias("mtime_us"), "sha256"
    )


# --- files ----------------------------------------------------------------


def write_tree(rows: DataFrame, root: str, folders: list[str]) -> None:
    """Write ``text`` as files of lines, one folder level per column, named as ``partitionBy`` does.

    Rows are dealt in ranges of folder and document, so tasks are equal in size however few the
    folders are, and a folder lies in few tasks; documents that share all folders and the number
    share a file. Spark's own writer commits file by file, which is too slow for a folder per document.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = list(dict.fromkeys([*folders, "doc_id"]))
    dealt = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys, "text")
    named = [F.concat(F.lit(f"{c}="), listing.folder_name(F.col(c).cast("string"))) for c in folders]
    files = dealt.select(F.concat_ws("/", F.lit(root.rstrip("/")), *named).alias("folder"), "text")
    files.mapInArrow(listing.write_lines, "n_files bigint").agg(F.sum("n_files")).first()


def written_tree(spark, sf_dir, *folders: str) -> str:
    """Write the documents as text files, one folder level per column."""
    root = new_work_path(spark, "tree")
    write_tree(table(spark, sf_dir, "documents"), root, list(folders))
    return root


def bytes_per_folder(files: DataFrame) -> DataFrame:
    """Spark names the files; folders and bytes are what the table determines."""
    folder = paths.parent_dir(paths.relative_path("source_path", "root_dir"))
    return files.groupBy(folder.alias("folder")).agg(F.sum("size").cast("bigint").alias("n_bytes"))


@query
def manifest_scan(spark, sf_dir):
    scanning.register(spark)
    root = written_tree(spark, sf_dir, "source", "lang")
    reader = spark.read.format("file_manifest").option("partitions", 16)
    files = reader.option("ignore", '["source=src1", "/source=src2/lang=en", "_SUCCESS"]').load(root)
    return bytes_per_folder(files)


@query
def manifest_scan_tree(spark, sf_dir):
    root = written_tree(spark, sf_dir, "source", "lang")
    ignored = ["source=src1", "/source=src2/lang=en", "_SUCCESS"]
    return bytes_per_folder(scanning.scan_tree(spark, root, ignored))


@query
def manifest_scan_filters(spark, sf_dir):
    """What the scan itself leaves out: by depth, hidden names and the start of the path.

    Plain folders, hidden ones, and deeper ones side by side; the same tree whole and filtered.
    """
    scanning.register(spark)
    root = new_work_path(spark, "tree")
    for top, folders in {"plain": ["source", "lang"], ".cache": ["source"], "place": ["lang", "source", "kind"]}.items():
        docs = table(spark, sf_dir, "documents").withColumn("kind", F.col("doc_id") % 3)
        write_tree(docs, f"{root}/{top}", folders)
    options = {"details": True, "partitions": 8, "ignore": '["_SUCCESS", "*.crc"]'}
    reader = spark.read.format("file_manifest").options(**options)
    files = reader.option("hidden", True).load(root)
    some = reader.option("hidden", False).option("prefix", f"{root}/pla").option("maxDepth", 3).load(root)
    folder = paths.parent_dir(paths.relative_path("source_path", "root_dir"))

    def sums(df: DataFrame, form: str) -> DataFrame:
        grouped = df.groupBy(folder.alias("folder"), F.col("depth").cast("bigint").alias("depth"), "hidden")
        return grouped.agg(F.sum("size").cast("bigint").alias("n_bytes")).withColumn("form", F.lit(form))

    # Checksum files that the writer leaves beside its own are hidden, and no part of the table.
    whole = files.filter(~paths.base_name("source_path").startswith("."))
    return sums(whole, "whole").unionByName(sums(some, "some"))


@query
def hash_files(spark, sf_dir):
    """Every document a file; hashes of the files by folder."""
    root = written_tree(spark, sf_dir, "source", "lang", "doc_id")
    files = scanning.scan_tree(spark, root, ["_SUCCESS"])
    hashes = content.with_hashes(files)
    folder = paths.parent_dir(paths.relative_path("source_path", "root_dir"))
    return hashes.select(folder.alias("folder"), "size", "partial_sha256", "sha256")


@query
def dedupe_files(spark, sf_dir):
    """The whole funnel over a scanned tree, twice: the second run finds its hashes."""
    root = written_tree(spark, sf_dir, "source", "lang", "doc_id")
    files = scanning.scan_tree(spark, root, ["_SUCCESS"])
    cache = new_work_path(spark, "hash-cache")
    duplicates.hash_candidates(files, cache)
    again = duplicates.hash_candidates(files, cache)
    folder = paths.parent_dir(paths.relative_path("source_path", "root_dir"))
    plan = dedupe.dedupe_plan(again).select(folder.alias("folder"), "size", "op_type")
    hits = again.agg(F.count_if("from_cache").alias("hits"), F.count("*").alias("n")).first()
    return plan.withColumn("all_cached", F.lit(hits.hits == hits.n))
