import gzip
import json

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import catalog, filters, history, report
from shelfmark.plans import planning
from shelfmark.schemas import TXN_OPS
from shelfmark.sources import txn_log
from tests.conftest import paths_of

PLAN = "root_dir string, source_path string, size bigint, op_type string, dest_path string"


@pytest.fixture
def plan(spark):
    def make(*ops):
        return spark.createDataFrame([("/r", src, 1, op, dest) for op, src, dest in ops], PLAN)

    return make


def test_apply(manifest, plan):
    files = manifest(["/r/a", "/r/b", "/r/c", "/r/d"])
    ops = plan(("move", "/r/a", "/r/x/a"), ("delete", "/r/b", None), ("skip", "/r/c", None), ("move", "/r/d", "/r/d"))
    assert paths_of(catalog.apply_plan(files, ops)) == ["/r/c", "/r/d", "/r/x/a"]


@pytest.mark.parametrize(
    "ops, problem",
    [
        ([("move", "/r/a", "/r/b")], "destination_taken"),
        ([("move", "/r/a", "/r/x"), ("move", "/r/b", "/r/x")], "destination_taken"),
        ([("move", "/r/a", "/r/b"), ("move", "/r/b", "/r/x")], "chained"),
        ([("move", "/r/a", "/r/b"), ("delete", "/r/b", None)], "chained"),
        ([("move", "/r/q", "/r/x")], "no_such_file"),
        ([("move", "/r/a", "/r/x"), ("delete", "/r/a", None)], "several_operations"),
    ],
)
def test_conflicts(manifest, plan, ops, problem):
    files = manifest(["/r/a", "/r/b"])
    assert problem in {r.problem for r in catalog.plan_conflicts(files, plan(*ops)).collect()}
    with pytest.raises(Exception, match=f"plan conflict: .*{problem}"):
        catalog.apply_plan(files, plan(*ops)).count()


def test_apply_in_one_pass(spark, manifest, plan):
    """One shuffle by path, and extra columns stay."""
    files = manifest(["/r/a", "/r/b"]).withColumns({"_path": F.lit("x"), "op": F.lit(3)})
    after = catalog.apply_plan(files, plan(("move", "/r/a", "/r/x/a")))
    assert after.columns == files.columns
    assert sorted((r.source_path, r._path, r.op) for r in after.collect()) == [("/r/b", "x", 3), ("/r/x/a", "x", 3)]
    assert after._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2  # and adaptive execution's copy


def test_purged_entries_count_as_deleted(spark, plan):
    ops = plan(("delete", "/r/c", None), ("dedupe", "/r/d", "/r/duplicates/d"))
    purged = spark.createDataFrame([("/r", 3), ("/s", 2)], "root_dir string, n_entries bigint")
    assert planning.apply_summary(ops, purged).first().asDict() == {"moved": 0, "renamed": 0, "deduped": 1, "deleted": 6, "skipped": 0}
    assert planning.apply_summary(ops, purged.limit(0)).first().deleted == 1


def test_emptied_directories(manifest, plan):
    before = manifest(["/r/a/b/1", "/r/a/c/2", "/r/a/c/.DS_Store", "/r/d/.keep", "/r/d/3", "/r/e/.DS_Store", "/r/4"])
    ops = plan(("move", "/r/a/b/1", "/r/n/1"), ("move", "/r/a/c/2", "/r/n/2"), ("move", "/r/d/3", "/r/n/3"))
    after = catalog.apply_plan(before, ops)
    got = sorted(r.dir for r in catalog.emptied_directories(before, after).collect())
    assert got == ["/r/a", "/r/a/b", "/r/a/c", "/r/e"]


def test_purge(manifest):
    files = manifest(["/r/duplicates/a", "/r/duplicates/s/b", "/r/duplicates/s/c", "/r/duplicatesx/a", "/r/d"])
    assert paths_of(catalog.purge_duplicates(files)) == ["/r/d", "/r/duplicatesx/a"]
    assert [(r.root_dir, r.n_entries) for r in catalog.purge_count(files).collect()] == [("/r", 2)]


def test_write_by_folder(spark, manifest, tmp_path):
    catalog.write_by_folder(manifest(["/r/a/1", "/r/b/2"]), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.source_path, r.dest_folder) for r in back.collect()} == {("/r/a/1", "/r/a"), ("/r/b/2", "/r/b")}


def test_plan_order(plan):
    ops = plan(("move", "/r/a/b", "/r/y"), ("move", "/r/a.txt", "/r/x"), ("skip", "/r/B", None))
    assert [r.source_path for r in planning.ordered(ops).collect()] == ["/r/B", "/r/a.txt", "/r/a/b"]
    assert {r.source_path: r.op_seq for r in planning.numbered(ops).collect()} == {"/r/B": 1, "/r/a.txt": 2, "/r/a/b": 3}


def test_summaries(plan):
    ops = plan(("move", "/r/a", "/r/x"), ("move", "/r/b", "/r/b"), ("delete", "/r/c", None), ("skip", "/r/d", None))
    assert {r.op_type: r.n_ops for r in planning.plan_summary(ops).collect()} == {"move": 2, "delete": 1, "skip": 1, "total": 4}
    assert planning.apply_summary(ops).first().asDict() == {"moved": 1, "renamed": 0, "deduped": 0, "deleted": 1, "skipped": 1}
    assert filters.effective(ops).count() == 2


def test_errors(spark):
    rows = [(2, "open: Permission denied"), (1, "no such file"), (0, "invalid: file exists"), (5, "permission denied"), (6, "x")]
    got = report.error_breakdown(spark.createDataFrame(rows, "seq int, msg string")).orderBy("category").collect()
    assert [(r.category, r.n_errors, r.example) for r in got] == [
        ("collision", 1, "invalid: file exists"), ("not_found", 1, "no such file"),
        ("other", 1, "x"), ("permission", 2, "open: Permission denied"),
    ]


def test_top_ties_and_hidden(manifest):
    files = manifest(["/r/b", "/r/a", "/r/.h", "/r/c", "/r/d/e/f"], sizes=[5, 5, 99, 1, 2048])
    assert [r.rel_path for r in report.top_largest(files, 3).collect()] == ["d/e/f", "a", "b"]
    assert [r.rel_path for r in report.top_largest(files, 3, max_depth=1).collect()] == ["a", "b", "c"]


def log_of(spark, plan_df, txn_id, seq, **kw):
    return txn_log.transaction(planning.numbered(plan_df), txn_id, seq, **kw)


def test_log_and_undo_restore_the_catalog(spark, manifest, plan, tmp_path):
    path = str(tmp_path / "log")
    files = manifest(["/r/a", "/r/b", "/r/c"])
    first = plan(("move", "/r/a", "/r/x/a"), ("move", "/r/b", "/r/x/b"))
    after = catalog.apply_plan(files, first)
    txn_log.append_log(log_of(spark, first, "t", 0), path)
    log = txn_log.read_log(spark, path)
    last = history.last_transactions(history.transactions(log))
    assert [(r.id, r.status) for r in last.collect()] == [("t", "undoable")]
    undo = history.undo_plan(log, last)
    assert paths_of(catalog.apply_plan(after, undo)) == paths_of(files)

    txn_log.append_log(history.undo_log(log, last, txn_log.next_txn_seq(log)), path)
    log = txn_log.read_log(spark, path)
    last = history.last_transactions(history.transactions(log))
    assert [(r.id, r.status, r.txn_seq) for r in last.collect()] == [("t", "already_undone", 1)]
    assert history.undo_plan(log, last).count() == 0

    txn_log.append_log(log_of(spark, first, "n", 2, irreversible=True), path)
    last = history.last_transactions(history.transactions(txn_log.read_log(spark, path)))
    assert [r.status for r in last.collect()] == ["irreversible"]


def json_line(txn_id, ttype, roots, irreversible=False):
    ops = [
        {"OpType": 0, "File": {"RootDir": r, "SourcePath": f"{r}/a", "Size": 3}, "DestPath": f"{r}/b", "Size": 3} for r in roots
    ]
    return json.dumps({"ID": txn_id, "TType": ttype, "Operations": ops, "Irreversible": irreversible})


def test_import_of_a_log_without_positions(spark, tmp_path):
    lines = [json_line("2024-1 x", 0, ["/r", "/r"]), "", json_line("e", 0, []), json_line("u", 1, ["/s"])]
    (tmp_path / "history").write_text("\n".join(lines) + "\n")
    log = txn_log.import_json_log(spark, str(tmp_path / "history"))
    got = history.history_listing(log).orderBy("txn_seq").collect()
    assert [(r.compact_id, r.type, r.n_operations, r.root_dir) for r in got] == [
        ("2024-1_x", "action", 2, "/r"), ("e", "action", 0, ""), ("u", "undo", 1, "/s"),
    ]
    flat = txn_log.flatten_log(log)
    assert flat.count() == 3
    assert {r.root_dir: r.status for r in history.last_transactions(history.transactions(flat)).collect()} == {
        "/r": "undoable", "/s": "already_undone",
    }


def test_import_in_many_splits(spark, tmp_path):
    """Lines keep their order over splits that cut lines anywhere, blank ones count."""
    lines = [json_line(f"t{i}" + "x" * (i % 50), 0, ["/r"]) if i % 7 else "" for i in range(3000)]
    (tmp_path / "history").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        log = txn_log.import_json_log(spark, str(tmp_path / "history"))
        assert spark.read.text(str(tmp_path / "history")).rdd.getNumPartitions() > 20
        got = {r.txn_seq: r.ID for r in log.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {i: f"t{i}" + "x" * (i % 50) for i in range(3000) if i % 7}


def test_writers_at_the_same_time(spark, plan, tmp_path):
    """Each gets a number of its own, and the log is one order of whole transactions."""
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "log")
    numbered = planning.numbered(plan(("move", "/r/a", "/r/x"), ("move", "/r/b", "/r/y")))
    with ThreadPoolExecutor(6) as writers:
        seqs = list(writers.map(lambda i: txn_log.append_transaction(spark, path, numbered, f"t{i}"), range(6)))
    assert sorted(seqs) == list(range(6))
    listed = history.flat_history_listing(txn_log.read_log(spark, path)).collect()
    assert {(r.txn_seq, r.id, r.n_operations) for r in listed} == {(seq, f"t{i}", 2) for i, seq in enumerate(seqs)}
    assert txn_log.claim_txn_seq(spark, path) == 6
    assert txn_log.append_transaction(spark, path, numbered, "later") == 7  # the claim before was not used


@pytest.mark.parametrize("line_operations", [1, 3, 100])
def test_nested_log_of_long_transactions(spark, tmp_path, line_operations):
    rows = [(t, f"t {t}", t % 2, False, i, "move", "/r", f"/r/{i}", 9 - i, f"/r/x/{i}") for t in range(3) for i in range(8)]
    log = spark.createDataFrame(rows, TXN_OPS)
    path = str(tmp_path / "log")
    txn_log.append_json_log(txn_log.nest_operations(log, line_operations), path)
    nested = txn_log.read_json_log(spark, path)
    assert nested.count() == 3 * -(-8 // line_operations)
    whole = history.history_listing(nested).orderBy("txn_seq").collect()
    assert [(r.id, r.type, r.n_operations, r.root_dir) for r in whole] == [
        ("t 0", "action", 8, "/r"), ("t 1", "undo", 8, "/r"), ("t 2", "action", 8, "/r")
    ]
    back = txn_log.flatten_log(nested)
    assert sorted(map(tuple, back.collect())) == rows
    last = history.last_transactions(history.transactions(back))
    assert history.undo_plan(back, last).count() == 8
    listed = history.flat_history_listing(back).orderBy("txn_seq").collect()
    assert [(r.compact_id, r.type, r.n_operations) for r in listed] == [("t_0", "action", 8), ("t_1", "undo", 8), ("t_2", "action", 8)]


def test_malformed_log_line_fails(spark, tmp_path):
    (tmp_path / "log.json").write_text(json_line("a", 0, ["/r"]) + "\n{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        txn_log.read_json_log(spark, str(tmp_path / "log.json")).collect()


def test_type_codes(spark):
    df = spark.createDataFrame([("move",), ("skip",), ("undo",)], "op_type string")
    coded = df.select("op_type", planning.op_code("op_type").alias("c"))
    assert {r.op_type: r.c for r in coded.collect()} == {"move": 0, "skip": 4, "undo": 5}
    assert coded.filter(planning.op_name("c") != F.col("op_type")).count() == 0


def test_json_log_is_written_compressed(spark, tmp_path):
    """Gzipped lines, whatever reads them; the same rows return, and an import finds their numbers."""
    log = spark.range(4000).selectExpr(
        "id div 4 txn_seq", "concat('txn ', id div 4) id", "0 ttype", "false irreversible", "id % 4 op_seq", "'move' op_type",
        "'/u/1' root_dir", "concat('/u/1/in/', id) source_path", "id size", "concat('/u/1/out/', id) dest_path",
    )
    path = str(tmp_path / "log")
    txn_log.append_json_log(txn_log.nest_operations(log, line_operations=2), path)
    files = list((tmp_path / "log").glob("part-*"))
    lines = [x for f in files for x in gzip.decompress(f.read_bytes()).splitlines()]
    assert len(lines) == 2000 and all(len(json.loads(x)["Operations"]) == 2 for x in lines)
    assert sum(f.stat().st_size for f in files) * 4 < sum(map(len, lines))
    key = lambda df: sorted(map(tuple, df.select(log.columns).collect()))
    assert key(txn_log.flatten_log(txn_log.read_json_log(spark, path))) == key(log)
    assert key(txn_log.flatten_log(txn_log.import_json_log(spark, path))) == key(log)
