import hashlib

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import exact_dedup
from shelfmark.session import new_work_path
from tests.llm.odd import documents, odd_rows


def written(spark, rows, parts=5):
    path = new_work_path(spark, "documents")
    documents(spark, rows).repartition(parts).write.parquet(path)
    return path


def want(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        ids = groups[text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((doc_id, keep, len(ids), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(map(str, out))


def check(rows, df):
    got = df.collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == want(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({t or "" for _, t, *_ in rows}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("files_per_batch", [1, 8])
def test_odd_documents(spark, files_per_batch):
    rows = odd_rows()
    check(rows, exact_dedup.deduplicate(spark, written(spark, rows), files_per_batch=files_per_batch))


def test_bytes_are_compared(spark, monkeypatch):
    """With a digest of one hex digit, only the comparison keeps different texts apart."""
    monkeypatch.setattr(exact_dedup, "MEMBERS", 3)
    rows = odd_rows()
    path = written(spark, rows)
    weak = exact_dedup.deduplicate(
        spark, path, digest=lambda t: F.concat(F.lit("x"), F.left(F.sha2(t, 256), F.lit(1)))
    )
    full = exact_dedup.deduplicate(spark, path)
    columns = ["doc_id", "keep_id", "group_size", "kept"]
    assert sorted(map(str, weak.select(*columns).collect())) == sorted(map(str, full.select(*columns).collect()))


def test_state_goes_on(spark):
    """A second run reads only new files and knows the texts of the first."""
    path, state = new_work_path(spark, "documents"), new_work_path(spark, "state")
    documents(spark, [(1, "a", "en", "s"), (2, "b", "en", "s")]).write.parquet(path)
    exact_dedup.update_state(spark, path, state)
    documents(spark, [(7, "a", "en", "s"), (3, "c", "en", "s")]).write.mode("append").parquet(path)
    exact_dedup.update_state(spark, path, state)
    with exact_dedup.state_settings(spark):
        got = {(r.keep_id, r.n_files) for r in exact_dedup.read_state(spark, state).collect()}
    assert got == {(7, 2), (2, 1), (3, 1)}


def test_settings_are_restored(spark):
    key = next(iter(exact_dedup.STATE_SETTINGS))
    before = spark.conf.get(key, None)
    with exact_dedup.state_settings(spark):
        assert "RocksDB" in spark.conf.get(key)
    assert spark.conf.get(key, None) == before


def test_empty_table(spark):
    assert exact_dedup.deduplicate(spark, written(spark, [], 1)).collect() == []
