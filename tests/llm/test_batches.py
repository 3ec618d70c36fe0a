"""What goes to and comes from a Python worker at once is bounded in bytes, not in rows."""

import random
import uuid
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from shelfmark.llm import language, ngram_join
from tests.llm.odd import prose

BOUND = 4 << 20


def measured(monkeypatch, module, name, folder):
    """From now on, what ``module.name`` makes writes rows and bytes of each batch it gets into files."""
    make = getattr(module, name)

    def replaced(*args):
        run = make(*args) if args else make

        def measuring(batches):
            def passed():
                for batch in batches:
                    with open(f"{folder}/{name}-{uuid.uuid4().hex}", "w") as out:
                        out.write(f"{batch.num_rows} {batch.nbytes}")
                    yield batch

            yield from run(passed())

        return measuring

    monkeypatch.setattr(module, name, replaced if name != "_count_grams" else replaced())


def sizes_of(folder, name):
    return [tuple(map(int, f.read_text().split())) for f in folder.glob(f"{name}-*")]


@pytest.fixture
def long_texts(spark, tmp_path):
    """One file of 1,200 texts of some 6,000 characters and one of 1.5 MB, over 7 MB in one task."""
    rnd = random.Random(11)
    parts = [prose(rnd, 400) for _ in range(40)]
    texts = [" ".join(rnd.sample(parts, 4)) + f" number {i}" for i in range(1200)]
    rows = [(i, t, "en", "a") for i, t in enumerate([*texts, "one more word " * 110_000])]
    path = f"{tmp_path}/texts"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(path)
    return spark.read.parquet(path).coalesce(1)


def held(folder, name, n):
    sizes = sizes_of(folder, name)
    assert sum(rows for rows, _ in sizes) >= n
    assert max(size for _, size in sizes) < BOUND


def test_language_batches(spark, monkeypatch, tmp_path, long_texts):
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    measured(monkeypatch, language, "_count_grams", tmp_path)
    assert pipeline.known_language(spark, long_texts, "").count() == 1201
    held(tmp_path, "_count_grams", 800)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


@pytest.mark.parametrize("inside", [False, True])
def test_predictions_leave_in_small_batches(inside):
    """A batch is worked on and passed on in parts; rows, order and predictions stay."""
    rnd = random.Random(7)
    texts = [prose(rnd, 700) for _ in range(1500)] + [None, ""]
    columns = [pa.array(range(1502)), pa.array(texts)]
    batch = pa.RecordBatch.from_arrays(columns, names=["doc_id", "text"])
    if inside:
        batch = pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, names=["doc_id", "text"])], names=["_row"])
    table = np.log(np.random.default_rng(3).dirichlet(np.ones(1 << language.BUCKET_BITS), 2).T).astype(np.float32)
    languages = ["de", "en"]
    out = list(language._predicted(languages, SimpleNamespace(value=table))(iter([batch])))
    if inside:
        assert max(b.nbytes for b in out) < BOUND < batch.nbytes
        assert [r["text"] for b in out for r in b.column("_row").to_pylist()] == texts
    assert len(out) > 2
    langs, scores = language._predictions(texts, languages, table)
    assert [x for b in out for x in b.column("lang_pred").to_pylist()] == list(langs)
    assert np.allclose([x for b in out for x in b.column("score").to_pylist()], scores)


def test_near_duplicate_batches(spark, monkeypatch, tmp_path, long_texts):
    names = ("_set_rows", "_token_counts", "_signatures")
    for name in names:
        measured(monkeypatch, ngram_join, name, tmp_path)
    groups = ngram_join.jaccard_groups(long_texts)
    assert groups.agg(F.countDistinct("doc_id")).first()[0] == 1201
    for name in names:
        held(tmp_path, name, 1201)


def test_index_entries_leave_in_small_batches():
    """Counts and entries of a task come in batches, none is lost."""
    ids = np.arange(1500 * 800).reshape(1500, 800)
    texts = [" ".join(map(str, row)) for row in ids]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(texts)], names=["doc_id", "text"])
    copies = SimpleNamespace(value=(np.empty(0, np.int64), np.empty(0, np.int64)))
    none = SimpleNamespace(value=np.empty(0, np.int64))
    shingles = 1500 * 796
    counts = list(ngram_join._token_counts(5, 12, copies)(iter([batch])))
    assert max(b.nbytes for b in counts) < BOUND
    total = sum(ngram_join._from_planes(x, np.uint32).sum() for b in counts for x in b.column("counts").to_pylist())
    assert total == shingles
    entries = list(ngram_join._signatures(5, 1, 5, 12, none, copies)(iter([batch])))
    assert max(b.nbytes for b in entries) < BOUND
    n = sum(len(x) // 8 for b in entries for x in b.column("sigs").to_pylist())
    assert n == 1500 * min(796, 796 - -(-796 // 5) + ngram_join.MATCHES)
