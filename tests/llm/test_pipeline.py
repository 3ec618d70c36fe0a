"""Each stage of the pipeline, and all of them, against brute force on odd rows."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tests.llm.odd import documents, near_copy, odd_rows, prose
from tests.llm.test_decontaminate import brute as leaking_pairs
from tests.llm.test_mixing import check as check_mixture
from tests.llm.test_ngram_join import linked, shingles


def copies():
    """Exact and near copies with one id, with none, and with different ones."""
    rnd = random.Random(17)
    text, other, far = (prose(rnd, 80) for _ in range(3))
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (1, text, "en", "b"), (None, near_copy(rnd, text, 1), "en", None)]
    rows += [(None, near_copy(rnd, text, 1), "en", "a"), (None, other, "en", "a"), (5, near_copy(rnd, text, 1), "en", "a")]
    rows += [(1, far, "en", "a"), (None, None, None, None), (None, None, None, None), (1, "", None, ""), (1, "", None, "")]
    return rows


def benchmark(spark, folder, items):
    df = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, _row_key string")
    df.write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def rows_of(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]


def in_order(rows):
    return sorted(rows, key=str)


@pytest.fixture(params=["odd", "copies", "empty"])
def rows(request):
    return {"odd": odd_rows(), "copies": copies(), "empty": []}[request.param]


def kept_columns(out, docs):
    assert out.columns == docs.columns
    return rows_of(out)


def test_language(spark, rows):
    docs = documents(spark, rows)
    got = kept_columns(pipeline.known_language(spark, docs, ""), docs)
    assert not Counter(got) - Counter(rows)
    assert all(any(c.isalpha() for c in t) for _, t, *_ in got)
    prose_rows = [r for r in rows if r[1] and len(r[1].split()) > 20 and r[2] == "en"]
    assert not Counter(prose_rows) - Counter(got)  # all learned text is of one kind


def test_near_duplicates(spark, rows):
    """Exactly one row of each component stays; rows without words all do."""
    docs = documents(spark, rows)
    got = kept_columns(pipeline.one_of_each_group(spark, docs, ""), docs)
    assert not Counter(got) - Counter(rows)
    numbered = [(n, t, g, s) for n, (_, t, g, s) in enumerate(rows)]
    component = {n: c for n, _, c in linked(numbered, 5, 4, 5)}
    with_words = {n for n, t, *_ in numbered if shingles(t, 5)}
    groups = Counter(frozenset(m for m in component if component[m] == component[n]) for n in component)
    assert len(got) == len(groups)
    texts = Counter(component[n] for n in with_words)
    first = {}
    for n in sorted(with_words):
        first.setdefault((shingles(rows[n][1], 5)), component[n])
    assert Counter(first[shingles(t, 5)] for _, t, *_ in got if shingles(t, 5)) == Counter(dict.fromkeys(texts, 1))


def test_decontamination(spark, tmp_path, rows):
    rnd = random.Random(2)
    items = [(1, prose(rnd, 30)), (1, prose(rnd, 25)), (None, "tiny item"), (3, None), (4, "")]
    extra = [(1, f"{prose(rnd, 9)} {items[0][1]}", "en", "a"), (None, items[1][1], "en", None), (None, "a Tiny item!", None, None)]
    every = rows + (extra if rows else [])
    docs = documents(spark, every)
    got = kept_columns(pipeline.decontaminated(spark, docs, benchmark(spark, tmp_path, items)), docs)
    named = leaking_pairs([(n, t) for n, (_, t, *_) in enumerate(every)], [(n, t) for n, (_, t) in enumerate(items)])
    leaking = {n for n, _ in named}
    assert in_order(got) == in_order(r for n, r in enumerate(every) if n not in leaking)
    assert not rows or len(leaking) == 3


def test_mixture(spark, rows):
    docs = documents(spark, rows)
    out = pipeline.mixed(spark, docs, "")
    got = kept_columns(out, docs)
    plan = check_mixture(rows, pipeline.mixing.mix(docs)) if rows else []
    want = Counter()
    for r in plan:
        want[(str(r.doc_id), r.size)] += len(r.positions)
    words = lambda t: len([w for w in (t or "").encode().split()])
    assert Counter((str(i), words(t)) for i, t, *_ in got) == +want


def test_token_output(spark, rows):
    """Ids stand in the order of the files' rows."""
    docs = documents(spark, rows).coalesce(1)
    got = pipeline.encoded(spark, docs, "").orderBy("start").collect()
    plain = Tokenizer.from_file(public_tokenizers.path(pipeline.TOKENIZER))
    ids = [plain.encode(t or "", add_special_tokens=False).ids + [2] for _, t, *_ in rows]
    assert [(r.doc_id, r.n_tokens) for r in got] == [(i, len(x)) for (i, *_), x in zip(rows, ids)]
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    assert [r.start for r in got] == np.cumsum([0, *map(len, ids)])[:-1].tolist()


def test_whole_run(spark, tmp_path, rows):
    """All stages in a row; the output is in training order, with as many copies as the mixture takes."""
    rnd = random.Random(5)
    folder = benchmark(spark, tmp_path, [(1, prose(rnd, 30))])
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    got = pipeline.run(spark, folder).orderBy("start").collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = pipeline.materialize(stage(spark, docs, folder), "stage")
    plain = Tokenizer.from_file(public_tokenizers.path(pipeline.TOKENIZER))
    place = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    want = [(r.doc_id, len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs.orderBy(*place).collect()]
    assert [(r.doc_id, r.n_tokens) for r in got] == want
    assert [r.start for r in got] == [sum(n for _, n in want[:k]) for k in range(len(want))]
