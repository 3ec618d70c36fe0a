import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfmark.llm import token_counts, token_output
from shelfmark.llm.tokens import Encoder
from shelfmark.session import new_work_path
from tests.llm.odd import documents, odd_rows

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "<|endoftext|> it's don't <|startoftext|>foo CAN'T '''s 's's hello'll",
    "Ünïcode ÀÉ ßß Σίσυφος ΣΑΣ Ⅷ x²3 áb é! Å! İstanbul ﬁ ÿ× ö!…",
    "x y​z 日本語テスト 12345 a1b2 a!b ... !a a\x1cb \x85 ﻿a",
    "",
    "  \n",
    "Foo.bar foo, FOO; (foo) x.'s don't.'t \"A1b2\" 3.14 a…. b.… c.\u0301d É. É, e\u0301. !a'll'",
    "before <|ENDOFTEXT|> x<|endoftext|>y. Foo. <|endoftext| > foo.",
]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(file):
    path = public_tokenizers.path(file)
    encode, plain = Encoder(path), Tokenizer.from_file(path)
    assert encode.by_word == (file == "word_bpe_49k.json")
    texts = TEXTS + [t or "" for _, t, *_ in odd_rows()[:60]]
    for _ in range(2):
        ids, counts = encode.encode([t.encode() for t in texts] + [None])
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts] + [[]]
        assert counts.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]
        assert encode.count([t.encode() for t in texts]).tolist() == counts[:-1].tolist()


def thue_morse(n):
    """Two words of 2 ** n letters that have one hash under any polynomial modulo 2 ** 64 (n = 10)."""
    word = "a"
    swap = str.maketrans("ab", "ba")
    for _ in range(n):
        word += word.translate(swap)
    return word, word.translate(swap)


def test_encoder_forgets_and_cuts(monkeypatch):
    from shelfmark.llm import tokens

    plain = Tokenizer.from_file(WORD_BPE)
    texts = TEXTS + ["one two\nthree four", "a" * 300, "", *thue_morse(10)] + TEXTS[::-1]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for kept, at_once in ((0, 10), (20, 10), (20, 50), (100_000, 1_000)):
        monkeypatch.setattr(tokens, "KEPT_WORDS", kept)
        monkeypatch.setattr(tokens, "AT_ONCE", at_once)
        encode = Encoder(WORD_BPE)
        for _ in range(2):
            ids, counts = encode.encode([t.encode() for t in texts])
            assert counts.tolist() == [len(x) for x in want]
            assert ids.tolist() == [i for x in want for i in x]
            assert encode.count([t.encode() for t in texts]).tolist() == counts.tolist()
        assert len(encode.known) <= kept


def written(spark, rows):
    path = new_work_path(spark, "tokens")
    token_output.write_tokens(documents(spark, rows).repartition(3), path, WORD_BPE, end_id=2)
    return path


def test_orc_round_trip(spark):
    rows = odd_rows()
    plain = Tokenizer.from_file(WORD_BPE)
    got = token_output.read_tokens(spark, written(spark, rows)).orderBy("start").collect()
    assert len(got) == len(rows)
    assert [r.doc_id for r in got] == sorted((i for i, *_ in rows), key=lambda i: (i is not None, i or 0))
    want = sorted(((i, plain.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=str) == want
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_digests(spark):
    path = written(spark, [(5, "hello world", "en", "s"), (2, None, None, None), (9, "", None, None)])
    tokens = token_output.read_tokens(spark, path)
    sums = {r.doc_id: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in tokens.collect()}
    got = token_output.token_digests(tokens).collect()
    assert {r.doc_id: r.ids_crc32 for r in got} == sums
    assert [(r.doc_id, r.start) for r in sorted(got, key=lambda r: r.start)][:2] == [(2, 0), (5, 1)]


def test_words_with_like_hashes(spark):
    """Long words that differ in every letter, in one text and in two."""
    one, other = thue_morse(10)
    rows = [(1, one, None, None), (2, other, None, None), (3, f"{other} {one}", None, None)]
    plain = Tokenizer.from_file(WORD_BPE)
    got = {r.doc_id: list(r.ids) for r in token_output.read_tokens(spark, written(spark, rows)).collect()}
    assert got == {i: plain.encode(t, add_special_tokens=False).ids + [2] for i, t, *_ in rows}
    lengths = token_counts.encoded_lengths(documents(spark, rows), WORD_BPE).collect()
    assert {r.doc_id: r.n_tokens + 1 for r in lengths} == {i: len(ids) for i, ids in got.items()}


def test_one_id_for_most_rows(spark, monkeypatch):
    """Rows of one doc_id, most of them alike, are dealt to many pieces and keep their order."""
    monkeypatch.setattr(token_output, "BATCH_ROWS", 7)
    rows = [(5, "same words", "en", "s")] * 300 + [(5, f"word {i}", "en", "s") for i in range(100)]
    rows += [(i, "x y", "en", "s") for i in (1, 9, None)]
    path = written(spark, rows)
    sizes = [r["count"] for r in spark.read.orc(path).groupBy("piece").count().collect()]
    assert len(sizes) > 4 and max(sizes) < len(rows) / 3
    got = token_output.read_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1] + [5] * 400 + [9]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()


def test_other_order(spark):
    rows = [(i, f"text {i}", "en", f"s{(7 * i) % 10}") for i in range(10)]
    path = new_work_path(spark, "tokens")
    token_output.write_tokens(documents(spark, rows), path, WORD_BPE, order_by=["source", "doc_id"])
    got = token_output.read_tokens(spark, path).orderBy("start").collect()
    assert [(7 * r.doc_id) % 10 for r in got] == list(range(10))


def rows_read(df):
    """Rows that the scan of a query gave, by Spark's own count."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    leaf = leaf.executedPlan().collectLeaves().head() if "Adaptive" in leaf.nodeName() else leaf
    return leaf.metrics().get("numOutputRows").get().value()


def test_lookup_reads_little(spark):
    """Row indexes leave other stretches of rows out, Bloom filters ids that lie between those there are."""
    path = new_work_path(spark, "tokens")
    docs = spark.range(0, 80_000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    token_output.write_tokens(docs, path, WORD_BPE)
    found = token_output.find_documents(spark, path, [30_004])
    assert [r.doc_id for r in found.collect()] == [30_004]
    assert 0 < rows_read(found) <= 2_000
    absent = [token_output.find_documents(spark, path, [i]) for i in range(20_001, 20_041, 2)]
    assert sum(rows_read(df) > 0 for df in absent) <= 4


def test_empty_output(spark):
    assert token_output.token_digests(token_output.read_tokens(spark, written(spark, []))).collect() == []


def test_histogram(spark):
    rows = odd_rows()
    lengths = token_counts.encoded_lengths(documents(spark, rows), WORD_BPE)
    plain = Tokenizer.from_file(WORD_BPE)
    sizes = np.array([len(plain.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in rows])
    histogram = token_counts.length_histogram(lengths)
    got = {r.n_tokens: tuple(r)[1:] for r in histogram.collect()}
    assert got == {
        n: (
            (sizes == n).sum(),
            (sizes > n).sum(),
            (sizes <= n).sum(),
            sizes[sizes <= n].sum(),
            np.minimum(sizes, n).sum(),
        )
        for n in set(sizes.tolist())
    }
    limits = [0, 1, 7, 100, 300, 10**7]
    totals = {r.limit: (r.docs_longer, r.tokens_truncated) for r in token_counts.totals_at(histogram, limits).collect()}
    assert totals == {n: ((sizes > n).sum(), np.minimum(sizes, n).sum()) for n in limits}
    for q in (0.01, 0.5, 0.9, 1.0):
        want = np.sort(sizes)[int(np.ceil(q * len(sizes))) - 1]
        assert token_counts.quantile(histogram, q).first().n_tokens == want


def test_histogram_of_nothing(spark):
    lengths = token_counts.encoded_lengths(documents(spark, []), WORD_BPE)
    histogram = token_counts.length_histogram(lengths)
    assert histogram.collect() == []
    assert token_counts.totals_at(histogram, [1, 5]).collect() == []
    assert token_counts.quantile(histogram, 0.5).first().n_tokens is None
