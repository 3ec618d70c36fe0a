import zlib

import numpy as np
from pyspark.sql import functions as F

from shelfmark.llm import language
from tests.llm.odd import documents, odd_rows

SAYINGS = {
    "en": "the quick brown fox jumps over the lazy dog while the weather is nice and nothing else happens here",
    "de": "der schnelle braune fuchs springt über den faulen hund während das wetter schön ist und nichts geschieht",
    "fr": "le rapide renard brun saute par dessus le chien paresseux pendant que le temps est beau et rien ne bouge",
}


def corpus(n=240):
    rows = []
    for i in range(n):
        lang = list(SAYINGS)[i % 3]
        words = SAYINGS[lang].split()
        rows.append((i, " ".join(words[(i * 7 + j * 5) % len(words)] for j in range(12)), lang, "s"))
    return rows


def test_held_out_quarter(spark):
    ids = spark.range(500).withColumn("h", language.held_out(F.col("id"))).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in ids)


def test_accuracy_and_mixtures(spark):
    docs = documents(spark, corpus())
    model = language.fit_not_held_out(docs)
    got = language.identify(docs, model).collect()
    truth = {i: lang for i, _, lang, _ in corpus()}
    held = [r for r in got if r.held_out]
    assert len(held) > 40 and all(r.lang_pred == truth[r.doc_id] for r in held)
    texts = [SAYINGS["en"] + " " + SAYINGS["de"], SAYINGS["fr"], SAYINGS["en"] * 3 + " " + SAYINGS["fr"]]
    shares = language.mixtures([language._letters(t) for t in texts], model[1])
    assert model[0] == ["de", "en", "fr"]
    assert np.allclose(shares.sum(axis=1), 1)
    assert 0.35 < shares[0][1] < 0.65 and shares[0][2] == 0
    assert shares[1].tolist() == [0, 0, 1]
    assert shares[2][1] > 0.6 and shares[2][2] > 0.15 and shares[2][0] == 0


def test_batches_do_not_matter(spark, monkeypatch):
    docs = documents(spark, corpus(60) + odd_rows())
    model = language.fit_not_held_out(docs)
    want = language.identify(docs, model).collect()
    data = [t for r in docs.select("text").collect() for t in [r.text]]
    monkeypatch.setattr(language, "AT_ONCE", 500)
    langs, scores = language._predictions(data, *model)
    assert [r.lang_pred for r in want] == langs.tolist()
    assert np.allclose([r.score for r in want], scores)


def test_odd_documents(spark):
    rows = odd_rows()
    got = language.identify(documents(spark, rows), language.fit_not_held_out(documents(spark, rows))).collect()
    assert len(got) == len(rows)
    by_text = {t: g for (_, t, *_), g in zip(rows, got)}
    assert by_text[None].lang_pred == by_text[""].lang_pred == "und"
    for (_, text, *_), r in zip(rows, got):
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        assert r.lang_pred in ("und", "en", "de", "fr")


def test_nothing_learned(spark):
    docs = documents(spark, [(1, "some words", None, "s"), (2, None, "en", "s")])
    got = language.identify(docs, language.fit_not_held_out(docs)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 2
    empty = documents(spark, [])
    assert language.identify(empty, language.fit_not_held_out(empty)).collect() == []
    assert language.in_known_language(empty, language.fit_not_held_out(empty)).collect() == []


def test_filter_keeps_columns(spark):
    rows = corpus(60) + [(900, None, "en", "s"), (901, "123 !!", "en", "s"), (902, "", None, None)]
    docs = documents(spark, rows)
    kept = language.in_known_language(docs, language.fit_not_held_out(docs))
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))


def test_prediction_reads_text_only(spark):
    docs = documents(spark, corpus(90))
    model = language.fit_not_held_out(docs)
    other = docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("?")})
    assert language.identify(docs, model).collect() == language.identify(other, model).collect()
