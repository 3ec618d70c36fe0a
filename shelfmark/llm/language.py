"""Language ID as inference of multilingual mixtures.

Languages are models of letter n-grams, counted over all labelled training texts. A
document is a mixture: each word comes from one of its languages. Expectation
maximisation estimates the proportions; languages enter, largest proportion first, as
long as the likelihood grows by more than the penalty for one more language.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import arrow_bytes, in_batches

# Hashed n-grams of a model: 8 bytes each for a language, in the driver and every worker.
BUCKET_BITS = 17
GRAM = 3  # bytes
SMOOTHING = 0.5
FULL_ROUNDS, SET_ROUNDS = 8, 6
# Penalty for a language, times the logarithm of the number of words.
PENALTY = 2.0
# Bytes times languages worked on at once, unless one document has more.
AT_ONCE = 4_000_000
UNDETERMINED = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, by checksum of the id; a null id is not held out."""
    code = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(code % 4 == 2, F.lit(False))


def _letters(text: str | None) -> bytes:
    """Lower-case words of letters, a blank before each and after the last; b"" without letters."""
    words = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {words} ".encode("utf-8", "replace") if words else b""


def _grams(data: bytes) -> np.ndarray:
    """Buckets of the n-grams; the last one starts GRAM - 1 bytes before the end."""
    codes = np.frombuffer(data, np.uint8).astype(np.uint32)
    n = len(codes) - GRAM + 1
    grams = codes[:n].copy()
    for i in range(1, GRAM):
        grams = (grams << np.uint32(8)) | codes[i : n + i]
    return (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)


def _count_grams(batches):
    """Counts of n-grams by language of a task, as (lang, bucket, count)."""
    counts: dict[str, np.ndarray] = {}

    def rows():
        for lang, of in counts.items():
            seen = np.flatnonzero(of)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(of[seen])],
                names=["lang", "bucket", "n"],
            )

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            data = _letters(text)
            if not data:
                continue
            if lang not in counts:
                if len(counts) == 64:
                    yield from rows()
                    counts.clear()
                counts[lang] = np.zeros(1 << BUCKET_BITS, np.int64)
            grams = _grams(data)
            if len(grams) < 4096:
                np.add.at(counts[lang], grams, 1)
            else:
                counts[lang] += np.bincount(grams, minlength=1 << BUCKET_BITS)
    yield from rows()


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log likelihoods, buckets by languages, from all rows with lang and text."""
    rows = labelled.filter("lang is not null and text is not null").select("lang", "text")
    counts = rows.mapInArrow(_count_grams, "lang string, bucket int, n long")
    with arrow_bytes(labelled.sparkSession):
        found = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    table = np.full((1 << BUCKET_BITS, len(languages)), SMOOTHING)
    place = {x: i for i, x in enumerate(languages)}
    np.add.at(table, (found["bucket"].to_numpy(), found["lang"].map(place).to_numpy(int)), found["n"].to_numpy(float))
    return languages, np.log(table / table.sum(axis=0)).astype(np.float32)


def _word_scores(data: list[bytes], model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of each word in each language, and the number of words of each document."""
    joined = b"".join(data)
    codes = np.frombuffer(joined, np.uint8)
    scores = model[_grams(joined + b" " * (GRAM - 1))]
    blank = codes == 32
    # A word owns the n-grams from its leading blank to its last letter.
    starts = np.flatnonzero(blank & ~np.append(blank[1:], True))
    lengths = np.array([len(d) for d in data])
    last = np.cumsum(lengths) - 1
    scores[last] = 0  # from the closing blank into the next document
    words = np.diff(np.searchsorted(starts, np.append(0, last + 1)))
    return np.add.reduceat(scores, starts, axis=0).astype(np.float64), words


def _maximise(like: np.ndarray, of: np.ndarray, starts: np.ndarray, shares: np.ndarray, rounds: int):
    """Proportions of the languages in each document, and the log of each word's likelihood."""
    words = np.diff(np.append(starts, len(like)))[:, None]
    for _ in range(rounds):
        joint = like * shares[of]
        joint /= joint.sum(axis=1, keepdims=True)
        shares = np.add.reduceat(joint, starts, axis=0) / words
    return shares, np.log(np.maximum((like * shares[of]).sum(axis=1), 1e-300))


def mixtures(data: list[bytes], model: np.ndarray) -> np.ndarray:
    """Proportions of the languages of each document, 0 outside its set of languages."""
    scores, words = _word_scores(data, model)
    best = scores.max(axis=1, keepdims=True)
    like = np.exp(scores - best)
    n_langs = like.shape[1]
    starts = np.cumsum(words) - words
    of = np.repeat(np.arange(len(data)), words)
    even = np.full((len(data), n_langs), 1.0 / n_langs)
    full, _ = _maximise(like, of, starts, even, FULL_ROUNDS)
    order = np.argsort(-full, axis=1, kind="stable")
    result = np.zeros_like(full)
    result[np.arange(len(data)), order[:, 0]] = 1
    gained = np.add.reduceat(scores[np.arange(len(of)), order[of, 0]] - best[:, 0], starts)
    active = np.arange(len(data))
    for size in range(2, n_langs + 1):
        if not len(active):
            break
        rows = np.concatenate([np.arange(starts[i], starts[i] + words[i]) for i in active])
        own = np.repeat(np.arange(len(active)), words[active])
        firsts = np.cumsum(words[active]) - words[active]
        allowed = np.zeros((len(active), n_langs), bool)
        np.put_along_axis(allowed, order[active, :size], True, axis=1)
        begin = np.where(allowed, np.maximum(full[active], 1e-3), 0)
        begin /= begin.sum(axis=1, keepdims=True)
        shares, logs = _maximise(like[rows], own, firsts, begin, SET_ROUNDS)
        reached = np.add.reduceat(logs, firsts)
        better = reached - gained[active] > PENALTY * np.log(words[active] + 1)
        active = active[better]
        gained[active], result[active] = reached[better], shares[better]
    return result


def _predictions(texts: list[str | None], languages: list[str], table: np.ndarray):
    """Language and proportion of each text, some documents at once."""
    data = [_letters(t) for t in texts]
    langs = np.full(len(data), UNDETERMINED, object)
    scores = np.zeros(len(data))
    some = [i for i, d in enumerate(data) if d and languages]
    while some:
        size, n = 0, 0
        while n < len(some) and (not n or size + len(data[some[n]]) * len(languages) < AT_ONCE):
            size += len(data[some[n]]) * len(languages)
            n += 1
        now, some = some[:n], some[n:]
        shares = mixtures([data[i] for i in now], table)
        top = shares.argmax(axis=1)
        langs[now] = [languages[j] for j in top]
        scores[now] = np.clip(shares[np.arange(n), top], 0, 1)
    return langs, scores


def _predicted(languages: list[str], model):
    """Adds the prediction to rows whose text is a column or a field of the struct ``_row``."""

    def run(batches):
        for batch in (part for whole in batches for part in in_batches(whole)):
            names = [c for c in batch.schema.names if c != "text"]
            inside = "text" not in batch.schema.names
            texts = batch.column("_row").field("text") if inside else batch.column("text")
            langs, scores = _predictions(texts.to_pylist(), languages, model.value)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(langs, pa.string()), pa.array(scores)],
                names=[*names, "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """Language of each whole text: doc_id, held_out, lang_pred, score.

    ``docs`` has doc_id and text; nothing else is read. lang_pred is the language with
    the largest proportion (the first by code point if equal), score that proportion.
    Texts that are null or without a letter, and all texts if nothing was learned, are
    ``und`` with score 0. One row for each input row, repeated ids included.
    """
    languages, table = model
    shared = docs.sparkSession.sparkContext.broadcast(table)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text"
    )
    return rows.mapInArrow(
        _predicted(languages, shared), "doc_id long, held_out boolean, lang_pred string, score double"
    )


def fit_not_held_out(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """A model of the documents that are not held out (and have an id)."""
    return fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))


def in_known_language(
    docs: DataFrame, model: tuple[list[str], np.ndarray], *, least_share: float = 0.5
) -> DataFrame:
    """The documents, all columns, of which one language makes up at least ``least_share``.

    What is ``und`` (null text, no letter, nothing learned) goes. The rows stay in their order.
    """
    languages, table = model
    shared = docs.sparkSession.sparkContext.broadcast(table)
    schema = T.StructType(
        [
            T.StructField("_row", docs.schema),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    found = docs.select(F.struct(*docs.columns).alias("_row")).mapInArrow(_predicted(languages, shared), schema)
    return found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_share)).select("_row.*")
