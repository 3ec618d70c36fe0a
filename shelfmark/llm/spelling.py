"""Grouping of spelling variants: words one edit apart, found by pivotal grams.

A word's bigrams are put in one order, rare ones first (then by place); its gram prefix
are the first GRAMS of them. Two of these that do not overlap are its pivots. One edit
leaves one pivot whole, and all of the word on the far side of it: either the word up to
the left pivot's end, or the word from the right pivot on. If a word's gram prefix ends
no later in the order than that of a near word, the whole pivot is in the near word's
gram prefix, at the same distance from the same end. So pivots are looked up among the
gram prefixes of other words by gram, place and side; what meets is verified exactly.

Which pivots: the pair that few words should meet, by a dynamic programme over the places
of the gram prefix (least cost of a left pivot so far, plus the cost of a right one). The
cost of a place is the number of words expected to agree on that side of it, from the
frequencies of bigrams. Keys that many words should share are split by salt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import lower_ascii, mixed
from shelfmark.session import materialize

LEAST_LETTERS, LEAST_COUNT = 7, 2
# A word's form occurs at least so many times as often.
RATIO = 10
# Every so-manieth occurrence, by checksum, loses a letter.
DAMAGED = 31
# Length of the gram prefix: at least 3, so that two of its grams do not overlap.
GRAMS = 4
# Rows of a group, words that a key is expected to have for each of its salts, pairs at once.
GROUP_ROWS, SALT_WORDS, PAIRS = 200_000, 20_000, 1_000_000
# Logarithms of chances are whole numbers, so that equal keys have equal ones anywhere.
UNIT = 1 << 16
_BASE = np.uint64(0x5851F42D4C957F2D)


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n: runs of letters (A-Z lower-cased), some of which lose a letter by checksum.

    A null doc_id counts as the empty text in the checksum. Words of fewer than
    LEAST_LETTERS letters or LEAST_COUNT occurrences are left out.
    """
    runs = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit("[a-zÀ-ÿ]+"), F.lit(0))
    runs = F.filter(runs, lambda r: F.char_length(r) >= LEAST_LETTERS)  # a letter less never helps
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    code = F.crc32(name.cast("binary"))
    place = (F.col("code") % F.char_length("run")).cast("int")
    less = F.concat(F.col("run").substr(F.lit(1), place), F.col("run").substr(place + 2, F.char_length("run")))
    words = (
        docs.select("doc_id", F.explode(runs).alias("run"))
        .select("run", code.alias("code"))
        .select(F.when(F.col("code") % DAMAGED == 0, less).otherwise(F.col("run")).alias("word"))
    )
    counts = words.filter(F.char_length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= LEAST_COUNT)


class _Letters:
    """The letters of a column of words as bytes, one for each: of two UTF-8 bytes the second."""

    def __init__(self, words: pa.Array):
        words = words.cast(pa.large_string())
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        letter = data != 0xC3
        before = np.concatenate([[0], np.cumsum(letter)])[offsets - offsets[0]]
        self.codes, self.starts, self.lengths = data[letter], before[:-1], np.diff(before)

    def matrix(self, rows: np.ndarray) -> np.ndarray:
        """Rows of equal length as a matrix."""
        return self.codes[self.starts[rows][:, None] + np.arange(self.lengths[rows[0]])]

    def packed(self, rows: np.ndarray, chunks: int, backwards: bool) -> np.ndarray:
        """Rows as 8-letter integers, the first letter (or the last) lowest; zeros fill up."""
        lengths = self.lengths[rows]
        out = np.zeros((len(rows), 8 * chunks), np.uint8)
        own = np.repeat(np.arange(len(rows)), lengths)
        at = np.arange(len(own)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[own, np.repeat(lengths - 1, lengths) - at if backwards else at] = self.codes[np.repeat(self.starts[rows], lengths) + at]
        return out.view("<u8")


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of bigrams of a task, the ends of words (0) among the letters."""
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        letters = _Letters(batch.column("word"))
        n = len(letters.starts)
        ended = np.zeros(len(letters.codes) + n + 1, np.int64)
        ended[np.arange(len(letters.codes)) + np.repeat(np.arange(n), letters.lengths) + 1] = letters.codes
        total += np.bincount((ended[:-1] << 8) | ended[1:], minlength=1 << 16)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])


class _Model:
    """Order of the bigrams, and the chance of a letter after or before another."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, n_words: int):
        table = np.zeros(1 << 16, np.int64)
        table[grams] = counts
        self.n_words = n_words
        self.rank = np.empty(1 << 16, np.int64)
        self.rank[np.lexsort((np.arange(1 << 16), table))] = np.arange(1 << 16)
        square = table.reshape(256, 256).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            after = np.log2(square / square.sum(axis=1, keepdims=True))
            before = np.log2(square / square.sum(axis=0, keepdims=True))
        whole = lambda x: np.where(np.isfinite(x), np.round(x * UNIT), 0).astype(np.int64).ravel()
        self.after, self.before = whole(after), whole(before)

    def expected(self, chance: np.ndarray) -> np.ndarray:
        """Words expected to have a key, from the logarithm of its chance."""
        return self.n_words * np.exp2(np.maximum(chance, -1000 * UNIT) / UNIT)

    def salts(self, chance: np.ndarray) -> np.ndarray:
        """Parts of a key: a power of two, from whole numbers alone."""
        most = int(np.ceil(np.log2(max(self.n_words / SALT_WORDS, 1))))
        return 1 << np.maximum(most + (chance // UNIT), 0)


def _pivots(cost_left: np.ndarray, cost_right: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the left and right pivot of least total cost, not overlapping."""
    left = np.where(inside, cost_left, np.inf)
    right = np.where(inside, cost_right, np.inf)
    least = np.minimum.accumulate(left, axis=1)
    total = right.copy()
    total[:, 2:] += least[:, :-2]
    total[:, :2] = np.inf
    b = total.argmin(axis=1)
    open_ = np.arange(left.shape[1]) <= b[:, None] - 2
    return np.where(open_, left, np.inf).argmin(axis=1), b


def _entries(model, n_groups: int):
    """Index entries of words: for each key of the gram prefix, and for the two pivots.

    key, is_pivot, is_left, last (end of the gram prefix in the order of grams), other (place
    of the left pivot, for right ones), word, n, group.
    """

    def of_length(rows: np.ndarray, letters: _Letters) -> dict:
        codes, m = letters.matrix(rows).astype(np.int64), model.value
        n = codes.shape[1]
        grams = (codes[:, :-1] << 8) | codes[:, 1:]
        order = (m.rank[grams] << 32) | np.arange(n - 1)
        k = min(GRAMS, n - 1)
        last = np.partition(order, k - 1, axis=1)[:, k - 1 : k]
        inside = order <= last
        # Logarithms of the chance of the word up to the end of a gram, and from a gram on.
        to = m.after[codes[:, 0]][:, None] + np.cumsum(m.after[grams], axis=1)
        from_ = m.before[codes[:, -1] << 8][:, None] + np.cumsum(m.before[grams][:, ::-1], axis=1)[:, ::-1]
        a, b = _pivots(m.expected(to), m.expected(from_), inside)
        # Hashes of the same parts; what they mistake is found out by verification.
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]))
            head = np.cumsum(codes.astype(np.uint64) * power, axis=1)[:, 1:]
            tail = np.cumsum(codes[:, ::-1].astype(np.uint64) * power, axis=1)[:, ::-1][:, :-1]
        place = np.arange(n - 1, dtype=np.uint64)
        head, tail = mixed(head + (place << np.uint64(1))), mixed(~tail + (place[::-1] << np.uint64(1)))
        own = mixed(head[:, -1])
        # From the right a gram may stand one place later than in the near word.
        further = inside | (order == last + 1)
        parts = []
        for is_left, keys, chance, index, pivot in ((True, head, to, inside, a), (False, tail, from_, further, b)):
            salts = m.salts(chance)
            i, p = np.nonzero(index)
            copies = salts[i, p]
            i, p = np.repeat(i, copies), np.repeat(p, copies)
            salt = np.arange(len(i)) - np.repeat(np.cumsum(copies) - copies, copies)
            parts.append((is_left, False, i, keys[i, p], salt))
            i = np.arange(len(rows))
            parts.append((is_left, True, i, keys[i, pivot], (own % salts[i, pivot].astype(np.uint64)).astype(np.int64)))
        return {
            "key": np.concatenate([mixed(key + salt.astype(np.uint64) * _BASE) for *_, key, salt in parts]),
            "is_pivot": np.concatenate([np.full(len(i), pivot) for _, pivot, i, *_ in parts]),
            "is_left": np.concatenate([np.full(len(i), left) for left, _, i, *_ in parts]),
            "last": np.concatenate([last[i, 0] for _, _, i, *_ in parts]),
            "other": np.concatenate([a[i] for _, _, i, *_ in parts]),
            "at": np.concatenate([rows[i] for _, _, i, *_ in parts]),
        }

    def run(batches):
        for batch in batches:
            letters = _Letters(batch.column("word"))
            for length in np.unique(letters.lengths):
                found = of_length(np.flatnonzero(letters.lengths == length), letters)
                at = pa.array(found.pop("at"))
                group = (found["key"] % np.uint64(n_groups)).astype(np.int64)
                found["key"] = found["key"].view(np.int64)
                columns = {name: pa.array(x) for name, x in found.items()}
                columns |= {"group": pa.array(group), "word": batch.column("word").take(at), "n": batch.column("n").take(at)}
                yield pa.RecordBatch.from_pydict(columns)

    return run


ENTRIES = "key long, is_pivot boolean, is_left boolean, last long, other long, group long, word string, n long"


def _zero_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the lowest bytes are zero, up to 8."""
    return np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3


def _agreeing(letters: _Letters, i: np.ndarray, j: np.ndarray, chunks: int, backwards: bool):
    """Letters that pairs of words agree on from one end, and which word is less by its integers."""
    rows, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    packed = letters.packed(rows, chunks, backwards)
    i, j = place[: len(i)], place[len(i) :]
    agreeing, less = np.zeros(len(i), np.int64), np.zeros(len(i), bool)
    open_ = np.arange(len(i))
    for c in range(chunks):
        one, two = packed[i[open_], c], packed[j[open_], c]
        apart = one ^ two
        agreeing[open_] += np.minimum(_zero_bytes(apart), 8)
        less[open_] = one < two
        open_ = open_[apart == 0]
    return agreeing, less


def _near(letters: _Letters, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of words: whether they are one edit apart, letters they begin with alike, whether i is less."""
    longer = np.maximum(letters.lengths[i], letters.lengths[j])
    shorter = np.minimum(letters.lengths[i], letters.lengths[j])
    near, head, less = np.zeros(len(i), bool), np.zeros(len(i), np.int64), np.zeros(len(i), bool)
    chunks = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(longer, 1) / 8)).clip(0).astype(np.int64))
    for c in np.unique(chunks):
        some = np.flatnonzero(chunks == c)
        step = max(1, PAIRS // int(c))
        for start in range(0, len(some), step):
            at = some[start : start + step]
            head[at], less[at] = _agreeing(letters, i[at], j[at], int(c), False)
            at = at[head[at] < longer[at]]
            tail, _ = _agreeing(letters, i[at], j[at], int(c), True)
            same = longer[at] == shorter[at]
            near[at] = head[at] + tail >= np.where(same, longer[at] - 1, shorter[at])
    return near, head, less


def _matched(group: pa.Table) -> pa.Table:
    """Near words of a group: word, near, near_n, each pair found once and given both ways."""
    group = group.combine_chunks()
    column = lambda name: group.column(name).to_numpy()
    words = group.column("word").combine_chunks()
    words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
    letters, last, other = _Letters(words), column("last"), column("other")
    is_pivot, is_left = column("is_pivot").astype(bool), column("is_left").astype(bool)
    _, key = np.unique(column("key"), return_inverse=True)
    span = int(letters.lengths.max()) + 3
    place = key * span + letters.lengths + 1
    pivots, index = np.flatnonzero(is_pivot), np.flatnonzero(~is_pivot)
    index = index[np.argsort(place[index], kind="stable")]
    low = np.searchsorted(place[index], place[pivots] - 1, side="left")
    counts = np.searchsorted(place[index], place[pivots] + 1, side="right") - low
    ends = np.cumsum(counts)
    found, start = [], 0
    while start < len(pivots):
        before = ends[start] - counts[start]
        end = max(start + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
        some = counts[start:end]
        i = np.repeat(pivots[start:end], some)
        j = index[np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some) + np.repeat(low[start:end], some)]
        start = end
        # The word whose gram prefix ends first looks up the other; the sides are keys of their own.
        first = (last[i] <= last[j]) & (is_left[i] == is_left[j])
        i, j = i[first], j[first]
        near, head, less = _near(letters, i, j)
        near &= (last[i] < last[j]) | less
        near &= is_left[i] | (head < other[i] + 2)  # else the left pivot finds it too
        found.append(np.stack([i[near], j[near]]))
    i, j = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    one, two = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
    n = group.column("n")
    return pa.table({"word": words.take(one), "near": words.take(two), "near_n": n.take(two)})


def near_words(words: DataFrame) -> DataFrame:
    """All pairs of words one edit (a letter inserted, deleted or replaced) apart: word, near, near_n.

    ``words`` has word (distinct, letters a-z and U+00C0 to U+00FF, at least 4 of them) and n.
    Each pair is there both ways.
    """
    spark = words.sparkSession
    n_words = words.count()
    grams = words.select("word").mapInArrow(_gram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    grams = grams.toPandas()  # at most 91 * 91 rows: letters and the end of a word
    model = _Model(grams["gram"].to_numpy(np.int64), grams["n"].to_numpy(np.int64), n_words)
    n_groups = max(1, n_words * (2 * GRAMS + 2) // GROUP_ROWS)
    entries = words.select("word", "n").mapInArrow(_entries(spark.sparkContext.broadcast(model), n_groups), ENTRIES)
    return entries.groupBy("group").applyInArrow(_matched, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word and root, the last that its forms lead to: ``forms`` has word and form, which never go in circles."""
    state = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = state.select(F.col("word").alias("_at"), F.col("root").alias("_ahead"))
        moved = state.join(ahead, F.col("root") == F.col("_at"), "left")
        moved = materialize(moved.select("word", F.coalesce("_ahead", "root").alias("root"), F.col("_ahead").isNotNull().alias("_moved")), "roots")
        state = moved.select("word", "root")
        if moved.filter("_moved").isEmpty():
            return state


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Each word with the word it is a variant of: word, n, n_near, form, form_n, root.

    ``docs`` has doc_id and text; other columns are not read. For what a word is see
    ``word_counts``. n_near counts the words one edit apart, 0 if there are none. form is the
    near word of most occurrences, the first by code point if equal, if it has at least
    RATIO times the word's own, else null (as is form_n). root is where following forms ends:
    the word itself if it has no form. Null texts have no words; rows that repeat count each
    time. Empty tables give no rows.
    """
    words = materialize(word_counts(docs), "words")
    near = near_words(words)
    # The struct with the least -n, then the least word.
    best = near.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")
    )
    near_of = best.select(F.col("word").alias("_word"), "n_near", F.col("best.near").alias("near"), (-F.col("best.m")).alias("near_n"))
    joined = words.join(near_of, F.col("word") == F.col("_word"), "left")
    is_form = F.col("near_n") >= RATIO * F.col("n")
    found = materialize(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("near")).alias("form"),
            F.when(is_form, F.col("near_n")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(found.filter(F.col("form").isNotNull())).select(F.col("word").alias("_word"), "root")
    return found.join(ends, F.col("word") == F.col("_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
