import random

import pytest

from shelfmark.llm import ngram_join
from shelfmark.llm.common import LOWER_BYTES, WordHashes, components, shingle_set
from tests.llm.odd import documents, near_copy, odd_rows, prose
from tests.llm.test_tokens import thue_morse


def shingles(text, k):
    words = (text or "").encode().translate(LOWER_BYTES).split()
    if not words:
        return frozenset()
    k = min(k, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def linked(rows, k, num, den):
    """Component of each row, all pairs compared."""
    sets = [shingles(t, k) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[find(i)] = find(j)
    members = {}
    for i, (doc_id, *_) in enumerate(rows):
        members.setdefault(find(i), []).append(doc_id)
    names = {r: min((d for d in ids if d is not None), default=None) for r, ids in members.items()}
    return sorted(
        ((rows[i][0], len(sets[i]), names[find(i)]) for i in range(len(rows))), key=str
    )


def found(docs, **how):
    return sorted((tuple(r) for r in ngram_join.jaccard_groups(docs, **how).collect()), key=str)


@pytest.mark.parametrize("words, num, den", [(4, 85, 100), (5, 4, 5)])
def test_odd_documents(spark, words, num, den):
    rows = odd_rows()
    assert found(documents(spark, rows), words=words, num=num, den=den) == linked(rows, words, num, den)


def test_frequent_tokens_and_blocks(spark, monkeypatch):
    """Copies of copies of a few texts, so that most tokens are frequent and clusters are cut."""
    for name, value in (("LEAST_FREQUENT", 3), ("BLOCK_SETS", 16), ("BLOCK_TOKENS", 2_000), ("FLUSH", 500)):
        monkeypatch.setattr(ngram_join, name, value)
    rnd = random.Random(5)
    texts = [prose(rnd, n) for n in (40, 60, 150)]
    while len(texts) < 150:
        texts.append(near_copy(rnd, rnd.choice(texts[-40:]), rnd.choice([0, 1, 2, 3])))
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    docs = documents(spark, rows).repartition(5)
    assert found(docs, words=4, num=85, den=100) == linked(rows, 4, 85, 100)


def test_bounded_lists_change_nothing(spark, monkeypatch):
    rows = odd_rows(9)
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    monkeypatch.setattr(ngram_join, "COPY_GROUPS", 0)
    assert found(documents(spark, rows), words=4, num=85, den=100) == linked(rows, 4, 85, 100)


def test_words_with_like_hashes(spark):
    """Long words that no two texts share, though a polynomial modulo 2 ** 64 takes them for one."""
    one, other = thue_morse(10)
    rows = [(1, one, "en", "s"), (2, other, "en", "s"), (3, f"{one} a b c {other} d e f", "en", "s")]
    assert found(documents(spark, rows), words=4, num=85, den=100) == linked(rows, 4, 85, 100)


def test_empty_table(spark):
    assert found(documents(spark, [])) == []
    assert found(documents(spark, [(1, None, None, None), (2, "", None, None)])) == [(1, 0, 1), (2, 0, 2)]


def test_refuses_low_similarity(spark):
    with pytest.raises(ValueError):
        ngram_join.jaccard_groups(documents(spark, []), num=1, den=2)


def test_shingle_sets():
    hashes = WordHashes()
    rnd = random.Random(1)
    texts = [prose(rnd, n) for n in (1, 3, 4, 50, 30_000)] + ["", " \n", "a" * 200_000 + " b c d e", " x  y\t\x0bz "]
    for text in texts:
        for k in (1, 4, 5):
            assert len(shingle_set(text.encode(), k, hashes)) == len(shingles(text, k))
    # Words told apart by length, by any byte of any chunk, and by bytes that are zero.
    words = [b"a" * n for n in range(1, 300)] + [b"a" * i + b"b" + b"a" * (200 - i) for i in range(200)]
    words += [b"\0" * n for n in range(1, 40)] + [w.encode() for w in thue_morse(10)] + [b"ab", b"ba", b"abcdefgh", b"abcdefghi"]
    assert len(set(hashes.of(b" ".join(words)).tolist())) == len(set(words))
    assert (hashes.of(b"ab cd") == hashes.of(b"\n ab\t\tcd ")).all()


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == want and len(got) == len(want)
