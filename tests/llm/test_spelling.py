import random
import re
import zlib
from collections import Counter

import pytest

from shelfmark.llm import spelling
from tests.llm.odd import documents, odd_rows

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def counted(rows):
    words = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}


def neighbours(words):
    """Words one edit apart, by what they become with one letter masked or taken out."""
    masked = {}
    for w in words:
        for k in range(len(w)):
            masked.setdefault((k, w[:k], w[k + 1 :]), []).append(w)
    near = {w: set() for w in words}
    for same in masked.values():
        for w in same:
            near[w] |= set(same)
    for w in words:
        for k in range(len(w)):
            less = w[:k] + w[k + 1 :]
            if less in near:
                near[w].add(less)
                near[less].add(w)
    return {w: x - {w} for w, x in near.items()}


def variants(words):
    near, form = neighbours(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 10 * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out)


def found(docs):
    return sorted(tuple(r) for r in spelling.spelling_variants(docs).collect())


def edited(rnd, word, letters):
    k = rnd.randrange(len(word) + 1)
    return rnd.choice([word[:k] + rnd.choice(letters) + word[k:], word[:k] + rnd.choice(letters) + word[k + 1 :], word[:k] + word[k + 1 :]])


@pytest.mark.parametrize("letters", ["ab", "abcdeé", "étaoinshrdlucmfwyp"])
@pytest.mark.parametrize("small", [False, True])
def test_near_words(spark, monkeypatch, letters, small):
    if small:
        for name, value in (("GRAMS", 3), ("GROUP_ROWS", 50), ("SALT_WORDS", 8), ("PAIRS", 64)):
            monkeypatch.setattr(spelling, name, value)
    rnd = random.Random(letters)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(7, 11))) for _ in range(250)}
    words |= {edited(rnd, w, letters) for w in list(words) for _ in range(3)}
    words |= {x * n for x in letters for n in (7, 8, 9, 40, 41, 70, 300)} | {letters[0] * 20 + letters[1] + letters[0] * n for n in range(19, 22)}
    words = {w for w in words if len(w) >= 7}
    table = spark.createDataFrame([(w, 2 + i) for i, w in enumerate(sorted(words))], "word string, n long").repartition(3)
    got = [tuple(r) for r in spelling.near_words(table).collect()]
    assert len(got) == len(set(got))
    want = {(w, x) for w, near in neighbours(words).items() for x in near}
    assert {(w, x) for w, x, _ in got} == want
    numbers = {w: 2 + i for i, w in enumerate(sorted(words))}
    assert all(n == numbers[x] for _, x, n in got)


def test_odd_documents(spark):
    rows = odd_rows()
    words = counted(rows)
    assert "x" * 70_000 in words
    assert found(documents(spark, rows)) == variants(words)


def test_variants(spark):
    rnd = random.Random(8)
    letters = "aeionstrlcdéüÀ÷"
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randint(7, 12))) for _ in range(30)]
    texts = []
    for w in base:
        chain = [w]
        for _ in range(3):
            chain.append(edited(rnd, chain[-1], letters))
        for depth, x in enumerate(chain):
            texts += [x.upper() if depth == 2 else x] * (400 // 12**depth + 2)
    rnd.shuffle(texts)
    rows = [(i, " ".join(texts[i::40]) + ". Abc-" + base[0], "en", "s") for i in range(40)]
    words = counted(rows)
    got = found(documents(spark, rows))
    assert got == variants(words)
    assert any(root != form and form is not None for _, form, root, *_ in got)


def test_nothing(spark):
    assert found(documents(spark, [])) == []
    assert found(documents(spark, [(1, None, None, None), (2, "", None, None), (3, "short words only", "en", "s")])) == []
