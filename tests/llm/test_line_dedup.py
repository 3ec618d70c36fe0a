import random
import re

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import line_dedup as ld
from tests.llm.odd import documents, odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def weight(line):
    n = len(WORD.findall(line))
    return max(n, ld.LEAST) if n else 1


def repeated(rows, least):
    """Lines of each distinct (doc_id, text) in runs of that weight that also stand earlier: all runs are tried."""
    docs = sorted({(i, t) for i, t, *_ in rows}, key=lambda d: (d[0] is not None, d[0] or 0))
    first, gone = {}, {}
    for n, (i, text) in enumerate(docs):
        lines = (text or "").split("\n")
        weights = [weight(x) for x in lines]
        found = gone.setdefault((i, text), set())
        for a in range(len(lines)):
            for b in range(a, min(len(lines), a + least)):  # a longer run is made of such
                if sum(weights[a : b + 1]) >= least:
                    if first.setdefault(tuple(lines[a : b + 1]), (n, a)) < (n, a):
                        found |= set(range(a, b + 1))
    return gone


def check(spark, rows, parts=3):
    """Ids are distinct but for repeated rows. Returns the numbers of lines that went, by id."""
    docs = documents(spark, rows).repartition(parts)
    out = ld.dedup_lines(docs)
    assert out.columns == [*[c for c in docs.columns if c != "n_lines"], "n_lines", "n_removed"]
    got = out.select("doc_id", "text", "n_lines", "n_removed", "source").collect()
    assert len(got) == len(rows)
    keys = {(r._id, r._tie): (r.doc_id, r.text) for r in docs.select("doc_id", "text", *ld._key(docs)).collect()}
    gone = {keys[(r._id, r._tie)]: set(r.gone) for r in ld.repeated_lines(docs).collect()}
    sure, possible = repeated(rows, 2 * ld.GRAM), repeated(rows, ld.GRAM)
    for key, lines in sure.items():
        assert lines <= gone.get(key, set()) <= possible[key], key
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        text = texts[r.doc_id]
        lines = (text or "").split("\n")
        removed = gone.get((r.doc_id, text), set())
        assert (r.n_lines, r.n_removed) == (0 if text is None else len(lines), len(removed))
        assert r.text == (None if text is None else "\n".join(x for n, x in enumerate(lines) if n not in removed))
    return {r.doc_id: r.n_removed for r in got}


def line(rnd, n):
    return prose(rnd, n).replace("\n", " ")


def test_every_passage_of_50_words_goes(spark):
    """Also runs of few lines, none of them long."""
    rnd = random.Random(11)
    sizes = [(29, 28), (18, 21, 28), (7, 28, 29), (24, 29, 7), (10,) * 5, (25, 25), (13, 13, 13, 13), (50,), (1,) * 50, (49, 1), (24, 2, 24)]
    passages = [[line(rnd, n) for n in some] for some in sizes]
    rows = []
    for n in range(44):
        lines = [line(rnd, rnd.randint(1, 20)) for _ in range(4)]
        at = rnd.randint(0, 4)
        rows.append((n, "\n".join(lines[:at] + passages[n % len(passages)] + lines[at:]), "en", "s"))
    got = check(spark, rows)
    for n in range(44):
        assert got[n] == (0 if n < len(passages) else len(passages[n % len(passages)]))


@pytest.mark.parametrize("seed", range(3))
def test_random_passages(spark, seed):
    """Parts of passages in many places, next to each other and next to other lines."""
    rnd = random.Random(seed)
    passages = [[line(rnd, rnd.choice([0, 1, 3, 8, 20, 40])) for _ in range(rnd.randint(2, 14))] for _ in range(6)]
    rows = []
    for n in range(70):
        lines = [line(rnd, rnd.randint(0, 30)) for _ in range(rnd.randint(0, 4))]
        for _ in range(rnd.randint(0, 3)):
            at, some = rnd.randint(0, len(lines)), rnd.choice(passages)
            low = rnd.randint(0, len(some) - 1)
            lines[at:at] = some[low : rnd.randint(low, len(some)) + 1]
        rows.append((n, "\n".join(lines), "en", "s"))
    assert sum(check(spark, rows, 5).values()) > 60


def test_odd_documents(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    got = check(spark, rows + [(None, odd_rows()[3][1], "en", "s2")])
    assert got[None] == 0


def test_periodic_and_empty_lines(spark):
    rows = [(1, "\n".join(["same"] * 50), "en", "s"), (2, "\n".join(["a", "b"] * 20 + ["end"]), "en", "s")]
    rows += [(3, "\n" * 60, None, None), (4, "\n" * 60, None, None), (5, None, None, None), (6, "", None, None), (7, "x " * 30, "en", "s")]
    got = check(spark, rows)
    assert got[1] >= 30 and got[4] == 61


def test_repeated_rows(spark):
    rows = [(7, "x\n" + "y " * 30, "en", "s")] * 2 + [(None, "y " * 30, "en", "s")]
    out = ld.dedup_lines(documents(spark, rows)).select("doc_id", "text").collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == [(7, "x"), (7, "x"), (None, "y " * 30)]
    assert ld.dedup_lines(documents(spark, [])).collect() == []


def test_shorter_variant_first(spark):
    """A first document with part of a passage does not keep the rest in all later copies."""
    rnd = random.Random(12)
    passage = [line(rnd, n) for n in (4, 79, 1, 1, 17, 5, 7)]
    rows = [(0, "\n".join([*passage[:3], line(rnd, 9)]), "en", "s"), (1, "\n".join([line(rnd, 3), *passage]), "en", "s")]
    rows += [(n, "\n".join([line(rnd, 3), *passage, line(rnd, 4)]), "en", "s") for n in range(2, 8)]
    rows += [(8, "\n".join([line(rnd, 9), *passage[2:]]), "en", "s")]
    got = check(spark, rows)
    assert [got[n] for n in range(2, 8)] == [7] * 6


def test_one_passage_in_all_documents(spark):
    """The passage stays once, whatever stands around it."""
    rnd = random.Random(6)
    passage = [line(rnd, 12) for _ in range(8)]
    rows = [(n, "\n".join([line(rnd, 5), *passage, line(rnd, 5)]), "en", "s") for n in range(300)]
    got = check(spark, rows)
    assert got[0] == 0 and all(got[n] == 8 for n in range(1, 300))


def test_windows_depend_on_their_lines_only(spark):
    """The fingerprints of a run of weight 2 * GRAM include one that any other place of it has too."""
    rnd = random.Random(3)
    run = [line(rnd, rnd.randint(1, 12)) for _ in range(12)]
    texts = ["\n".join([line(rnd, 9) for _ in range(rnd.randint(0, 5))] + run + [line(rnd, 9) for _ in range(rnd.randint(0, 5))]) for _ in range(20)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    lines = F.split("t", "\n", -1)
    marks = ld.fingerprints(ld.grams(F.transform(lines, lambda x: F.xxhash64(x)), F.transform(lines, ld.line_weight)))
    found = [{g["hash"] for g in r.m} for r in df.select(marks.alias("m")).collect()]
    assert set.intersection(*found)
