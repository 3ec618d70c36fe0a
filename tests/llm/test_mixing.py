import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import mixing
from shelfmark.llm.common import source_key, with_row_key
from tests.llm.odd import documents, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shares(sizes, weights, repeats):
    """Targets by filling up one source after the other."""
    left, share = dict(sizes), {}
    total = sum(sizes.values())
    while left:
        rate = (total - sum(share.values())) / sum(weights[s] for s in left)
        full = [s for s in left if repeats * sizes[s] <= rate * weights[s]]
        if not full:
            share.update({s: rate * weights[s] for s in left})
            break
        for s in full:
            share[s] = repeats * sizes[s]
            del left[s]
    return share


def check(rows, plan):
    order = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = shares(sizes, weights, 3)
    got = plan.collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    most = defaultdict(int)
    for r in got:
        source = None if r._key == "1" else r._key[1:]
        assert r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source])
        assert len(r.positions) <= 3
        assert all(0 <= p <= 1 for p in r.positions)
        assert r.positions == sorted(r.positions)
        taken[source] += len(r.positions) * r.size
        most[source] = max(most[source], r.size)
    for source in order:
        assert abs(taken[source] - want[source]) <= most[source] / 2 + 1e-6
    return got


def test_odd_documents(spark):
    rows = odd_rows()
    docs = documents(spark, rows)
    first = check(rows, mixing.mix(docs))
    again = check(rows, mixing.mix(docs.repartition(7)))
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_small_sources_are_capped(spark):
    rows = [(i, "a " * 50, "en", "big2") for i in range(60)] + [(100 + i, "b c", "en", "big1") for i in range(5)]
    rows += [(200, "x", None, None), (201, None, None, "empty")]
    got = check(rows, mixing.mix(documents(spark, rows)))
    assert all(len(r.positions) == 3 for r in got if r._key == "0big1")


def test_empty(spark):
    assert mixing.mix(documents(spark, [])).collect() == []
    nothing = documents(spark, [(1, None, None, None), (2, "", None, "s")])
    assert [r.positions for r in mixing.mix(nothing).collect()] == [[], []]


def test_order_is_that_of_md5(spark):
    rows = [(i, "w " * (i % 7 + 1), "en", "s") for i in range(100)]
    got = {r.doc_id: r for r in mixing.mix(documents(spark, rows)).collect()}
    order = sorted(got, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    places = [got[i].positions[0] for i in order if got[i].positions]
    assert places == sorted(places) and len(places) > 95


def test_positions_follow_the_schedule(spark):
    """All weight of "a" in the first half, of "b" in the second, "c" rising from nothing."""
    rows = [(i, "w", "en", "abc"[i % 3]) for i in range(3000)]
    points = {"0a": [(0.0, 2.0), (0.5, 2.0), (0.5000001, 0.0), (1.0, 0.0)], "0b": [(0.0, 0.0), (0.5, 0.0), (0.5000001, 2.0), (1.0, 2.0)], "0c": [(0.0, 0.0), (1.0, 2.0)]}
    table = spark.createDataFrame(list(points.items()), "_key string, points array<struct<t:double,w:double>>")
    plan = mixing.mix(documents(spark, rows), lambda sources: table.join(sources, "_key"))
    by_key = defaultdict(list)
    for r in plan.collect():
        by_key[r._key] += r.positions
    assert max(by_key["0a"]) <= 0.5001 and min(by_key["0b"]) >= 0.4999
    c = sorted(by_key["0c"])
    for q in (0.1, 0.5, 0.9):  # the integral of the weight is t ** 2
        assert c[int(q * len(c))] == pytest.approx(q**0.5, abs=0.01)


def test_training_order(spark):
    rows = odd_rows()
    docs, key = with_row_key(documents(spark, rows).withColumn("training_position", F.lit("old")))
    plan = mixing.mix(docs, key=key)
    out = mixing.training_order(docs, plan, key)
    assert out.columns == [c for c in docs.columns if c not in ("training_position", key)] + ["training_position"]
    got = out.collect()
    places = [r.training_position for r in got]
    assert places == sorted(places)
    want = sorted((p, str(r.doc_id), r._key) for r in plan.collect() for p in r.positions)
    assert sorted((r.training_position, str(r.doc_id), "1" if r.source is None else "0" + r.source) for r in got) == want
    assert {(r.doc_id, r.text) for r in got} <= {(i, t) for i, t, *_ in rows}
    counted = mixing.training_places(plan, key).collect()
    numbers = sorted(n for r in counted for n in {r.first_place, r.last_place} if n is not None)
    assert numbers[0] == 1 and numbers[-1] == len(got)
    assert all((r.first_place is None) == (not r.positions) for r in counted)
    order = sorted((r.positions[0], r.first_place) for r in counted if r.positions)
    assert [n for _, n in order] == sorted(n for _, n in order)


def test_one_id_for_most_rows(spark):
    """Rows of one doc_id, most of them alike, are not one task's: their places differ all the same."""
    rows = [(7, "same words here", "en", "s")] * 300 + [(None, "x y", "en", "s")] * 200 + [(i, "a b c", "en", "t") for i in range(20)]
    got = check(rows, mixing.mix(documents(spark, rows)))
    assert len({p for r in got if r.doc_id == 7 for p in r.positions}) >= 300


def test_row_keys(spark):
    docs, key = with_row_key(documents(spark, odd_rows()).withColumn("_row_key", F.lit("taken")))
    assert key != "_row_key"
    first = {(r[key], r.doc_id, r.text) for r in docs.collect()}
    assert len({k for k, *_ in first}) == len(odd_rows())
    assert first == {(r[key], r.doc_id, r.text) for r in docs.repartition(3).collect()}
    assert with_row_key(documents(spark, []))[0].collect() == []


def test_source_key_order(spark):
    names = ["", "a", "ä", "😀", "￿", None, "0", "1"]
    df = spark.createDataFrame([(n,) for n in names], "source string").orderBy(source_key(F.col("source")))
    assert [r.source for r in df.collect()] == sorted((n for n in names if n is not None)) + [None]
