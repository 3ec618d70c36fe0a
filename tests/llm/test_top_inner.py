import math
import random

import pytest

from shelfmark.llm import top_inner

INF, NAN = float("inf"), float("nan")
SCHEMA = "vec_id long, embedding array<float>, row string, query int, score string, block int, ints int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "y", 2, 3) for i, v in rows], SCHEMA)


def single(x):
    """x as a float of 32 bits."""
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def brute(rows, k, every):
    ok = [(i, [math.floor(256 * single(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i is None or i % every:
            continue
        scores = [(sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(ok) if b != a]
        scores = [(max(-(2**63), min(2**63 - 1, s)), j) for s, j in scores]
        scores.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(i, r + 1, j, s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(params=[(4096, 64), (16, 2)])
def small_blocks(request, monkeypatch):
    monkeypatch.setattr(top_inner, "BLOCK_ROWS", request.param[0])
    monkeypatch.setattr(top_inner, "TILE", request.param[1])
    monkeypatch.setattr(top_inner, "SLICE", 5 if request.param[0] == 16 else 512)


@pytest.mark.parametrize("kind", ["lengths", "unit", "few values", "low rank"])
def test_equals_all_pairs(spark, small_blocks, kind):
    rnd = random.Random(kind)
    base = [[rnd.gauss(0, 1) for _ in range(20)] for _ in range(3)]
    rows = []
    for i in range(400):
        if kind == "low rank":
            w = [rnd.gauss(0, 1) for _ in base]
            v = [sum(a * b[d] for a, b in zip(w, base)) + rnd.gauss(0, 0.02) for d in range(20)]
        elif kind == "few values":
            v = [rnd.choice([-0.01, 0.0, 0.01]) for _ in range(6)]  # ties in score and length
        else:
            v = [rnd.gauss(0, 1) for _ in range(20)]
            n = math.sqrt(sum(x * x for x in v)) if kind == "unit" else rnd.choice([0.1, 1, 30])
            v = [x / n for x in v]
        rows.append((i, v))
    rnd.shuffle(rows)
    got = found(top_inner.top_inner_products(table(spark, rows).repartition(5), k=5, every=10))
    assert got == brute(rows, 5, 10)


def test_odd_vectors(spark, small_blocks):
    rows = [
        (0, [1.0, -2.0]), (10, [1.0, -2.0]), (10, [1.0, -2.0]), (20, [0.0, 0.0]), (1, [0.5]), (2, []), (30, []),
        (3, None), (40, None), (50, [1.0, None]), (4, [NAN, 1.0]), (60, [INF, 1.0]), (5, [-INF]),
        (None, [1.0, -2.0]), (None, [9.0]), (-10, [-0.001, 0.001, 7.0]), (6, [1e-9, -1e-9]), (7, [-1.0, 2.0]),
    ]
    assert found(top_inner.top_inner_products(table(spark, rows), k=5, every=10)) == brute(rows, 5, 10)


def test_large_components(spark, small_blocks):
    rnd = random.Random(4)
    rows = [(i, [rnd.choice([-1, 1]) * 2.0 ** rnd.randint(0, 40) for _ in range(4)]) for i in range(60)]
    assert found(top_inner.top_inner_products(table(spark, rows), k=3, every=7)) == brute(rows, 3, 7)


def test_few_rows(spark):
    assert found(top_inner.top_inner_products(table(spark, []))) == []
    assert found(top_inner.top_inner_products(table(spark, [(1, [1.0])]))) == []
    assert found(top_inner.top_inner_products(table(spark, [(50, [1.0])]))) == []
    two = [(50, [1.0]), (100, [2.0])]
    assert found(top_inner.top_inner_products(table(spark, two))) == brute(two, 5, 50)
