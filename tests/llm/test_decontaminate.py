import random
import re

from pyspark.sql import functions as F

from shelfmark.llm import decontaminate as dc
from tests.llm.odd import documents, near_copy, odd_rows, prose


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(w):
    k = min(5, len(w))
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def weight(s):
    return sum(len(x.replace(" ", "")) for x in s)


def brute(rows, items, least=0.8):
    """Best window of each pair over all windows as long as the item."""
    out = {}
    for doc_id, text, *_ in rows:
        w = words(text)
        for item_id, item in items:
            v = words(item)
            if not v or not w:
                continue
            target = shingles(v)
            for start in range(max(len(w) - len(v), 0) + 1):
                window = shingles(w[start : start + len(v)])
                both = weight(window & target)
                like = both / (weight(window) + weight(target) - both)
                if like >= least and like > out.get((doc_id, item_id), (0, 0))[0]:
                    out[(doc_id, item_id)] = (like, start + 1)
    return out


def leaks(docs, bench):
    return {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in dc.find_leaks(docs, bench).collect()}


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, words int, hash string")


def case(seed):
    rnd = random.Random(seed)
    items = [(i, prose(rnd, rnd.randint(8, 60))) for i in range(12)]
    items += [(20, items[0][1]), (21, "tiny item"), (22, None), (23, ""), (24, "?!"), (None, prose(rnd, 30))]
    rows = []
    for n in range(60):
        text = prose(rnd, rnd.randint(0, 150))
        if n % 3 == 0:
            leak = rnd.choice(items[:12])[1]
            leak = near_copy(rnd, leak, rnd.choice([0, 0, 0, 1])) if rnd.random() < 0.7 else leak.upper().replace(" ", " - ")
            text = text + "\n" + leak + " " + prose(rnd, rnd.randint(0, 60))
        rows.append((n, text, "en", "s"))
    rows += [(100, items[3][1], "en", "s"), (101, "Tiny, item!", None, None), (None, items[4][1] + " more", None, None)]
    return rows + odd_rows()[-15:], items


def test_against_all_windows(spark):
    rows, items = case(1)
    got, want = leaks(documents(spark, rows), benchmark(spark, items)), brute(rows, items)
    assert want and got.keys() == want.keys()
    for k, (like, start) in want.items():
        assert abs(got[k][0] - like) < 1e-9 and got[k][1] == start


def test_windows_near_the_threshold(spark):
    """Items of 46 to 110 words with one or two other words: every window that reaches 0.8 is found."""
    rnd = random.Random(9)
    items = [(i, prose(rnd, rnd.randint(46, 110))) for i in range(60)]
    rows = [(100 * k + i, near_copy(rnd, t, rnd.choice([1, 2])), "en", "s") for k in range(3) for i, t in items]
    got, want = leaks(documents(spark, rows), benchmark(spark, items)), brute(rows, items)
    assert got.keys() == want.keys()
    assert sum(v[0] < 0.85 for v in want.values()) > 10


def test_clean_documents_stay(spark):
    rows, items = case(2)
    docs, bench = documents(spark, rows), benchmark(spark, items)
    found = dc.find_leaks(docs, bench)
    kept = dc.without_leaks(docs, found)
    assert kept.schema == docs.schema
    leaking = {d for d, _ in brute(rows, items)}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, *_ in rows if i not in leaking)


def test_blocks_find_all_within_radius(spark):
    """Fingerprints that differ in up to RADIUS bits share a block."""
    rnd = random.Random(3)
    pairs = []
    for _ in range(300):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), rnd.randint(0, dc.RADIUS)):
            b ^= 1 << bit
        pairs.append([x - (1 << 64) if x >> 63 else x for x in (a, b)])
    df = spark.createDataFrame(pairs, "a long, b long")
    shared = F.arrays_overlap(dc._blocks(F.col("a")), dc._blocks(F.col("b")))
    assert df.filter(~shared).count() == 0


def test_simhash(spark):
    df = spark.createDataFrame([(["a b", "c d e"],), (["c d e", "a b"],), (["zzzz"],), ([],)], "s array<string>")
    got = [r.f for r in df.select(dc.simhash(F.col("s")).alias("f")).collect()]
    assert got[0] == got[1] != got[2] and got[3] == 0
    assert got[2] == spark.sql("select xxhash64('zzzz') h").first().h


def test_filter_loses_nothing(spark):
    df = spark.range(3000).select(F.xxhash64("id").alias("hash"))
    table = dc._filter(df, 20)
    assert df.filter(~dc._passes(F.col("hash"), table, 20)).count() == 0
    others = spark.range(5000, 45000).select(F.xxhash64("id").alias("hash"))
    assert others.filter(dc._passes(F.col("hash"), table, 20)).count() < 40


def test_empty_tables(spark):
    rows, items = case(4)
    docs, bench = documents(spark, rows), benchmark(spark, items)
    assert leaks(documents(spark, []), bench) == {}
    assert leaks(docs, benchmark(spark, [])) == {}
    assert leaks(docs, benchmark(spark, [(1, None)])) == {}
    none = dc.find_leaks(docs, benchmark(spark, []))
    assert dc.without_leaks(docs, none).count() == len(rows)
