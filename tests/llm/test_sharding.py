import hashlib
import zlib
from collections import Counter, defaultdict

from shelfmark.llm import sharding
from tests.llm.odd import documents, odd_rows


def test_odd_documents(spark):
    rows = odd_rows()
    got = sharding.shard_rows(documents(spark, rows), 8).collect()
    again = sharding.shard_rows(documents(spark, rows).repartition(5), 8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_against_sorting(spark):
    rows = [(i, "t", "en", ["a", "a", "a", "b", None][i % 5]) for i in range(533)]
    by_source = defaultdict(list)
    for i, _, _, s in rows:
        by_source["1" if s is None else "0" + s].append((hashlib.md5(str(i).encode()).hexdigest(), i))
    placed = sorted(
        ((2 * r - 1) / (2.0 * len(ids)), key, md5, i)
        for key, ids in by_source.items()
        for r, (md5, i) in enumerate(sorted(ids), start=1)
    )
    want = {i: p * 7 // len(rows) for p, (*_, i) in enumerate(placed)}
    got = sharding.shard_rows(documents(spark, rows), 7).collect()
    assert {r.doc_id: r.shard for r in got} == want
    mix = Counter((r.shard, "ab"[r.doc_id % 5 == 3] if r.doc_id % 5 < 4 else "n") for r in got)
    for source, n in (("a", 320), ("b", 107), ("n", 106)):
        assert all(abs(mix[(s, source)] - n / 7) <= 2 for s in range(7))


def test_few_rows(spark):
    assert sharding.shard_rows(documents(spark, [])).collect() == []
    got = sharding.shard_rows(documents(spark, [(1, "a", "en", "s"), (2, None, None, None)]), 8).collect()
    assert len({r.shard for r in got}) == 2 and {r.slot for r in got} == {0}
