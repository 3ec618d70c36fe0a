import hashlib
import random
import zlib

import pytest

from shelfmark.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, depth string, slab string, n int, id int, p1 string, ids string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2, "z", "w") for r in rows], SCHEMA)


def key(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16], len(text)


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0), *key(role, text)))
    own = {c: [t[1:] for t in sorted(turns)] for c, turns in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        built[c] = tuple(own.get(base, [])[:h]) + tuple(turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        saved[node] = sum(saved[x] for x in below) + (len(members[node]) - 1) * (node[-1][1] if node else 0)
    out = []
    for node, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(of), len(node), parent, len(of), len(children.get(node, [])), leaves[node], saved[node], sha))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def conversations(rnd, n, longest, texts):
    rows = []
    for c in range(n):
        for t in range(rnd.randint(1, longest)):
            rows.append((c * rnd.choice([1, 1, 7]) - 30, t, rnd.choice(["user", "assistant"]), rnd.choice(texts)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("columns, shard, block", [(64, 20_000, 4096), (64, 7, 4096), (2, 5, 2), (3, 20_000, 1)])
def test_equals_brute_force(spark, monkeypatch, columns, shard, block):
    monkeypatch.setattr(ct, "COLUMNS", columns)
    monkeypatch.setattr(ct, "SHARD_ROWS", shard)
    monkeypatch.setattr(ct, "BLOCK_SLABS", block)
    rnd = random.Random(columns * shard)
    rows = conversations(rnd, 120, 12, ["a", "b", "é😀", ""])
    # Copies of one long conversation, and one that goes on after it.
    long = [(rnd.choice(["user", None]), rnd.choice("ab")) for _ in range(14)]
    for c in (1000, 1001, 1002, 1107, 1203, 5005, 5006):
        rows += [(c, t, *turn) for t, turn in enumerate(long[: 14 if c != 1107 else 8])]
    rows += [(5006, 14 + t, "user", "more") for t in range(9)]
    assert found(ct.prefix_trie(table(spark, rows).repartition(6))) == brute(rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ct, "SHARD_ROWS", 4)
    rows = [
        (7, None, "user", "first"), (7, 0, None, None), (7, 0, None, None), (7, 0, "", ""), (7, 5, "user", "x" * 5000),
        (None, 0, "user", "nobody's"), (None, None, None, None), (-5, 1, "a", "b"), (-105, 1, "a", "b"), (-100, 0, "a", "b"),
        (100, 0, "user", "hello"), (101, 0, "user", "hello"), (199, 0, "user", "bye"), (200, 3, "user", "hello"), (3, 0, "r", "1"),
    ]
    assert found(ct.prefix_trie(table(spark, rows))) == brute(rows)


def test_nothing(spark):
    assert found(ct.prefix_trie(table(spark, []))) == []
    assert found(ct.prefix_trie(table(spark, [(None, 1, "a", "b")]))) == []


def test_most_rows_in_one_conversation(spark, monkeypatch):
    """No task gets more than a slab of it at once."""
    monkeypatch.setattr(ct, "COLUMNS", 8)
    monkeypatch.setattr(ct, "BLOCK_SLABS", 4)
    rows = [(3, t, "user", f"{t}") for t in range(400)] + [(c, t, "user", "hi") for c in range(100, 140) for t in range(3)]
    assert found(ct.prefix_trie(table(spark, rows))) == brute(rows)
