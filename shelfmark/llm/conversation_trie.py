"""Prefix trie of conversations, from padded matrices of turn ids.

A turn's id is 128 bits of the SHA-256 of its role and text. Conversations are rows of
turn ids, cut into slabs of COLUMNS turns; a slab also has an identity of all that comes
before it. The rows are range-partitioned by (slab, what comes before, ids, conv_id) into
shards. In a shard (``_shard_nodes``) the ids are a matrix, shorter rows padded with
zeros: numpy's lexsort puts equal beginnings together, a mask says where a column
differs from the row above, and the masks or-ed from left to right mark where a node of
each depth starts. reduceat then aggregates every depth.

Nodes on the path of a shard's first or last row may go on in the next shard. They carry
an identity (a hash of slab, what comes before, and ids) and are recombined by it; all
others are done within their shard. What slabs further right add to a node's subtree is
brought to its rows beforehand, one number for each row: each node counts with its
smallest member, and a conversation's later slabs are summed up from the right.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.numbering import number_rows
from shelfmark.functions.skew import attach_groups
from shelfmark.llm.common import arrow_rows
from shelfmark.session import materialize

# Turns in a slab, rows in a shard.
COLUMNS, SHARD_ROWS = 64, 20_000
# Slabs of a conversation that one window goes over.
BLOCK_SLABS = 4_096
# Conversations that share beginnings, and how many turns they may share.
FAMILY, SHARED = 100, 6
NO_ENDS = hashlib.sha256(b"").hexdigest()
# Rows of joined conv_ids that a task holds at once.
ENDS_ROWS = 50


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their family.

    The first result has conv_id, pos (from 1), id (16 bytes), chars (code points of the text);
    the second conv_id and n, the number of its rebuilt turns, possibly 0.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.char_length(role), F.lit(":"), role, text)
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.substring(F.unhex(F.sha2(whole, 256)), 1, 16).alias("id"),
        F.char_length(text).cast("long").alias("chars"),
    )
    ranked = number_rows(rows, ["turn", "id"], group_by=["conv_id"], name="rank")
    ranked = materialize(ranked.select("conv_id", "rank", "id", "chars"), "ranked")
    is_head = (F.col("conv_id") % FAMILY == 0) & (F.col("rank") < SHARED)
    heads = ranked.filter(is_head).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "id", "chars"))).alias("head")  # fewer than SHARED
    )
    heads = heads.select(F.col("conv_id").alias("_base"), "head")
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    convs = ranked.groupBy("conv_id").agg(F.count("*").alias("n_files")).withColumn("h", shared)
    convs = convs.join(heads, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("_base"), "left")
    first = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<struct<rank:bigint,id:binary,chars:bigint>>"))
    convs = materialize(convs.select("conv_id", "n_files", "h", first.alias("first")), "conversations")
    taken = convs.select("conv_id", F.explode("first").alias("t")).select("conv_id", F.col("t.rank").alias("pos"), "t.id", "t.chars")
    small = convs.select("conv_id", "n_files", "h", F.size("first").alias("k"))
    own = attach_groups(ranked, small, ["conv_id"], spread_by="rank").filter(F.col("rank") > F.col("h"))
    own = own.select("conv_id", (F.col("rank") - F.col("h") + F.col("k")).alias("pos"), "id", "chars")
    n = (F.col("k") + F.greatest(F.col("n_files") - F.col("h"), F.lit(0))).cast("long")
    return taken.unionByName(own), small.select("conv_id", n.alias("n"))


def _slabs(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, slab, ids (concatenated), chars: rows of at most COLUMNS turns, one for a conversation without turns."""
    slab = F.floor((F.col("pos") - 1) / COLUMNS).cast("int")
    turn = F.array_sort(F.collect_list(F.struct("pos", "id", "chars")))
    rows = turns.groupBy("conv_id", slab.alias("slab")).agg(turn.alias("t"))
    joined = F.aggregate("t", F.lit(b""), lambda all_, t: F.concat(all_, t["id"]))
    rows = rows.select("conv_id", "slab", joined.alias("ids"), F.transform("t", lambda t: t["chars"]).alias("chars"))
    none = convs.filter("n = 0").select(
        "conv_id", F.lit(0).alias("slab"), F.lit(b"").alias("ids"), F.array().cast("array<bigint>").alias("chars")
    )
    return rows.unionByName(none)


def _running(rows: DataFrame, columns: dict[str, str], total, *, later: bool) -> DataFrame:
    """For each (conv_id, slab), ``total`` of columns over the conversation's slabs before it, or after it.

    In two steps, over blocks of slabs and within a block, so that no window is long.
    """
    rows = rows.withColumn("_block", F.floor(F.col("slab") / BLOCK_SLABS))
    order = (lambda c: F.desc(c)) if later else (lambda c: F.asc(c))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "_block").agg(*[total(c).alias(c) for c in columns])
    outer = up_to(Window.partitionBy("conv_id").orderBy(order("_block")))
    sums = sums.select("conv_id", "_block", *[F.coalesce(total(c).over(outer), F.lit(0)).alias(f"_{c}") for c in columns])
    inner = up_to(Window.partitionBy("conv_id", "_block").orderBy(order("slab")))
    found = rows.withColumns({f"_in_{c}": F.coalesce(total(c).over(inner), F.lit(0)) for c in columns})
    both = found.join(sums, ["conv_id", "_block"])
    return both.select("conv_id", "slab", *[F.struct(f"_{c}", f"_in_{c}").alias(name) for c, name in columns.items()])


def _chained(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Adds to slabs what comes before (p1, p2), is_last, parent_conv, kids.

    What comes before is an exclusive or of hashes of (slab, its ids). parent_conv is the
    smallest member of the node a slab begins at, kids the number of children of the node it
    ends at in the next slab. Conversations of one slab need none of it.
    """
    rows = rows.join(convs.filter(F.col("n") > COLUMNS).select("conv_id", "n"), "conv_id", "left")
    rows = rows.withColumn("last_slab", F.coalesce(F.floor((F.col("n") - 1) / COLUMNS), F.lit(0)).cast("int")).drop("n")
    nothing = F.lit(0).cast("long")
    plain = rows.filter("last_slab = 0").select(
        "conv_id", "slab", "ids", "chars", nothing.alias("p1"), nothing.alias("p2"), F.lit(True).alias("is_last"),
        F.lit(None).cast("long").alias("parent_conv"), nothing.alias("kids"),
    )
    long = materialize(
        rows.filter("last_slab > 0").withColumns(
            {"s1": F.xxhash64("slab", "ids"), "s2": F.xxhash64("ids", F.lit("second"), "slab")}
        ),
        "long",
    )
    before = _running(long.select("conv_id", "slab", "s1", "s2"), {"s1": "b1", "s2": "b2"}, F.bit_xor, later=False)
    p = {f"p{i}": F.col(f"b{i}._s{i}").bitwiseXOR(F.col(f"b{i}._in_s{i}")) for i in (1, 2)}
    long = long.join(before, ["conv_id", "slab"]).withColumns(p)
    long = long.withColumns({f"q{i}": F.col(f"p{i}").bitwiseXOR(F.col(f"s{i}")) for i in (1, 2)})
    long = materialize(long.drop("s1", "s2", "b1", "b2"), "chained")
    at = ["slab", "p1", "p2"]
    # The nodes where a slab ends and the next begins, whoever passes them or ends there: full slabs
    # of any conversation, with as many turns as COLUMNS or more.
    short = plain.filter(F.octet_length("ids") == 16 * COLUMNS).select(
        "conv_id", F.lit(1).alias("slab"), F.xxhash64("slab", "ids").alias("p1"), F.xxhash64("ids", F.lit("second"), "slab").alias("p2")
    )
    ends = long.filter(F.octet_length("ids") == 16 * COLUMNS)
    ends = ends.select("conv_id", (F.col("slab") + 1).alias("slab"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    least = ends.unionByName(short).groupBy(*at).agg(F.min("conv_id").alias("parent_conv"))
    firsts = long.filter("slab > 0").groupBy(*at, F.substring("ids", 1, 16).alias("first")).agg(F.count("*").alias("c"))
    facts = firsts.groupBy(*at).agg(F.count("*").alias("kids"), F.sum("c").alias("n_files")).join(least, at)
    facts = materialize(facts, "slab-starts")
    starting = attach_groups(long, facts.drop("kids"), at, spread_by="conv_id").drop("n_files")
    going_on = facts.select((F.col("slab") - 1).alias("slab"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), "kids", "n_files")
    whole = attach_groups(starting, going_on, ["slab", "q1", "q2"], spread_by="conv_id").withColumn(
        "is_last", F.col("slab") == F.col("last_slab")
    )
    whole = whole.withColumn("kids", F.coalesce("kids", F.lit(0)))
    return plain.unionByName(whole.select(*plain.columns))


NODES = pa.schema(
    [
        ("shard", pa.int32()),
        ("nid", pa.binary()),  # of nodes that may go on in other shards
        ("parent_nid", pa.binary()),  # if the parent may
        *[(name, pa.int64()) for name in ("slab", "depth", "conv_id", "parent_conv", "n_convs", "n_children", "kids")],
        *[(name, pa.int64()) for name in ("n_leaves", "saved", "chars")],
        ("ends", pa.string()),  # of nodes with nid: conv_ids; of others: their hash
        ("ancestors", pa.list_(pa.binary())),
    ]
)
NODE_COLUMNS = (
    "shard int, nid binary, parent_nid binary, slab long, depth long, conv_id long, parent_conv long, n_convs long, "
    "n_children long, kids long, n_leaves long, saved long, chars long, ends string, ancestors array<binary>"
)


def _read(group: pa.Table) -> dict[str, np.ndarray]:
    """Columns of a shard in lexicographic order of slab, what comes before, ids, conv_id."""
    column = lambda name: group.column(name).combine_chunks()
    blobs = group.column("ids").to_pylist()
    n = np.array([len(b) // 16 for b in blobs], np.int64)
    width = int(n.max())
    ids = np.zeros((len(n), width, 2), np.uint64)
    chars = np.zeros((len(n), width), np.int64)
    inside = np.arange(width) < n[:, None]
    ids[inside] = np.frombuffer(b"".join(blobs), ">u8").astype(np.uint64).reshape(-1, 2)
    lists = column("chars")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    chars[inside] = lists.flatten().to_numpy(zero_copy_only=False)
    plain = {c: group.column(c).to_numpy() for c in ("conv_id", "slab", "p1", "p2", "is_last", "kids", "t_saved", "t_leaves")}
    plain["parent_conv"] = group.column("parent_conv").fill_null(0).to_numpy()
    keys = [plain["conv_id"]]
    for j in range(width - 1, -1, -1):
        keys += [ids[:, j, 1], ids[:, j, 0]]
    order = np.lexsort([*keys, plain["p2"], plain["p1"], plain["slab"]])
    return {k: v[order] for k, v in (plain | {"n": n, "ids": ids, "chars": chars}).items()}


def _shard_nodes(group: pa.Table) -> pa.Table:
    rows = _read(group)
    m, width = len(rows["n"]), rows["ids"].shape[1]
    n, slab, conv = rows["n"], rows["slab"].astype(np.int64), rows["conv_id"]
    # A column differs from the row above, or one left of it does: a node of that depth starts.
    differs = np.ones((m, width + 1), bool)
    differs[1:, 0] = (slab[1:] != slab[:-1]) | (rows["p1"][1:] != rows["p1"][:-1]) | (rows["p2"][1:] != rows["p2"][:-1])
    differs[1:, 1:] = (rows["ids"][1:] != rows["ids"][:-1]).any(axis=2)
    starts_at = np.logical_or.accumulate(differs, axis=1)
    there = n[:, None] >= np.arange(width + 1)
    there[:, 0] &= slab == 0  # other slabs begin at a node of the slab before

    starts = [np.flatnonzero(starts_at[:, j]) for j in range(width + 1)]
    ends = [np.append(s[1:], m) for s in starts]
    open_ = [(s == 0) | (e == m) for s, e in zip(starts, ends)]
    saved, leaves = np.zeros((m, width + 1), np.int64), np.zeros((m, width + 1), np.int64)
    parts = []
    for j in range(width + 1):
        s = starts[j]
        child_starts = np.zeros(m, np.int64)
        if j < width:
            done = starts[j + 1][~open_[j + 1]]
            child_starts[done] = there[done, j + 1]
        chars = rows["chars"][s, j - 1] if j else np.zeros(len(s), np.int64)
        node = {
            "n_convs": ends[j] - s,
            "conv_id": np.minimum.reduceat(conv, s),
            "n_children": np.add.reduceat(child_starts, s),
            "kids": np.maximum.reduceat(rows["kids"], s) if j == COLUMNS else np.zeros(len(s), np.int64),
            "chars": chars,
        }
        closed = there[s, j] & ~open_[j]
        saved[s[closed], j] = ((node["n_convs"] - 1) * chars)[closed]
        leaves[s[closed], j] = (node["n_children"] + node["kids"] == 0)[closed]
        parts.append(node)
    # Of each row, what its columns from here on and later slabs add to the subtrees it is in.
    saved = np.cumsum(saved[:, ::-1], axis=1)[:, ::-1] + rows["t_saved"][:, None]
    leaves = np.cumsum(leaves[:, ::-1], axis=1)[:, ::-1] + rows["t_leaves"][:, None]

    paths = {row: _path(rows, row) for row in {0, m - 1}}
    out = []
    for j in range(width + 1):
        s, node = starts[j], parts[j]
        node |= {"saved": np.add.reduceat(saved[:, j], s), "n_leaves": np.add.reduceat(leaves[:, j], s)}
        own = np.flatnonzero(there[s, j])
        ended = np.flatnonzero((n == j) & rows["is_last"])
        texts = _ends(conv[ended], np.searchsorted(s, ended, side="right") - 1)
        if j:
            above = np.searchsorted(starts[j - 1], s, side="right") - 1
            in_slab = there[s, j - 1]
            parent = np.where(in_slab, parts[j - 1]["conv_id"][above], rows["parent_conv"][s])
            parent_open = in_slab & open_[j - 1][above]
        else:
            parent, parent_open = np.zeros(len(s), np.int64), np.ones(len(s), bool)
        # Of a node on the path of both the first and the last row, either path will do.
        path = [paths[0 if s[i] == 0 else m - 1] if open_[j][i] else None for i in own.tolist()]
        above_path = [(paths[0 if starts[j - 1][above[i]] == 0 else m - 1] if parent_open[i] else None) if j else None for i in own.tolist()]
        base = [int(slab[s[i]] > 0) for i in own.tolist()]  # the first depth of the slab
        columns = {
            "nid": [p[j] if p else None for p in path],
            "parent_nid": [p[j - 1] if p else None for p in above_path],
            "depth": slab[s[own]] * COLUMNS + j,
            "parent_conv": pa.array(parent[own], mask=parent_open[own]),
            "slab": slab[s[own]],
            "ends": [
                texts.get(i) if p else hashlib.sha256(texts.get(i, "").encode()).hexdigest() if i in texts else NO_ENDS
                for i, p in zip(own.tolist(), path)
            ],
            "ancestors": [p[b:j] if p else None for p, b in zip(path, base)],
        }
        columns |= {name: values[own] for name, values in node.items()}
        shard = np.full(len(own), group.column("shard")[0].as_py(), np.int32)
        out.append(pa.Table.from_arrays([pa.array(columns[f.name] if f.name != "shard" else shard, f.type) for f in NODES], schema=NODES))
    return pa.concat_tables(out)


def _path(rows: dict[str, np.ndarray], row: int) -> list[bytes]:
    """Identities of the nodes on a row's path, by depth in the slab."""
    start = np.array([rows["slab"][row], rows["p1"][row], rows["p2"][row]], np.int64).tobytes()
    ids = rows["ids"][row].tobytes()
    return [xxhash.xxh3_128_digest(start + ids[: 16 * j]) for j in range(rows["ids"].shape[1] + 1)]


def _ends(conv_ids: np.ndarray, segment: np.ndarray) -> dict[int, str]:
    """conv_ids of each segment, joined; they come in order."""
    cuts = np.flatnonzero(np.diff(segment)) + 1
    names = list(map(str, conv_ids.tolist()))
    bounds = [0, *cuts.tolist(), len(names)]
    return {int(segment[i]): ",".join(names[i:k]) for i, k in zip(bounds, bounds[1:]) if k > i}


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the conv_ids of each node, piece after piece in the order of shards."""
    now, state = None, None
    for batch in batches:
        done = []
        for nid, ends in zip(batch.column("nid").to_pylist(), batch.column("ends").to_pylist()):
            if nid != now:
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = nid, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        if done:
            yield pa.RecordBatch.from_pydict({"nid": pa.array([d[0] for d in done], pa.binary()), "sha": [d[1] for d in done]})
    if now is not None:
        yield pa.RecordBatch.from_pydict({"nid": pa.array([now], pa.binary()), "sha": [state.hexdigest()]})


def _nodes(rows: DataFrame) -> DataFrame:
    """All nodes of the slabs: slab, depth, conv_id, parent_conv, n_convs, n_children, n_leaves, saved, ends, chars."""
    spark = rows.sparkSession
    order = ["slab", "p1", "p2", "ids", "conv_id"]
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    ranged = rows.repartitionByRange(shards, *order).withColumn("shard", F.spark_partition_id())
    ranged = materialize(ranged, "shards")
    nodes = materialize(ranged.groupBy("shard").applyInArrow(_shard_nodes, NODE_COLUMNS), "nodes")

    pieces = nodes.filter("nid is not null")
    whole = pieces.groupBy("nid").agg(
        *[F.first(c).alias(c) for c in ("slab", "depth", "parent_nid", "chars", "ancestors")],
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
        *[F.max(c).alias(c) for c in ("kids", "parent_conv")],
        F.min("conv_id").alias("conv_id"),
    )
    whole = materialize(whole, "open-nodes")
    children = whole.filter("parent_nid is not null").groupBy(F.col("parent_nid").alias("_of")).agg(F.count("*").alias("_more"))
    whole = whole.join(children, F.col("nid") == F.col("_of"), "left")
    n_children = F.col("n_children") + F.col("kids") + F.coalesce("_more", F.lit(0))
    whole = whole.withColumn("n_children", n_children).withColumns(
        {
            "own_saved": (F.col("n_convs") - 1) * F.col("chars"),
            "own_leaf": (F.col("n_children") == 0).cast("long"),
        }
    )
    whole = materialize(whole.drop("_of", "_more"), "open-nodes")
    below = whole.select(F.explode("ancestors").alias("_above"), "own_saved", "own_leaf")
    below = below.groupBy("_above").agg(F.sum("own_saved").alias("_saved"), F.sum("own_leaf").alias("_leaves"))
    with arrow_rows(spark, ENDS_ROWS):
        sorted_ends = pieces.filter("ends is not null").select("nid", "shard", "ends").repartition("nid").sortWithinPartitions("nid", "shard")
        ends = materialize(sorted_ends.mapInArrow(_hashed_ends, "nid binary, sha string"), "ends")
    parents = whole.select(F.col("nid").alias("_parent"), F.col("conv_id").alias("_parent_conv"))
    complete = (
        whole.join(below, F.col("nid") == F.col("_above"), "left")
        .join(ends.withColumnRenamed("nid", "_ended"), F.col("nid") == F.col("_ended"), "left")
        .join(parents, F.col("parent_nid") == F.col("_parent"), "left")
        .select(
            "slab",
            "depth",
            "conv_id",
            F.coalesce("_parent_conv", "parent_conv").alias("parent_conv"),
            "n_convs",
            "n_children",
            (F.col("n_leaves") + F.col("own_leaf") + F.coalesce("_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved") + F.col("own_saved") + F.coalesce("_saved", F.lit(0))).alias("saved"),
            F.coalesce("sha", F.lit(NO_ENDS)).alias("ends"),
            "chars",
        )
    )
    # Within a shard few nodes have a parent that goes on elsewhere, and a key never leaves its shard.
    known = pieces.select(F.col("shard").alias("_shard"), "nid").join(parents, F.col("nid") == F.col("_parent"))
    known = known.select("_shard", F.col("nid").alias("_nid"), "_parent_conv")
    closed = nodes.filter("nid is null").join(
        known, (F.col("shard") == F.col("_shard")) & (F.col("parent_nid") == F.col("_nid")), "left"
    )
    closed = closed.select(
        *["slab", "depth", "conv_id", F.coalesce("_parent_conv", "parent_conv").alias("parent_conv")],
        *["n_convs", (F.col("n_children") + F.col("kids")).alias("n_children"), "n_leaves", "saved", "ends", "chars"],
    )
    return complete.unionByName(closed)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Nodes of the trie of rebuilt conversations, one row each.

    ``turns`` has conv_id, turn, role, text; other columns are not read. Turns are ordered by
    turn, null first, then by the hash of role and text; null roles and texts are empty.
    Every conversation c begins with the first h turns of conversation c - c % 100 (if there
    is one; all if it has fewer), h being the checksum of c modulo 6, and goes on with its
    own turns after its first h. Returns conv_id (smallest member), depth, parent_conv_id
    (null for the root), n_convs (members), n_children, n_leaves, saved_tokens, ends_sha256.
    Repeated rows are turns of their own. Rows without conv_id are of no conversation. A
    conversation may be left without turns: it ends at the root. An empty table gives no rows.
    """
    rebuilt, convs = rebuilt_turns(turns)
    rebuilt, convs = materialize(rebuilt, "turns"), materialize(convs, "lengths")
    rows = materialize(_chained(_slabs(rebuilt, convs), convs), "slabs")
    none = F.lit(0).cast("long")
    deep = rows.filter("slab > 0").withColumns({"t_saved": none, "t_leaves": none})
    if not deep.isEmpty():
        found = _nodes(deep).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars"))
        by_slab = found.groupBy("conv_id", F.col("slab").cast("int").alias("slab")).agg(
            F.sum("saved").alias("s"), F.sum((F.col("n_children") == 0).cast("long")).alias("l")
        )
        # A conversation's slabs that are nobody's smallest member add nothing, but need a row.
        sizes = rows.join(rows.filter("slab > 0").select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "slab")
        by_slab = sizes.join(by_slab, ["conv_id", "slab"], "left").na.fill(0, ["s", "l"])
        later = _running(by_slab, {"s": "t1", "l": "t2"}, F.sum, later=True)
        later = later.select(
            "conv_id", "slab", (F.col("t1._s") + F.col("t1._in_s")).alias("t_saved"), (F.col("t2._l") + F.col("t2._in_l")).alias("t_leaves")
        )
        rows = rows.join(later, ["conv_id", "slab"], "left").na.fill(0, ["t_saved", "t_leaves"])
    else:
        rows = rows.withColumns({"t_saved": none, "t_leaves": none})
    return _nodes(rows).select(
        "conv_id",
        "depth",
        F.col("parent_conv").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    )
