"""N-gram Jaccard join over word shingles, exact, with token-combination prefixes.

Token order: rare tokens first, then frequent ones; by hash within a class. Any
fixed order is right, this one keeps tokens that many documents share out of the
prefixes. With ``o`` the least overlap a set of size ``n`` needs:

* Rare class, single tokens: a prefix is extended to ``n - o + MATCHES`` tokens, so
  linked sets share at least ``MATCHES`` of them unless the prefixes end in frequent
  tokens. Pairs that share fewer are dropped before any text is compared.
* Frequent class, 2-token combinations: sets whose prefix runs into frequent tokens.
  If linked sets differ in at most ``u`` tokens, the first ``2u + 2`` tokens of their
  union hold two neighbours that both sets share. So neighbours in the order, over
  a prefix of ``2u + 2`` tokens, are all the combinations that need an index: their
  number is linear in the set, not quadratic.

Candidates form clusters; each document goes to its cluster once (large clusters are
cut into blocks) and all sets of a block pair are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.skew import attach_groups
from shelfmark.llm.common import WordHashes, arrow_bytes, as_bytes, chained, components, in_batches, mixed, shingle_set
from shelfmark.session import materialize

# Tokens in at least this many sets can be frequent; of those at most FREQUENT, the
# most frequent ones, are sent to the tasks (8 bytes each).
LEAST_FREQUENT = 8
FREQUENT = 1 << 19
# Copy groups whose copies are skipped while indexing, the largest ones (16 bytes each).
# Copies of other groups are indexed and then found to be the same set.
COPY_GROUPS = 1 << 18
MATCHES = 3
# Tokens counted or indexed in a task before it passes them on.
FLUSH = 1_000_000
# Tokens and sets of a block of a cluster.
BLOCK_TOKENS = 500_000
BLOCK_SETS = 512
COLUMNS = 2_048
# Classes of signatures: rare single tokens, combinations of two tokens.
RARE, COMBINED = 0, 1


def _node(tokens: np.ndarray) -> int:
    """Identity of a set: 63 bits of the hash of its sorted tokens."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) >> 1


def _planes(values: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, which shuffle compression likes."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _least_overlap(n: int, num: int, den: int) -> int:
    return -(-n * num // den)


def _set_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, words, hashes) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_node(s) if len(s) else None for s in sets], pa.int64()),
                ],
                names=["doc_id", "n_shingles", "node"],
            )

    return run


class _Copies:
    """Documents that repeat a set another document stands for."""

    def __init__(self, packed: tuple[np.ndarray, np.ndarray]):
        self.nodes, self.reps = packed

    def skip(self, doc_id: int, node: int) -> bool:
        i = np.searchsorted(self.nodes, node)
        return i < len(self.nodes) and self.nodes[i] == node and self.reps[i] != doc_id


def _indexed_sets(batches, words: int, copies) -> Iterator[tuple[int, np.ndarray]]:
    hashes, known = WordHashes(), _Copies(copies.value)
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
            tokens = shingle_set(text, words, hashes)
            if len(tokens) > 2:
                node = _node(tokens)
                if not known.skip(doc_id, node):
                    yield node, tokens


def _token_counts(words: int, bits: int, copies):
    """Counts of 32 + bits bit fingerprints, dealt by their leading bits."""

    def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
        prints, counts = np.unique(np.concatenate(parts), return_counts=True)
        bucket = prints >> np.uint64(32)
        starts = np.flatnonzero(np.diff(bucket, prepend=np.uint64(1 << 63)))
        ends = [*starts[1:], len(prints)]
        low, counts = prints.astype(np.uint32), counts.astype(np.uint32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[starts].astype(np.int64)),
                pa.array(
                    [_planes(np.diff(low[i:j], prepend=np.uint32(0))) for i, j in zip(starts, ends)],
                    pa.binary(),
                ),
                pa.array([_planes(counts[i:j]) for i, j in zip(starts, ends)], pa.binary()),
            ],
            names=["bucket", "prints", "counts"],
        )

    def run(batches):
        parts, size = [], 0
        for _, tokens in _indexed_sets(batches, words, copies):
            parts.append(tokens >> np.uint64(32 - bits))
            size += len(tokens)
            if size >= 2 * FLUSH:
                counted = packed(parts)
                parts, size = [], 0
                yield from in_batches(counted)
        if parts:
            yield from in_batches(packed(parts))

    return run


def _frequent_prints(least: int):
    def run(group: pa.Table) -> pa.Table:
        prints = [
            np.cumsum(_from_planes(x, np.uint32), dtype=np.uint32)
            for x in group.column("prints").to_pylist()
        ]
        counts = [_from_planes(x, np.uint32) for x in group.column("counts").to_pylist()]
        prints, counts = np.concatenate(prints), np.concatenate(counts).astype(np.int64)
        low, place = np.unique(prints, return_inverse=True)
        total = np.bincount(place, counts, len(low)).astype(np.int64)
        often = total >= least
        high = np.int64(group.column("bucket")[0].as_py()) << 32
        return pa.table({"print": high + low[often].astype(np.int64), "df": total[often]})

    return run


def _signatures(words: int, num: int, den: int, bits: int, frequent, copies):
    """Index entries (class, signature, set, size), dealt by class and leading bits of the signature."""

    def packed(parts: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
        counts = [len(sigs) for *_, sigs in parts]
        kinds, nodes, sizes = (
            np.repeat(np.array(x, np.int64), counts) for x in list(zip(*parts))[:3]
        )
        sigs = np.concatenate([sigs for *_, sigs in parts])
        bucket = (sigs >> np.uint64(64 - bits)).astype(np.int64) * 2 + kinds
        order = np.lexsort((sigs, bucket))
        bucket = bucket[order]
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = [*starts[1:], len(bucket)]
        blobs = [
            pa.array([_planes(x[order[i:j]]) for i, j in zip(starts, ends)], pa.binary())
            for x in (sigs, nodes, sizes.astype(np.uint32))
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[starts]), *blobs], names=["bucket", "sigs", "nodes", "sizes"]
        )

    def run(batches):
        often = frequent.value
        parts, held = [], 0
        for node, tokens in _indexed_sets(batches, words, copies):
            n = len(tokens)
            is_often = np.zeros(n, bool)
            if len(often):
                prints = (tokens >> np.uint64(32 - bits)).astype(np.int64)
                place = np.minimum(np.searchsorted(often, prints), len(often) - 1)
                is_often = often[place] == prints
            rare = tokens[~is_often]
            prefix = n - _least_overlap(n, num, den) + MATCHES
            parts.append((RARE, node, n, rare[:prefix].copy()))  # a view would hold the whole set
            held += len(parts[-1][3])
            if len(rare) < prefix:
                most_apart = (den - num) * n // num
                first = np.concatenate([rare, tokens[is_often]])[: 2 * most_apart + 2]
                parts.append((COMBINED, node, n, mixed(chained(first[:-1], first[1:]))))
                held += len(parts[-1][3])
            if held >= FLUSH:
                entries = packed(parts)
                parts, held = [], 0
                yield from in_batches(entries)
        if held:
            yield from in_batches(packed(parts))

    return run


def _candidates(num: int, den: int):
    """Pairs of sets with a common signature and the number of common signatures.

    A rare token is in fewer sets than a frequent one, so its pairs are few; the
    sets of a combination are tied to the first of them only.
    """

    def run(group: pa.Table) -> pa.Table:
        read = lambda name, kind: np.concatenate(
            [_from_planes(x, kind) for x in group.column(name).to_pylist()]
        )
        sigs, nodes, sizes = read("sigs", np.uint64), read("nodes", np.int64), read("sizes", np.uint32)
        order = np.lexsort((nodes, sigs))
        sigs, nodes, sizes = sigs[order], nodes[order], sizes[order].astype(np.int64)
        new_sig = np.diff(sigs, prepend=~sigs[:1]) != 0
        keep = new_sig | (np.diff(nodes, prepend=-1) != 0)
        sigs, nodes, sizes, new_sig = sigs[keep], nodes[keep], sizes[keep], new_sig[keep]
        if group.column("bucket")[0].as_py() % 2 == COMBINED:
            first = nodes[np.maximum.accumulate(np.where(new_sig, np.arange(len(sigs)), 0))]
            a, b = first[~new_sig], nodes[~new_sig]
            pairs = np.unique(np.stack([a, b]), axis=1)
            counts = np.full(pairs.shape[1], MATCHES)
        else:
            found, step = [], 1
            while step < len(sigs) and (same := np.flatnonzero(sigs[step:] == sigs[:-step])).size:
                low = np.minimum(sizes[same], sizes[same + step])
                high = np.maximum(sizes[same], sizes[same + step])
                same = same[den * low >= num * high]
                found.append(np.stack([nodes[same], nodes[same + step]]))
                step += 1
            found = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
            pairs, counts = np.unique(found, axis=1, return_counts=True)
        return pa.table({"a": pairs[0], "b": pairs[1], "shared": counts.astype(np.int64)})

    return run


def _token_rows(words: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, words, hashes) for t in as_bytes(batch.column("text"))]
            nodes = batch.column("node").to_pylist()
            right = np.flatnonzero([len(s) > 0 and _node(s) == x for s, x in zip(sets, nodes)])
            kept = batch.select(["cluster", "node", "blocks"]).take(pa.array(right))
            tokens = pa.array([sets[i].tobytes() for i in right], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, tokens], names=["cluster", "node", "blocks", "tokens"]
            )

    return run


def _shared_counts(owner: np.ndarray, place: np.ndarray, n_sets: int, n_tokens: int) -> np.ndarray:
    """Intersection sizes of all sets, from the incidence matrix slab by slab of columns."""
    shared = np.zeros((n_sets, n_sets), np.float32)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for start in range(0, n_tokens, COLUMNS):
        i, j = np.searchsorted(place, [start, start + COLUMNS])
        slab = np.zeros((n_sets, min(COLUMNS, n_tokens - start)), np.float32)
        slab[owner[i:j], place[i:j] - start] = 1
        shared += slab @ slab.T
    return shared


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links connect, by breadth-first search."""
    edges, left = [], np.ones(len(links), bool)
    for root in range(len(links)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            i = queue.pop()
            reached = np.flatnonzero(links[i] & left)
            left[reached] = False
            queue += reached.tolist()
            edges += [(i, int(j)) for j in reached]
    return edges


def _verified(num: int, den: int):
    """Links of a block (or block pair), reduced to those that keep it connected."""

    def run(group: pa.Table) -> pa.Table:
        nodes, first = np.unique(group.column("node").to_numpy(), return_index=True)
        blobs = group.column("tokens").to_pylist()
        sets = [np.frombuffer(blobs[i], np.uint64) for i in first]
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        tokens, place, counts = np.unique(
            np.concatenate(sets), return_inverse=True, return_counts=True
        )
        column = np.cumsum(counts > 1) - 1
        several = counts[place] > 1
        shared = _shared_counts(
            owner[several], column[place[several]], len(sets), int((counts > 1).sum())
        ).astype(np.int64)
        links = den * shared >= num * (sizes[:, None] + sizes[None, :] - shared)
        np.fill_diagonal(links, False)
        edges = np.array(_forest(links), np.int64).reshape(-1, 2)
        return pa.table({"a": nodes[edges[:, 0]], "b": nodes[edges[:, 1]]})

    return run


def _bounded(df: DataFrame, level: str, values: list[str], bound: int) -> list:
    """Rows of the highest levels, at most ``bound`` of them: ties of the last level stay out."""
    scale = F.floor(F.log2(F.col(level)) * 16).cast("int")
    levels = df.groupBy(scale.alias("level")).count().orderBy(F.desc("level")).collect()
    held, lowest = 0, None
    for row in levels:
        held += row["count"]
        if held > bound:
            break
        lowest = row["level"]
    if lowest is None:
        return [np.empty(0, np.int64) for _ in values]
    rows = df.filter(scale >= lowest).select(*values).toPandas()
    order = np.argsort(rows[values[0]].to_numpy())
    return [rows[v].to_numpy()[order] for v in values]


def jaccard_groups(
    docs: DataFrame, *, words: int = 5, num: int = 4, den: int = 5
) -> DataFrame:
    """Groups of documents linked by Jaccard similarity of at least ``num / den``.

    ``docs`` has doc_id (long) and text. Returns doc_id, n_shingles, component_id,
    one row for each input row. component_id is the smallest doc_id that links
    reach. Texts that are null, empty or white space have 0 shingles and are linked
    with nothing: their component is their own doc_id, as it is for any other
    unlinked document. Rows without doc_id take part with a null id: they are
    linked, but never name a component that has any doc_id. Rows that repeat a
    doc_id are separate documents of one name. Other columns are not read.
    """
    if 4 * num < 3 * den or num > den:
        raise ValueError("similarity must be between 3/4 and 1")
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with arrow_bytes(spark):
        sets = materialize(
            base.mapInArrow(_set_rows(words), "doc_id long, n_shingles long, node long"), "sets"
        )
    groups = materialize(
        sets.filter(F.col("node").isNotNull())
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("rep"),
            F.count("*").alias("n_files"),
            F.max("n_shingles").alias("n_shingles"),
        ),
        "groups",
    )
    largest = groups.filter("n_files > 1 and rep is not null")
    copies = spark.sparkContext.broadcast(
        tuple(_bounded(largest, "n_files", ["node", "rep"], COPY_GROUPS))
    )
    total = groups.agg(F.sum("n_shingles")).first()[0] or 0
    bits = max(12, int(np.ceil(np.log2(total / FLUSH + 1))))
    counted = (
        base.mapInArrow(_token_counts(words, bits, copies), "bucket long, prints binary, counts binary")
        .groupBy("bucket")
        .applyInArrow(_frequent_prints(LEAST_FREQUENT), "print long, df long")
    )
    with arrow_bytes(spark):
        counted = materialize(counted, "frequent")
    frequent = spark.sparkContext.broadcast(_bounded(counted, "df", ["print"], FREQUENT)[0])
    pairs = (
        base.mapInArrow(
            _signatures(words, num, den, bits, frequent, copies),
            "bucket long, sigs binary, nodes binary, sizes binary",
        )
        .groupBy("bucket")
        .applyInArrow(_candidates(num, den), "a long, b long, shared long")
    )
    edges = pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    with arrow_bytes(spark):
        clusters = materialize(
            components(edges.filter(F.col("shared") >= MATCHES)).join(
                groups.select("node", "rep", "n_shingles"), "node"
            ),
            "clusters",
        )
    blocks = clusters.groupBy("label").agg(
        F.count("*").alias("n_files"),
        F.greatest(
            F.ceil(F.sum("n_shingles") / BLOCK_TOKENS), F.ceil(F.count("*") / BLOCK_SETS)
        ).alias("blocks"),
    )
    members = attach_groups(clusters, materialize(blocks, "blocks"), ["label"], spread_by="node")
    members = members.select(F.col("label").alias("cluster"), "node", "rep", "blocks")
    tokens = (
        base.join(members, F.col("doc_id").eqNullSafe(F.col("rep")))
        .select("cluster", "node", "blocks", "text")
        .mapInArrow(_token_rows(words), "cluster long, node long, blocks long, tokens binary")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    links = (
        tokens.withColumn("other", other)
        .select(
            "cluster",
            F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"),
            "node",
            "tokens",
        )
        .groupBy("cluster", "low", "high")
        .applyInArrow(_verified(num, den), "a long, b long")
    )
    with arrow_bytes(spark):
        labels = components(links)
    reached = groups.join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", F.col("node"))
    )
    reached = materialize(reached.select("node", "rep", "n_files", "label"), "labels")
    smallest = reached.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("n_files"))
    named = attach_groups(
        reached.select("node", "label", F.col("n_files").alias("copies")),
        materialize(smallest, "smallest"),
        ["label"],
        spread_by="node",
    ).select("node", F.col("copies").alias("n_files"), "component_id")
    found = attach_groups(sets, materialize(named, "named"), ["node"], spread_by="doc_id")
    return found.select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )
