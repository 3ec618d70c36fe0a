"""Exact top-k by inner product over vectors sorted by length.

Vectors become integers and are put in blocks by descending length. A sample gives an
orthogonal basis by singular value decomposition, so that the first few coordinates of a
rotated vector hold most of it. For a query and a vector, the product of the first
coordinates plus the product of the lengths of the rest bounds the inner product from
above (Cauchy-Schwarz); the products of whole lengths bound it for a whole block.

1. The block of the longest vectors goes to all tasks. Each query's k-th best score in it
   is a score that its result cannot fall below, and divided by the query's length it is
   the least length that a vector needs.
2. Queries are put in blocks by that least length, and meet only the blocks that have
   vectors long enough. A pair of blocks is worked on in slices by descending length:
   what a bound rules out is dropped after 8, 16, 32 coordinates, the rest is computed
   exactly, and the k-th best score rises on the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import arrow_rows
from shelfmark.session import materialize

# Rows of a block, fewer if they have many components; rows of a slice.
BLOCK_ROWS, BLOCK_BYTES = 4_096, 4 << 20
SLICE = 512
# Vectors that the basis is fitted to: those of the least hash of the row.
SAMPLE = 2_048
# Numbers of rotated coordinates after which bounds are checked.
CUTS = (8, 16, 32)
# Blocks that share a copy of a block of queries.
TILE = 64
# Share of a slice that is computed whole rather than pair by pair.
DENSE = 0.05
# Bounds are sums of rounded numbers: they count as so much larger, relative to the lengths.
SLACK = 1e-9
# Up to this product of lengths, sums of products of integers are exact in doubles.
EXACT = float(1 << 52)
LARGEST = (1 << 63) - 1


def integer_vectors(rows: DataFrame, vector: str, scale: int) -> Column:
    """floor(scale * x) of each component, in double; null if a component is null or not finite."""
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(values, lambda x: F.floor(x * F.lit(float(scale)))))


def _length(ints: np.ndarray) -> np.ndarray:
    values = ints.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", values, values))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors as rows; shorter ones end in zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), np.int64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(column)), lengths), place] = flat
    return out


def _packed(block: int, rows: np.ndarray, ids: np.ndarray, null: np.ndarray, ints: np.ndarray) -> dict:
    """A block as one row: arrays as bytes."""
    small = np.int32 if np.abs(ints).max(initial=0) < 1 << 31 else np.int64
    return {
        "block": block,
        "longest": float(_length(ints).max(initial=0)),
        "wide": small is np.int64,
        "rows": rows.tobytes(),
        "ids": ids.tobytes(),
        "null": null.tobytes(),
        "ints": ints.astype(small).tobytes(),
    }


BLOCK = pa.schema(
    [
        ("block", pa.int64()),
        ("longest", pa.float64()),
        ("wide", pa.bool_()),
        *[(name, pa.binary()) for name in ("rows", "ids", "null", "ints", "least")],
        ("need", pa.float64()),
    ]
)
BLOCK_COLUMNS = "block long, longest double, wide boolean, rows binary, ids binary, null binary, ints binary, least binary, need double"


def _blocks(dims: int, size: int):
    """Blocks of up to ``size`` rows from sorted rows (part, row, vec_id, ints, least).

    Blocks of queries also hold the least score of each query and the least length they need.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                some = batch.slice(start, size)
                ids = some.column("vec_id")
                row = _packed(
                    (some.column("part")[0].as_py() << 33) + made,
                    some.column("row").to_numpy(),
                    ids.fill_null(0).to_numpy(),
                    ids.is_null().to_numpy(zero_copy_only=False),
                    _matrix(some.column("ints"), dims),
                )
                least = some.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
                row["least"] = least.tobytes()
                row["need"] = float(some.column("need").to_numpy(zero_copy_only=False).min(initial=np.inf))
                made += 1
                yield pa.RecordBatch.from_pylist([row], BLOCK)

    return run


class _Block:
    """A block with its rotated coordinates and the lengths of what they leave."""

    def __init__(self, row: dict, basis: np.ndarray):
        dims = len(basis)
        self.rows = np.frombuffer(row["rows"], np.int64)
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.null = np.frombuffer(row["null"], bool)
        self.ints = np.frombuffer(row["ints"], np.int64 if row["wide"] else np.int32).reshape(-1, dims)
        self.values = self.ints.astype(np.float64)
        self.length = _length(self.ints)
        self.turned = self.values @ basis
        squares = np.cumsum(self.turned**2, axis=1)
        self.rest = {
            c: np.sqrt(np.maximum(self.length**2 - squares[:, c - 1], 0)) for c in _cuts(basis)
        }


def _cuts(basis: np.ndarray) -> list[int]:
    return sorted({min(c, basis.shape[1]) for c in CUTS} - {0})


def _exact(a: _Block, b: _Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows; those beyond long are the largest or smallest long."""
    if a.length.max(initial=0) * b.length.max(initial=0) < EXACT:
        return np.einsum("ij,ij->i", a.values[i], b.values[j]).astype(np.int64)
    sums = [sum(x * y for x, y in zip(p, q)) for p, q in zip(a.ints[i].tolist(), b.ints[j].tolist())]
    return np.array([max(-LARGEST - 1, min(LARGEST, x)) for x in sums], np.int64)


def _kept(query: np.ndarray, score: np.ndarray, null: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
    """Places of the k best of each query: by score, then vec_id (null last), then row."""
    order = np.lexsort((rows, ids, null, np.negative(score.astype(np.float64)), query))
    # Scores that are one double but not one integer.
    if np.abs(score).max(initial=0) >= 1 << 53:
        order = np.array(
            sorted(range(len(query)), key=lambda x: (query[x], -int(score[x]), null[x], ids[x], rows[x])), np.int64
        )
    ordered = query[order]
    starts = np.flatnonzero(np.diff(ordered, prepend=-1))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


class _Best:
    """The k best of each query of a block so far."""

    def __init__(self, queries: _Block, least: np.ndarray, k: int):
        self.queries, self.k, self.least = queries, k, least.copy()
        self.query, self.score = np.empty(0, np.int64), np.empty(0, np.int64)
        self.null, self.ids, self.rows = np.empty(0, bool), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, block: _Block, query: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
        own = self.queries.rows[query] == block.rows[place]
        query, place, score = query[~own], place[~own], score[~own]
        if not len(query):
            return
        both = [
            np.concatenate(pair)
            for pair in (
                (self.query, query),
                (self.score, score),
                (self.null, block.null[place]),
                (self.ids, block.ids[place]),
                (self.rows, block.rows[place]),
            )
        ]
        at = _kept(*both, self.k)
        self.query, self.score, self.null, self.ids, self.rows = (x[at] for x in both)
        full = np.bincount(self.query, minlength=len(self.least)) == self.k
        last = np.full(len(self.least), np.inf)
        np.minimum.at(last, self.query, self.score.astype(np.float64))
        self.least = np.maximum(self.least, np.where(full, last, -np.inf))

    def visit(self, block: _Block, basis: np.ndarray) -> None:
        """Take in a block of vectors, slice by slice by descending length."""
        order = np.argsort(-block.length, kind="stable")
        queries, cuts = self.queries, _cuts(basis)
        for start in range(0, len(order), SLICE):
            some = order[start : start + SLICE]
            slack = SLACK * queries.length * block.length[some[0]] + SLACK
            reach = queries.length * block.length[some[0]] >= self.least - slack
            active = np.flatnonzero(reach)
            if not len(active):
                break
            i, j = np.repeat(active, len(some)), np.tile(some, len(active))
            done = 0
            for cut in cuts:
                if not done:
                    part = queries.turned[active, :cut] @ block.turned[some, :cut].T
                    bound = part + np.outer(queries.rest[cut][active], block.rest[cut][some])
                    alive = np.flatnonzero(bound.ravel() >= np.repeat(self.least[active] - slack[active], len(some)))
                    part = part.ravel()[alive]
                else:
                    part += np.einsum("ij,ij->i", queries.turned[i, done:cut], block.turned[j, done:cut])
                    bound = part + queries.rest[cut][i] * block.rest[cut][j]
                    alive = np.flatnonzero(bound >= self.least[i] - slack[i])
                    part = part[alive]
                i, j, done = i[alive], j[alive], cut
                if len(i) > DENSE * len(active) * len(some):
                    break  # so many are left that all are computed faster
            if len(i) > DENSE * len(active) * len(some) and self._doubles(block):
                whole = (queries.values[active] @ block.values[some].T).ravel()
                high = np.flatnonzero(whole >= np.repeat(self.least[active], len(some)))
                self.add(block, active[high // len(some)], some[high % len(some)], whole[high].astype(np.int64))
                continue
            score = _exact(queries, block, i, j)
            high = score >= self.least[i]
            self.add(block, i[high], j[high], score[high])

    def _doubles(self, block: _Block) -> bool:
        return self.queries.length.max(initial=0) * block.length.max(initial=0) < EXACT


def _first_scores(head, basis, dims: int, k: int):
    """Adds to queries the k-th best score in the head (least) and the length it takes (need)."""

    def run(batches):
        turn = basis.value
        block = _Block(head.value, turn)
        for batch in batches:
            ids = batch.column("vec_id")
            row = _packed(
                0, batch.column("row").to_numpy(), ids.to_numpy(), np.zeros(len(ids), bool), _matrix(batch.column("ints"), dims)
            )
            queries = _Block(row, turn)
            best = _Best(queries, np.full(len(ids), -np.inf), k)
            best.visit(block, turn)
            need = np.full(len(ids), -np.inf)  # any vector may do
            some = best.least > 0
            need[some] = best.least[some] / queries.length[some] * (1 - 2 * SLACK)
            columns = [batch.column(c) for c in ("row", "vec_id", "ints")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(best.least), pa.array(need)], names=["row", "vec_id", "ints", "least", "need"]
            )

    return run


def _searched(basis, k: int):
    """The k best of each query in the blocks it meets, for rows of a block and a block of queries."""

    def found(best: _Best) -> pa.RecordBatch:
        of = best.queries
        return pa.RecordBatch.from_arrays(
            [
                pa.array(of.rows[best.query]),
                pa.array(of.ids[best.query]),
                pa.array(best.ids, mask=best.null),
                pa.array(best.rows),
                pa.array(best.score),
            ],
            names=["query", "query_id", "vec_id", "row", "score"],
        )

    def run(batches):
        turn, now, best = basis.value, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["q_block"] != now:
                    if best is not None:
                        yield found(best)
                    now = row["q_block"]
                    queries = _Block({k[2:]: v for k, v in row.items() if k.startswith("q_")}, turn)
                    best = _Best(queries, np.frombuffer(row["q_least"], np.float64), k)
                best.visit(_Block(row, turn), turn)
        if best is not None:
            yield found(best)

    return run


def top_inner_products(
    vectors: DataFrame, *, k: int = 5, every: int = 50, scale: int = 256, vector: str = "embedding"
) -> DataFrame:
    """The ``k`` vectors of largest inner product with each query: query_id, rank, vec_id, score.

    ``vectors`` has vec_id (long) and the array ``vector``; other columns are not read. A
    component x becomes floor(scale * x), x as double. Rows whose vec_id is divisible by
    ``every`` are queries; candidates are all rows but the query's own row, repeated rows
    and ids included. Equal scores rank by vec_id, null last, then in any but one fixed
    order. Null vectors and those with a null or non-finite component take no part. Rows
    without vec_id are candidates, not queries. A vector with fewer components than another
    counts as if it ended in zeros; an empty one scores 0. Scores beyond a long are the
    largest or smallest long. A query has fewer rows if there are fewer candidates; an
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = materialize(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integer_vectors(vectors, vector, scale).alias("ints"))
        .filter(F.col("ints").isNotNull())
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("square", F.aggregate("ints", F.lit(0.0), lambda n, x: n + x.cast("double") * x.cast("double"))),
        "vectors",
    )
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("ints")).alias("dims")).first()
    dims = max(facts.dims or 0, 1)
    size = int(max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dims))))
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(min(SAMPLE, max(1, BLOCK_BYTES // dims))).select("ints").toArrow()
    basis = spark.sparkContext.broadcast(_basis(sample.column("ints").combine_chunks(), dims))

    queries = rows.filter(F.col("vec_id") % every == 0)
    with arrow_rows(spark, size):
        blocks = materialize(_in_blocks(rows, facts.n, F.desc("square"), dims, size), "blocks")
    head = blocks.orderBy(F.desc("longest"), "block").limit(1).collect()  # at most BLOCK_BYTES
    if not head:
        return _ranked(rows.limit(0).select(*[F.lit(0).cast("long").alias(c) for c in ("query", "query_id", "vec_id", "row", "score")]), k)
    head = spark.sparkContext.broadcast(head[0].asDict())
    fields = "row long, vec_id long, ints array<long>, least double, need double"
    with arrow_rows(spark, size):
        first = materialize(
            queries.select("row", "vec_id", "ints").mapInArrow(_first_scores(head, basis, dims, k), fields), "first"
        )
        asked = materialize(_in_blocks(first, facts.n // every + 1, F.desc("need"), dims, size), "queries")
    with arrow_rows(spark, 1):
        found = materialize(
            _pairs(blocks, asked).mapInArrow(
                _searched(basis, k), "query long, query_id long, vec_id long, row long, score long"
            ),
            "found",
        )
    return _ranked(found, k)


def _basis(sample: pa.Array, dims: int) -> np.ndarray:
    """Right singular vectors of the sample, the leading ones as columns."""
    values = _matrix(sample, dims).astype(np.float64)
    top = np.abs(values).max(initial=0)
    _, _, turn = np.linalg.svd(values / (top or 1.0), full_matrices=False)
    return np.ascontiguousarray(turn[: max(CUTS)].T)


def _in_blocks(rows: DataFrame, n: int, order: Column, dims: int, size: int) -> DataFrame:
    """The rows as blocks, longest vectors or largest needs first."""
    parts = max(1, -(-n // (4 * size)))
    columns = [F.lit(None).cast("double").alias(c) if c not in rows.columns else F.col(c) for c in ("least", "need")]
    ranged = rows.repartitionByRange(parts, order, "row").sortWithinPartitions(order, "row")
    ranged = ranged.select("row", "vec_id", "ints", *columns, F.spark_partition_id().cast("long").alias("part"))
    return ranged.mapInArrow(_blocks(dims, size), BLOCK_COLUMNS)


def _pairs(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """Each block of vectors beside each block of queries that it may have a result for.

    Blocks are numbered, longest first. A block of queries is copied once for each TILE blocks,
    and a tile's blocks meet the copy by an equi-join. Numbers are dealt on rows without payload.
    """
    facts = blocks.select("block", "longest").withColumn(
        "tile", F.floor((F.row_number().over(Window.orderBy(F.desc("longest"), "block")) - 1) / TILE)
    )
    asked = queries.select(F.col("block").alias("q_block"), "need")
    asked = asked.withColumn("at", F.row_number().over(Window.orderBy("q_block")) - 1)
    n_tiles, n_asked = facts.agg(F.max("tile")).first()[0] + 1, asked.count()
    if not n_asked:
        n_asked = 1
    wanted = facts.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    wanted = wanted.join(asked, "at").filter(F.col("longest") >= F.col("need")).select("block", "tile", "q_block")
    payload = blocks.drop("least", "need").join(wanted, "block")
    copies = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns]).withColumn(
        "q_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_tiles - 1).cast("long")))
    )
    same = (payload["q_block"] == copies["q_block"]) & (payload["tile"] == copies["q_tile"])
    return payload.join(copies, same).drop(payload["q_block"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
