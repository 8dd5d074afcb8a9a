"""Nearest neighbours by inner product, as a block matrix join of int8 codes.

Each vector is a scale times int8 codes and a rest. Blocks of query rows and blocks of candidate
rows meet in the cells of a grid; in a cell every pair of blocks is one product of code matrices,
which is exact in integers. The lengths of the rests bound how far it is from the true product, so a
pair whose upper bound is below the query's k-th best cannot be among the nearest. The others are
computed from the original components and go to the query's heap; heaps of a query's cells are
merged at the end. Nothing is lost: the bound is proven for every pair.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftmark.llm.common import Scratch
from driftmark.llm.vector_codes import finite

# Rows of a block at most, and its components. A task holds one tile of products at a time.
QUERY_ROWS, CANDIDATE_ROWS, BLOCK_VALUES = 512, 4096, 1 << 22
# Pairs of rows that a cell has about, where there are more than one cell for each core.
CELL_PAIRS = 1 << 33
# Pairs that are computed from the original components at a time.
CHUNK = 1 << 15

_BLOCK = "block long, dim int, n int, ids binary, vectors binary, codes binary, bounds binary"
_FIELDS = ("block", "dim", "n", "ids", "vectors", "codes", "bounds")


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 codes, and per row: scale, length of the coded vector, length of the rest. The rest is
    rounded up by more than all later sums of doubles can be off."""
    top = np.abs(vectors).max(axis=1)
    scale = np.where(top / 127 > 0, top / 127, top)
    with np.errstate(over="ignore"):
        whole = vectors / scale[:, None]
        codes = np.rint(whole)
        length = scale * np.sqrt((codes**2).sum(axis=1))
        rest = scale * np.sqrt(((whole - codes) ** 2).sum(axis=1))
        rest = rest * (1 + 1e-9) + length * (vectors.shape[1] + 64) * 1e-15
    return codes.astype(np.int8), np.stack([scale, length, rest])


def _packed(rows: int, kind: np.dtype):
    """Turns batches of (vec_id, vector) into rows of a block each, of one length of vectors."""

    def block(dim: int, ids: np.ndarray, vectors: np.ndarray) -> tuple:
        codes, bounds = quantise(vectors.astype(np.float64))
        return (uuid.uuid4().int >> 65, dim, len(ids), ids.tobytes(), vectors.astype(kind).tobytes(), codes.tobytes(), bounds.tobytes())

    def out(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], list(_FIELDS))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting = 0

        def flush(dim: int) -> tuple:
            parts = held.pop(dim)
            return block(dim, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            column = batch.column(1)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
            sizes = np.diff(ends, prepend=0)
            for dim in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == dim)
                size = max(1, min(rows, BLOCK_VALUES // dim))
                for at in range(0, len(mine), size):
                    some = mine[at : at + size]
                    vectors = flat[(ends[some] - dim)[:, None] + np.arange(dim)]
                    held.setdefault(dim, []).append((ids[some], vectors))
                    waiting += vectors.size
                    if sum(len(p[0]) for p in held[dim]) >= size:
                        waiting -= sum(p[1].size for p in held[dim])
                        yield out([flush(dim)])
            while waiting > BLOCK_VALUES:
                dim = max(held, key=lambda d: sum(p[1].size for p in held[d]))
                waiting -= sum(p[1].size for p in held[dim])
                yield out([flush(dim)])
        for dim in list(held):
            yield out([flush(dim)])

    return packed


class _Block:
    """A block row as arrays."""

    def __init__(self, row: dict, side: str, kind: np.dtype):
        dim, n = row["dim"], row[f"{side}_n"]
        self.key = row[f"{side}_block"]
        self.ids = np.frombuffer(row[f"{side}_ids"], np.int64)
        self.vectors = np.frombuffer(row[f"{side}_vectors"], kind).reshape(n, dim)
        # Sums of int8 products stay below 2**24 up to this length, where single floats are exact.
        exact = np.float32 if 127 * 127 * dim < 1 << 24 else np.float64
        self.codes = np.frombuffer(row[f"{side}_codes"], np.int8).reshape(n, dim).astype(exact)
        self.scale, self.length, self.rest = np.frombuffer(row[f"{side}_bounds"], np.float64).reshape(3, n)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, added up in double precision from the first component on."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d].astype(np.float64) * b[:, d]
    return np.where(np.isnan(total), -np.inf, total)


class Heaps:
    """The k best (score, -id) of every query of a block, the worst on top."""

    def __init__(self, queries: _Block, k: int):
        self.queries, self.k = queries, k
        self.best: list[list[tuple[float, int]]] = [[] for _ in queries.ids]

    def worst(self) -> np.ndarray:
        """The score that a candidate has to reach; none as long as a heap has room."""
        return np.array([h[0][0] if len(h) == self.k else -np.inf for h in self.best])

    def survivors(self, candidates: _Block) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the tile that may be among the nearest."""
        q, c = self.queries, candidates
        with np.errstate(over="ignore", invalid="ignore"):
            coded = (q.codes @ c.codes.T) * q.scale[:, None] * c.scale
            off = np.stack([q.length + q.rest, q.rest], axis=1) @ np.stack([c.rest, c.length])
            upper = coded + off
            own = q.ids[:, None] == c.ids
            least = self.worst()
            room = np.flatnonzero(np.isneginf(least))
            if len(room) and len(c.ids) >= self.k:
                # Where a heap has room, the k-th largest lower bound of this tile is a bound as well.
                lower = np.where(own[room] | np.isnan(upper[room]), -np.inf, coded[room] - off[room])
                lower = np.where(np.isnan(lower), -np.inf, lower)
                least[room] = np.partition(lower, len(c.ids) - self.k, axis=1)[:, len(c.ids) - self.k]
            return np.nonzero(~(upper < least[:, None]) & ~own)

    def add(self, candidates: _Block) -> None:
        """Take in a block of candidates."""
        at, of = self.survivors(candidates)
        with np.errstate(over="ignore", invalid="ignore"):
            parts = [
                product(self.queries.vectors[at[i : i + CHUNK]], candidates.vectors[of[i : i + CHUNK]])
                for i in range(0, len(at), CHUNK)
            ]
        scores, ids = np.concatenate([*parts, np.zeros(0)]), candidates.ids[of]
        order = np.lexsort((ids, -scores, at))
        at, scores, ids = at[order], scores[order], ids[order]
        first = np.searchsorted(at, at)
        top = np.arange(len(at)) - first < self.k
        for i, score, vec_id in zip(at[top].tolist(), scores[top].tolist(), ids[top].tolist()):
            heap = self.best[i]
            if len(heap) < self.k:
                heapq.heappush(heap, (score, -vec_id))
            else:
                heapq.heappushpop(heap, (score, -vec_id))

    def rows(self) -> pa.RecordBatch:
        found = [
            (self.queries.key, i, int(self.queries.ids[i]), -negative, score)
            for i, heap in enumerate(self.best)
            for score, negative in heap
        ]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
        names = ["block", "at", "query_id", "vec_id", "score"]
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], names)


def grid(n_queries: int, n_candidates: int, cores: int) -> tuple[int, int]:
    """Rows and columns of the grid: enough cells for all cores and for their work, in the shape that
    copies the fewest rows. A query goes to each column, a candidate to each row."""
    cells = max(cores, math.ceil(n_queries * n_candidates / CELL_PAIRS), 1)
    rows = max(1, round(math.sqrt(cells * n_queries / max(n_candidates, 1))))
    return rows, math.ceil(cells / rows)


def nearest(queries: DataFrame, candidates: DataFrame, k: int, *, vector: str = "embedding") -> DataFrame:
    """Rows ``(query_id, rank, vec_id, score)``: the ``k`` candidates with the largest inner product
    for each row of ``queries (vec_id, <vector>)``, ties to the smaller vec_id.

    A query's own vec_id is no candidate of it. Rows without a vec_id and vectors that are null, zero
    or hold null or non-finite components take no part; a query meets candidates of its own length.
    Rows that share a vec_id are rows of their own on both sides. A product that overflows to no
    number counts as minus infinity. Empty tables give no rows; other columns are ignored.
    """
    spark = queries.sparkSession
    scratch = Scratch(spark, "tile-search")
    single = dict(queries.dtypes)[vector] == dict(candidates.dtypes)[vector] == "array<float>"
    kind = np.dtype(np.float32 if single else np.float64)

    def blocks(name: str, rows: DataFrame, size: int) -> DataFrame:
        rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast(f"array<{'float' if single else 'double'}>").alias("v"))
        rows = rows.where(F.col("vec_id").isNotNull() & finite(F.col("v")) & F.exists("v", lambda x: x != 0))
        return scratch.settle(name, rows.mapInArrow(_packed(size, kind), _BLOCK))

    left, right = blocks("queries", queries, QUERY_ROWS), blocks("candidates", candidates, CANDIDATE_ROWS)
    sizes = [df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n for df in (left, right)]
    n_rows, n_columns = grid(*sizes, spark.sparkContext.defaultParallelism)
    cells = n_rows * n_columns

    def named(df: DataFrame, side: str) -> DataFrame:
        return df.select("dim", *[F.col(c).alias(f"{side}_{c}") for c in _FIELDS if c != "dim"], "cell_row", "cell_column")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = left.withColumn("cell_row", F.pmod(F.xxhash64("block"), F.lit(n_rows)).cast("int")).withColumn("cell_column", every(n_columns))
    right = right.withColumn("cell_column", F.pmod(F.xxhash64("block"), F.lit(n_columns)).cast("int")).withColumn("cell_row", every(n_rows))
    on = ["dim", "cell_row", "cell_column"]
    # As many partitions as cells: small blocks stand for much work and must not be put together. The
    # merge gives a query block's tiles one after the other.
    left = named(left, "q").repartition(cells, *on)
    right = named(right, "c").repartition(cells, *on)
    tiles = left.join(right.hint("merge"), on)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if heaps is None or heaps.queries.key != row["q_block"]:
                    if heaps is not None:
                        yield heaps.rows()
                    heaps = Heaps(_Block(row, "q", kind), k)
                heaps.add(_Block(row, "c", kind))
        if heaps is not None:
            yield heaps.rows()

    found = tiles.mapInArrow(searched, "block long, at int, query_id long, vec_id long, score double")
    order = Window.partitionBy("block", "at").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def self_search(vectors: DataFrame, k: int = 20, every: int = 20, *, vector: str = "embedding") -> DataFrame:
    """Nearest other rows of the rows whose vec_id is divisible by ``every``."""
    return nearest(vectors.where(F.col("vec_id") % every == 0), vectors, k, vector=vector)
