"""Vector compression: every part of a vector becomes the number of its nearest codebook entry.

Components are integers, so a block of vectors holds few different ones in each dimension. A block
is stored as a dictionary per dimension, its distinct integers, and codes into it. To find distances
the squared differences of the distinct integers to all entries are tabulated once a dimension; a
part's distance is then gathered from its dimensions' tables and added up. Dictionaries belong to a
block, so their size is bounded by its rows however many values a column has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import Scratch
from driftmark.operators.joins import skew_join

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
# A block has so many rows and components at most; codes into its dictionaries have 16 bits.
BLOCK_ROWS, BLOCK_VALUES = 1 << 14, 1 << 20
# Sums travel in pieces of so many bits, so that adding them up can't overflow.
LIMB = 40
LONG_MAX = (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    def plain(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    return F.coalesce(F.forall(vector, plain), F.lit(False))


def parts_of(dim: int) -> list[range]:
    """Consecutive dimensions of each part; equally many where 8 divides their number."""
    return [range(dim * p // PARTS, dim * (p + 1) // PARTS) for p in range(PARTS)]


def floored(x: np.ndarray) -> np.ndarray:
    """floor(4096 * x) / 4096, exactly: a double beyond 2**50 is a whole number already."""
    with np.errstate(over="ignore"):
        return np.where(np.abs(x) < 2.0**50, np.floor(x * SCALE) / SCALE, x) + 0.0


def integers(values: np.ndarray, safe: bool) -> np.ndarray:
    """4096 times the floored components, as 64-bit integers where all sums fit, else as exact ones."""
    if safe:
        return (values * SCALE).astype(np.int64)
    return np.array([int(Fraction(v) * SCALE) for v in values.tolist()], object)


def _blocks(dim: int, names: tuple[str, str]):
    """Turns batches of (vec_id, label, vector) into rows of a block each."""
    size = max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(dim, 1)))

    def block(ids: pa.Array, labels: pa.Array, vectors: np.ndarray) -> pa.RecordBatch:
        codes = np.empty((dim, len(ids)), np.uint16)
        values = []
        for d in range(dim):
            distinct, codes[d] = np.unique(vectors[:, d], return_inverse=True)
            values.append(distinct)
        whole = pa.array([0, len(ids)], pa.int32())
        flat = np.concatenate(values) if values else np.zeros(0)
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(whole, ids),
                pa.ListArray.from_arrays(whole, labels),
                pa.array([len(ids)], pa.int32()),
                pa.array([[len(v) for v in values]], pa.list_(pa.int32())),
                pa.array([flat], pa.list_(pa.float64())),
                pa.array([codes.tobytes()], pa.binary()),
            ],
            [*names, "n", "sizes", "distinct", "codes"],
        )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while held and sum(b.num_rows for b in held) >= size:
                table = pa.Table.from_batches(held).combine_chunks()
                yield block(*_columns(table.slice(0, size), dim))
                held = table.slice(size).to_batches()
        if sum(b.num_rows for b in held):
            yield block(*_columns(pa.Table.from_batches(held), dim))

    return packed


def _columns(table: pa.Table, dim: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
    ids, labels, vectors = (table.column(i).combine_chunks() for i in range(3))
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return ids, labels, floored(flat.reshape(table.num_rows, dim))


class Coder:
    """Assigns the parts of blocks to the entries of codebooks (per part, entries by dimensions)."""

    def __init__(self, dim: int, books: list[list[list[int]]]):
        self.dim, self.books, self.parts = dim, books, parts_of(dim)
        self.most = max((abs(x) for book in books for entry in book for x in entry), default=0)

    def assign(self, sizes: list[int], distinct: np.ndarray, codes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
        """For each part the rows' entry numbers; the rows' squared distances summed over parts; the
        integers of each dimension's dictionary."""
        most = max(self.most, int(np.abs(distinct).max(initial=0) * SCALE) if np.isfinite(distinct * SCALE).all() else 1 << 64)
        safe = 4 * most * most * max(self.dim, 1) < 1 << 62
        kind = np.int64 if safe else object
        ends = np.cumsum([0, *sizes])
        values = [integers(distinct[a:b], safe) for a, b in zip(ends, ends[1:])]
        n = codes.shape[1]
        error, chosen = np.zeros(n, kind), []
        for book, dims in zip(self.books, self.parts):
            distance = np.zeros((n, len(book)), kind)
            for at, d in enumerate(dims):
                entries = np.array([entry[at] for entry in book], kind)
                table = (values[d][:, None] - entries[None, :]) ** 2
                distance += table[codes[d]]
            best = distance.argmin(axis=1)
            error = error + distance[np.arange(n), best]
            chosen.append(best)
        return chosen, error, values

    def sums(self, blocks: Iterator[tuple]) -> Iterator[tuple[int, int]]:
        """Over all blocks: (slot, total) of every entry's components and, behind them, its rows."""
        k = len(self.books[0])
        totals = np.zeros((self.dim + PARTS) * k, object)
        for sizes, distinct, codes in blocks:
            chosen, _, values = self.assign(sizes, distinct, codes)
            for p, dims in enumerate(self.parts):
                at = (self.dim + p) * k
                totals[at : at + k] += np.bincount(chosen[p], minlength=k).astype(object)
                for d in dims:
                    n = len(values[d])
                    met = np.bincount(codes[d].astype(np.int64) * k + chosen[p], minlength=n * k).reshape(n, k)
                    totals[d * k : (d + 1) * k] += (met * values[d][:, None]).sum(axis=0).astype(object)
        for slot in np.flatnonzero(totals):
            yield int(slot), int(totals[slot])

    def moved(self, totals: dict[int, int]) -> list[list[list[int]]]:
        """Every entry at the floored mean of its parts; one without any stays."""
        k = len(self.books[0])
        out = []
        for p, (book, dims) in enumerate(zip(self.books, self.parts)):
            counts = [totals.get((self.dim + p) * k + e, 0) for e in range(k)]
            out.append([[totals.get(d * k + e, 0) // n for d in dims] if n else book[e] for e, n in enumerate(counts)])
        return out


def _read(batch: pa.RecordBatch, dim: int) -> Iterator[tuple]:
    """Sizes, distinct values and codes of each block of a batch."""
    for i in range(batch.num_rows):
        n, sizes, distinct, codes = (batch.column(name)[i] for name in ("n", "sizes", "distinct", "codes"))
        flat = np.frombuffer(codes.as_py(), np.uint16)
        yield sizes.as_py(), distinct.values.to_numpy(zero_copy_only=False), flat.reshape(dim, n.as_py())


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    sign, rest, at = (-1 if total < 0 else 1), abs(total), 0
    while rest:
        yield at, sign * (rest & ((1 << LIMB) - 1))
        rest, at = rest >> LIMB, at + 1


def _totals(blocks: DataFrame, coder: Coder) -> dict[int, int]:
    """Every slot's total over all blocks. A task adds up what it reads, so what is shuffled and
    collected has the size of the codebooks."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = coder.sums(b for batch in batches for b in _read(batch, coder.dim))
        rows = [(slot, at, limb) for slot, total in found for at, limb in _limbs(total)]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["slot", "at", "limb"])

    rows = blocks.select("n", "sizes", "distinct", "codes").mapInArrow(added, "slot int, at int, limb long")
    out: dict[int, int] = {}
    for r in rows.groupBy("slot", "at").agg(F.sum("limb").alias("limb")).collect():
        out[r.slot] = out.get(r.slot, 0) + (r.limb << (LIMB * r.at))
    return out


def _first(kept: DataFrame) -> list[list[float]]:
    """Vectors of the smallest ids, in their order: ids are chosen first, so that tasks send no more
    vectors than that."""
    ids = [r.vec_id for r in kept.select("vec_id").orderBy(F.asc_nulls_last("vec_id")).limit(ENTRIES).collect()]
    if ids and ids[-1] is not None:
        kept = kept.where(F.col("vec_id") <= ids[-1])
    return [list(r.vector) for r in kept.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).collect()]


def books_digest(books: list[list[list[int]]]) -> str:
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return hashlib.sha256(text.encode()).hexdigest()


def compress(vectors: DataFrame, *, vector: str = "embedding") -> tuple[DataFrame, list[list[list[int]]]]:
    """Rows ``(vec_id, label, code, error)`` for ``vectors (vec_id, <vector>, label)``, and the final
    codebooks: per part, a list of entries.

    Rows whose vector is null or holds a null or non-finite component go. Rows that share an id are
    coded each; a null id comes after all others when the first entries are chosen, and rows that
    share an id come by their vectors. Fewer than 16 rows make as many entries; an empty table gives
    no rows and empty codebooks. The dimension is that of the first row; a row of another length has
    a null code and error. Where 8 doesn't divide it, part p begins at its eighths rounded down.
    Components are exact at any size; an error beyond 2**63 - 1 is given as that. Other columns are
    ignored.
    """
    kinds = dict(vectors.dtypes)
    rows = vectors.select("vec_id", "label", F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(finite(F.col("vector")))
    lead = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").select(F.size("vector").alias("dim")).limit(1).collect()
    dim = lead[0].dim if lead else 0
    fit = rows.where(F.size("vector") == dim)
    first = [integers(floored(np.array(v, np.float64)), False).tolist() for v in _first(fit)]
    books = [[[entry[d] for d in dims] for entry in first] for dims in parts_of(dim)]

    scratch = Scratch(vectors.sparkSession, "vector-codes")
    names = ("vec_id", "label")
    schema = f"vec_id array<{kinds['vec_id']}>, label array<{kinds['label']}>, n int, sizes array<int>, distinct array<double>, codes binary"
    blocks = scratch.settle("blocks", fit.mapInArrow(_blocks(dim, names), schema)) if first else None
    for _ in range(ROUNDS if first else 0):
        coder = Coder(dim, books)
        books = coder.moved(_totals(blocks, coder))

    out_schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    odd = rows.where(F.size("vector") != dim).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not first:
        return odd, books
    coder = Coder(dim, books)
    digits = np.array([f"{i:02x}" for i in range(ENTRIES)], object)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, found in enumerate(_read(batch, dim)):
                chosen, error, _ = coder.assign(*found)
                code = sum((digits[c] for c in chosen[1:]), digits[chosen[0]])
                error = pa.array([min(int(e), LONG_MAX) for e in error], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i].values, batch.column(1)[i].values, pa.array(code, pa.string()), error],
                    [*names, "code", "error"],
                )

    found = scratch.settle("coded", blocks.mapInArrow(coded, out_schema).unionByName(odd))
    scratch.drop("blocks")
    return found, books


def with_label_error(coded: DataFrame) -> DataFrame:
    """Coded rows with ``label_error``, the errors of all rows with their label added up; nulls are
    one label. The sums are joined back, so that a label with many rows is not gathered."""
    key = {"_none": F.col("label").isNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))}
    rows = coded.withColumns(key)
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    total = F.when(total > LONG_MAX, F.lit(LONG_MAX)).otherwise(total.cast("long"))
    sums = rows.groupBy(*key).agg(total.alias("label_error"))
    return skew_join(rows, sums, list(key)).drop(*key)
