"""SentencePiece encoding as a relational lattice, and decoding.

A word's substrings of bounded length are rows; an equality join with the piece table keeps those
that are pieces, the edges of the word's lattice; they are grouped by word, and a higher-order fold
walks them to the best path. Words are the parts of a text that no piece reaches across.

Common words are encoded once, by the same lattice, into a cache of bounded size that every task
has. One pass takes the texts apart and puts cached ids in their place, with gaps for all other
words, which go through the lattice in the task that their document is sent to. So what moves is
packed ids and rare words, once, and only rare words are rows of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType

from driftmark.llm.common import Scratch, key_of, slices
from driftmark.llm.pieces import BLANK, Pieces, escaped

# The cache of common words: how many, how long at most, from how many documents at most, and how
# many bytes of it are sent to the tasks at most.
CACHE_WORDS, CACHE_CHARS, CACHE_DOCS, CACHE_BYTES = 1 << 20, 32, 30_000, 96 << 20
# The sample is one document of so many at most: the rare words of a larger one would be encoded for
# the cache and met nowhere else, and the rest's share of words, so their rows, would vary with the size.
CACHE_PART = 8
# Lists that a fold appends to are closed at this length, so that a long word isn't copied at every
# step.
CHUNK = 256
# Up to this length, 64 at most, an edge is one number, and the fold keeps one number for every end.
LONG_WORD = 64
# An edge's number: its score, then 63 less its start (the last six bits of it), then what it is in 22
# bits: a piece's id, or UNKNOWN and the code point of a character without a piece. An edge of a short
# word has ``ZERO`` added to it, so that it isn't negative, and its end before it, less 33.
ID_BITS, START_BITS = 22, 6
SCORE_AT = ID_BITS + START_BITS
UNKNOWN = 1 << (ID_BITS - 1)
END_AT, MIDDLE = 58, 33
ZERO = 1 << (END_AT - 1)

_LINK = "struct<start:int,id:int>"


def words_of(text: Column, pieces: Pieces) -> Column:
    """Words of a text as pieces see them; none for a null or empty one."""
    escaped = F.concat(F.lit(BLANK), F.replace(text, F.lit(" "), F.lit(BLANK)))
    return F.when(F.char_length(text) > 0, F.regexp_extract_all(escaped, F.lit(f"({pieces.word})"), 1))


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """Rows ``(piece, id, score)``; its size is that of the model file."""
    rows = [(piece, i, pieces.scores[piece]) for piece, i in pieces.ids.items()]
    return spark.createDataFrame(rows, "piece string, id int, score long")


def edges(words: DataFrame, table: DataFrame, pieces: Pieces) -> DataFrame:
    """Rows of ``words`` with the columns ``edge`` and ``far``: every substring that is a piece, and
    every single character that is none; as a number, or as (end, start, number) in a long word. A null
    word has one row with nulls."""
    size = F.char_length("word")
    rest = [c for c in words.columns]
    found = words.select(*rest, F.explode_outer(F.sequence(F.lit(0), size - 1)).alias("start"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(pieces.longest), size - F.col("start")))
    found = found.select(*rest, "start", F.explode_outer(F.when(F.col("start").isNotNull(), sizes)).alias("size"))
    found = found.select(*rest, "start", "size", F.col("word").substr(F.col("start") + 1, F.col("size")).alias("piece"))
    # Met by a hash, which is found faster than a string, and compared then.
    known = table.select(F.xxhash64("piece").alias("key"), F.col("piece").alias("met"), "id", "score")
    met = F.coalesce(F.col("met") == F.col("piece"), F.lit(False))
    found = found.withColumn("key", F.xxhash64("piece")).join(F.broadcast(known), "key", "left")
    found = found.where(met | (F.col("size") == 1) | F.col("word").isNull())
    score = F.when(met, F.col("score")).otherwise(F.lit(pieces.unknown)).cast("long")
    back = F.lit((1 << START_BITS) - 1) - F.col("start").bitwiseAND(F.lit((1 << START_BITS) - 1))
    what = F.when(met, F.col("id")).otherwise(UNKNOWN + F.ascii("piece"))
    number = F.shiftleft(score, SCORE_AT) + F.shiftleft(back, ID_BITS) + what
    end = F.col("start") + F.col("size")
    edge = F.shiftleft((end - MIDDLE).cast("long"), END_AT).bitwiseOR(number + ZERO)
    far = F.struct(end.alias("end"), "start", number.alias("number"))
    kept = [c for c in rest if c != "word"]
    return found.select(*kept, F.when(size <= LONG_WORD, edge).alias("edge"), F.when(size > LONG_WORD, far).alias("far"))


def _score(number: Column) -> Column:
    return F.shiftright(number, SCORE_AT)


def _id(number: Column) -> Column:
    return number.bitwiseAND(F.lit((1 << ID_BITS) - 1)).cast("int")


def _push(done: Column, last: Column, item: Column) -> tuple[Column, Column]:
    full = F.size(last) >= CHUNK
    return (
        F.when(full, F.concat(done, F.array(last))).otherwise(done),
        F.when(full, F.array(item)).otherwise(F.concat(last, F.array(item))),
    )


def _start(number: Column) -> Column:
    """The start in the number of an edge of a short word."""
    last = (1 << START_BITS) - 1
    return (F.lit(last) - F.shiftright(number, ID_BITS).bitwiseAND(F.lit(last))).cast("int")


def best_path(edges_by_end: Column) -> Column:
    """Ids along the best path through a short word's edges, sorted. Of equally good ones that with the
    longest last piece is taken, which has the greatest number. The fold keeps for every end the score
    of the best path to it, with the start and id of its last edge, as one number."""
    score, edge = F.lit(-(1 << SCORE_AT)), F.lit((1 << END_AT) - 1)

    def step(s: Column, e: Column) -> Column:
        number = F.get(s, _start(e)).bitwiseAND(score) + (e.bitwiseAND(edge) - ZERO)
        size = F.size(s)
        return (
            F.when(F.shiftright(e, END_AT) + MIDDLE >= size, F.array_append(s, number))
            .when(number > F.get(s, size - 1), F.array_append(F.slice(s, 1, size - 1), number))
            .otherwise(s)
        )

    def back(numbers: Column) -> Column:
        def link(s: Column, end: Column) -> Column:
            return F.when(end == _start(F.get(s, F.lit(0))), F.array_prepend(s, F.get(numbers, end))).otherwise(s)

        last = F.size(numbers) - 1
        ends = F.slice(F.sequence(last, F.lit(1), F.lit(-1)), 2, last)
        return F.aggregate(ends, F.array(F.get(numbers, last)), link, lambda s: F.transform(s, _id))

    return F.aggregate(edges_by_end, F.array(F.lit(0).cast("long")), step, back)


def _best_path_of_long(edges_by_end: Column, longest: int) -> Column:
    """The same for a long word's edges, sorted by end and start. Its paths are too long to be copied at
    each step: the fold keeps for every end the edge that reached it best, and a second one follows
    them back."""

    def step(s: Column, e: Column) -> Column:
        reach = e["end"] - e["start"]
        fresh = e["end"] > s["at"]
        score = F.element_at(s["window"], F.when(fresh, -reach).otherwise(-reach - 1)) + _score(e["number"])
        link = F.struct(e["start"].alias("start"), _id(e["number"]).alias("id"))
        done, last = _push(s["done"], s["last"], link)
        window = F.when(F.size(s["window"]) > longest, F.slice(s["window"], 2, longest)).otherwise(s["window"])
        added = F.struct(
            e["end"].alias("at"), F.concat(window, F.array(score)).alias("window"), done.alias("done"), last.alias("last")
        )
        better = F.struct(
            s["at"].alias("at"),
            F.concat(F.slice(s["window"], 1, F.size(s["window"]) - 1), F.array(score)).alias("window"),
            s["done"].alias("done"),
            F.concat(F.slice(s["last"], 1, F.size(s["last"]) - 1), F.array(link)).alias("last"),
        )
        return F.when(fresh, added).when(score > F.element_at(s["window"], -1), better).otherwise(s)

    def back(s: Column, end: Column) -> Column:
        link = F.get(s["links"], end - 1)
        done, last = _push(s["done"], s["last"], link["id"])
        moved = F.struct(link["start"].alias("at"), s["links"].alias("links"), done.alias("done"), last.alias("last"))
        return F.when(end == s["at"], moved).otherwise(s)

    start = F.struct(
        F.lit(0).alias("at"),
        F.array(F.lit(0).cast("long")).alias("window"),
        F.array().cast(f"array<array<{_LINK}>>").alias("done"),
        F.array().cast(f"array<{_LINK}>").alias("last"),
    )
    links = F.aggregate(edges_by_end, start, step, lambda s: F.flatten(F.concat(s["done"], F.array(s["last"]))))
    size = F.element_at(edges_by_end, -1)["end"]
    start = F.struct(
        size.alias("at"),
        links.alias("links"),
        F.array().cast("array<array<int>>").alias("done"),
        F.array().cast("array<int>").alias("last"),
    )
    ends = F.sequence(size, F.lit(1), F.lit(-1))
    return F.aggregate(ends, start, back, lambda s: F.reverse(F.flatten(F.concat(s["done"], F.array(s["last"])))))


def _with_bytes(ids: Column, pieces: Pieces) -> Column:
    """Characters without a piece as the ids of their bytes."""
    byte_ids = F.array(*[F.lit(i) for i in pieces.byte_ids])

    def of(code: Column) -> Column:
        def low(shift: int) -> Column:
            return F.lit(0x80) + F.shiftright(code, shift).bitwiseAND(F.lit(0x3F))

        raw = (
            F.when(code < 0x80, F.array(code))
            .when(code < 0x800, F.array(F.lit(0xC0) + F.shiftright(code, 6), low(0)))
            .when(code < 0x10000, F.array(F.lit(0xE0) + F.shiftright(code, 12), low(6), low(0)))
            .otherwise(F.array(F.lit(0xF0) + F.shiftright(code, 18), low(12), low(6), low(0)))
        )
        return F.transform(raw, lambda b: F.get(byte_ids, b))

    spelt = F.flatten(F.transform(ids, lambda i: F.when(i < UNKNOWN, F.array(i)).otherwise(of(i - UNKNOWN))))
    return F.when(F.exists(ids, lambda i: i >= UNKNOWN), spelt).otherwise(ids)


def _paths(pieces: Pieces) -> Column:
    """Aggregate: ids of the word whose edges a group holds, null where it holds none. Found where the
    edges are grouped: as expressions of a projection Catalyst would plan with them for long."""
    edges, far = (F.array(F.sort_array(F.collect_set(c))) for c in ("edge", "far"))
    short = F.get(F.transform(edges, lambda e: F.when(F.size(e) > 0, best_path(e))), 0)
    long = F.get(F.transform(far, lambda e: F.when(F.size(e) > 0, _best_path_of_long(e, pieces.longest))), 0)
    paths = F.array(F.coalesce(short, long))
    return F.get(F.transform(paths, lambda path: _with_bytes(path, pieces)), 0)


def encode_words(words: DataFrame, table: DataFrame, pieces: Pieces) -> DataFrame:
    """Rows ``(word, known)`` for distinct words."""
    found = edges(words.select(F.col("word").alias("known"), "word"), table, pieces)
    return found.groupBy(F.col("known").alias("word")).agg(_paths(pieces).alias("known"))


def _spread(docs: DataFrame) -> int:
    """Partitions for words, several times as many as for the documents they come from, so that what a
    task groups stays in memory."""
    return 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def common_words(docs: DataFrame, table: DataFrame, pieces: Pieces, scratch: Scratch) -> DataFrame:
    """Rows ``(word, known)``: ids of the words that are most frequent in a sample of documents. Only
    a cache: what it holds changes the work, not the result."""
    n = docs.count()
    share = F.pmod(F.xxhash64("doc_id", F.lit("cache")), F.lit(1 << 20))
    docs = docs.where(share < int((1 << 20) * min(1 / CACHE_PART, CACHE_DOCS / max(n, 1))))
    words = docs.select(F.explode(words_of(F.col("text"), pieces)).alias("word"))
    counted = words.where(F.char_length("word") <= CACHE_CHARS).groupBy("word").agg(F.count("*").alias("n"))
    top = scratch.settle("top", counted.orderBy(F.desc("n"), "word").limit(CACHE_WORDS).select("word"))
    return scratch.settle("cache", encode_words(top.repartition(_spread(docs), "word"), table, pieces))


_BLOCK = pa.schema([("word", pa.string()), ("packed", pa.binary())])


def _block(batch: pa.RecordBatch, width: str) -> tuple[bytes, int]:
    """Rows of words and ids with the ids packed, as compressed Arrow bytes, and their size before."""
    ids = batch.column(1)
    flat = ids.flatten().to_numpy().astype(width)
    ends = flat.itemsize * np.concatenate(([0], ids.value_lengths().to_numpy().cumsum()))
    packed = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.astype("i4")), pa.py_buffer(flat)])
    block = pa.RecordBatch.from_arrays([batch.column(0), packed], schema=_BLOCK)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _BLOCK, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(block)
    return sink.getvalue().to_pybytes(), block.nbytes


def _shared(cache: DataFrame, width: str) -> Broadcast:
    """The cache for the tasks, packed where it lies, so that the driver holds few bytes; words beyond
    ``CACHE_BYTES`` are left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            block, size = _block(batch, width)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary()), pa.array([size])], ["block", "size"])

    blocks, total = [], 0
    for block, size in cache.select("word", "known").mapInArrow(pack, "block binary, size long").collect():
        total += size
        if total <= CACHE_BYTES:
            blocks.append(bytes(block))
    return cache.sparkSession.sparkContext.broadcast(blocks)


# The cache that a Python worker has read last, by its name: the tasks of a worker share it.
_read: dict[str, dict[str, bytes]] = {}


def _known(name: str, cache: Broadcast) -> dict[str, bytes]:
    """Packed ids of the common words."""
    if name not in _read:
        known: dict[str, bytes] = {}
        for block in cache.value:
            for batch in pa.ipc.open_stream(block):
                known.update(zip(*(column.to_pylist() for column in batch.columns)))
        _read.clear()
        _read[name] = known
    return _read[name]


def _lists(values: pa.Array, sizes) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)


def _width(pieces: Pieces) -> str:
    """What ids are packed as on their way; the greatest number marks a gap."""
    return "<u2" if len(pieces.texts) < 1 << 16 else "<u4"


def with_gaps(docs: DataFrame, cache: DataFrame, name: str, pieces: Pieces) -> DataFrame:
    """Columns of ``docs`` with ``packed`` and ``rare`` in the place of ``text``: ids of the cached words
    and gaps for the others, and those others in order."""
    width, pattern = _width(pieces), pieces.word
    shared = _shared(cache, width)
    kept = [c for c in docs.columns if c != "text"]
    gap = b"\xff" * np.dtype(width).itemsize

    def taken_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, split = _known(name, shared).get, re.compile(pattern).findall
        for whole in batches:
            for start, end in slices(pc.binary_length(whole.column(0)).to_pylist()):
                batch = whole.slice(start, end - start)
                packed: list[bytes] = []
                rare: list[str] = []
                n_rare: list[int] = []
                for text in batch.column(0):
                    words = split(escaped(text.as_py()))
                    ids = list(map(get, words, repeat(gap)))
                    packed.append(b"".join(ids))
                    before = len(rare)
                    rare += [word for word, found in zip(words, ids) if found is gap]
                    n_rare.append(len(rare) - before)
                columns = [*batch.columns[1:], pa.array(packed, pa.binary()), _lists(pa.array(rare, pa.string()), n_rare)]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "packed", "rare"])

    schema = docs.select(*kept).schema.add("packed", BinaryType()).add("rare", ArrayType(StringType()))
    return docs.select("text", *kept).mapInArrow(taken_apart, schema)


def _put_together(batches: Iterator[pa.RecordBatch], width: str, kept: list[str]) -> Iterator[pa.RecordBatch]:
    # The texts are all taken apart by now, and the worker may live on: what it has read of the cache goes.
    _read.clear()
    for batch in filter(len, batches):
        packed, gaps = batch.column(0), batch.column(1)
        raw = np.frombuffer(b"".join(packed.to_pylist()), width)
        words = gaps.flatten()
        is_gap = raw == np.iinfo(width).max
        sizes = np.ones(len(raw), "i8")
        sizes[is_gap] = words.value_lengths().to_numpy()
        ids = np.repeat(raw.astype("i4"), sizes)
        ids[np.repeat(is_gap, sizes)] = words.flatten().to_numpy()
        # Where each row ends, first among its packed ids and then among all.
        ends = pc.binary_length(packed).to_numpy().cumsum() // np.dtype(width).itemsize
        ends = np.concatenate(([0], np.concatenate(([0], sizes.cumsum()))[ends]))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], lists], [*kept, "ids"])


def filled(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """``ids`` in the place of ``packed`` and ``gaps``, the ids of the rare words."""
    width = _width(pieces)
    kept = [c for c in rows.columns if c not in ("packed", "gaps")]

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _put_together(batches, width, kept)

    schema = rows.select(*kept).schema.add("ids", ArrayType(IntegerType()))
    return rows.select("packed", "gaps", *kept).mapInArrow(put_together, schema)


def encode(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """Rows ``(doc_id, ids, h1, h2)`` for each row of ``docs (doc_id, text)``: the best path's ids, and
    hashes of the text that decoding gives back.

    Null and empty texts have no ids; very long ones are taken apart one at a time, and their rare
    words are rows as any others; a text's own ``▁`` counts as a blank; null doc_ids and repeated rows
    are answered each; an empty table gives no rows; other columns are ignored. Models whose scores or
    ids don't fit a path's number are refused.
    """
    largest = max(map(abs, [pieces.unknown, *pieces.scores.values()]))
    if largest * LONG_WORD >= 1 << (63 - SCORE_AT) or len(pieces.texts) > UNKNOWN:
        raise ValueError("scores or ids are too large for a path's number")
    scratch = Scratch(docs.sparkSession, "lattice")
    docs = docs.select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit(BLANK), F.lit(" ")).alias("text"))
    table = piece_table(docs.sparkSession, pieces)
    cache = common_words(docs, table, pieces, scratch)
    # Rows are sent by a hash of id and text, so rows that share an id spread; rows equal in both have
    # the same ids, are encoded once and counted.
    hashes = [*zip(("h1", "h2"), key_of(F.col("text"))), *zip(("k1", "k2"), key_of(F.col("doc_id"), F.col("text")))]
    rows = with_gaps(docs.select("doc_id", "text", *[h.alias(n) for n, h in hashes]), cache, scratch.root, pieces)
    scratch.drop("top", "cache")
    row = F.struct("doc_id", "h1", "h2", "packed").alias("row")
    rows = rows.repartition(_spread(docs), "k1", "k2").select("k1", "k2", row, "rare")
    # A document becomes a row of itself and one of each rare word; both are grouped as they lie.
    nothing, word = F.lit(None).cast("string"), F.col("part.word")
    parts = F.concat(
        F.array(F.struct(F.lit(-1).alias("pos"), nothing.alias("word"))),
        F.transform("rare", lambda w, i: F.struct(i.alias("pos"), w.alias("word"))),
    )
    parts = rows.select("k1", "k2", "row", F.explode(parts).alias("part"))
    parts = parts.select("k1", "k2", "part.pos", F.when(word.isNull(), F.col("row")).alias("row"), word.alias("word"))
    first = [F.first("row", ignorenulls=True).alias("row")]
    words = edges(parts, table, pieces).groupBy("k1", "k2", "pos").agg(
        *first, F.count("row").cast("int").alias("copies"), _paths(pieces).alias("ids")
    )
    gap = F.when(F.col("pos") >= 0, F.struct("pos", "ids"))
    found = words.groupBy("k1", "k2").agg(*first, F.max("copies").alias("copies"), F.sort_array(F.collect_list(gap)).alias("gaps"))
    gaps = F.transform("gaps", lambda g: g["ids"]).alias("gaps")
    found = found.select("row.*", gaps, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
    return filled(found, pieces).select("doc_id", "ids", "h1", "h2")


def decoded(ids: Column, pieces: Pieces) -> Column:
    """Text of ids: the pieces' and bytes' UTF-8 put together, without the blank before it."""
    raw = [t.replace(BLANK, " ").encode().hex() for t in pieces.texts]
    for byte, i in enumerate(pieces.byte_ids):
        raw[i] = f"{byte:02x}"
    table = F.split(F.lit(",".join(raw)), ",")
    text = F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")), "UTF-8")
    return F.substring(text, 2, 1 << 30)


def round_trip(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """Encoded rows with ``text`` decoded and whether it is what was encoded."""
    rows = encoded.withColumn("text", decoded(F.col("ids"), pieces))
    same = [a == F.col(b) for a, b in zip(key_of(F.col("text")), ("h1", "h2"))]
    return rows.withColumn("lossless", same[0] & same[1]).drop("h1", "h2")
