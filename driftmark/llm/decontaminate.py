"""Benchmark decontamination: an FM-index per shard of documents, searched for test phrases.

A shard is what one task reads, in parts of a bounded number of words. Words that no phrase has
can't be part of a hit, so they are stored as gaps, and a run between gaps that is shorter than the
shortest phrase isn't indexed at all. Both leave every occurrence in the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import ascii_lower, key_of
from driftmark.llm.fm_index import FmIndex

WINDOW = 10
# Phrases that are sent to the tasks at once; more are searched block by block.
BLOCK_PHRASES = 200_000
# A part of a shard is closed at so many indexed words or bytes of text that wait for it.
PART_WORDS, PART_BYTES = 1_000_000, 32 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_IS_WORD = np.frombuffer(_FOLD, np.uint8) != 32

SPANS = "array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"
_SPANS = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "end")]))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case: digits, letters and everything beyond ASCII."""
    return (text or "").encode().translate(_FOLD).split()


def phrases_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct rows ``(item_id, phrase)`` of ``items (item_id, text)``: every window of words of an
    item, joined by spaces; an item with fewer words is one phrase, one without words or id none."""
    words = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"({WORD})"), 1)
    items = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), words.alias("w"))
    at = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    items = items.where(F.size("w") > 0).select("item_id", "w", F.explode(at).alias("i"))
    return items.select("item_id", F.array_join(F.slice("w", F.col("i"), F.lit(window)), " ").alias("phrase")).distinct()


@dataclass
class Phrases:
    """A block of phrases as symbols: 0 is no word of theirs, the words count from 1."""

    vocabulary: dict[bytes, int]
    rows: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]

    @classmethod
    def of(cls, found: list) -> Phrases:
        by_phrase: dict[str, list[str]] = {}
        for row in found:
            by_phrase.setdefault(row.phrase, []).append(row.item_id)
        vocabulary: dict[bytes, int] = {}
        split = [[vocabulary.setdefault(w, len(vocabulary) + 1) for w in p.encode().split(b" ")] for p in by_phrase]
        lengths = np.array([len(p) for p in split], np.int64)
        rows = np.zeros((len(split), int(lengths.max(initial=0))), np.int64)
        for row, phrase in zip(rows, split):
            row[: len(phrase)] = phrase
        return cls(vocabulary, rows, lengths, list(by_phrase.values()))


@dataclass
class _Part:
    """Documents whose runs are indexed together."""

    docs: list[tuple[Any, str, int]] = field(default_factory=list)
    runs: list[np.ndarray] = field(default_factory=list)
    of_doc: list[int] = field(default_factory=list)
    at_word: list[int] = field(default_factory=list)
    n_words: int = 0
    n_bytes: int = 0

    def hits(self, phrases: Phrases) -> dict[int, tuple[np.ndarray, set[str]]]:
        """For each document with a hit: which words are hit, and the items."""
        gap = np.zeros(1, np.int64)
        symbols = np.concatenate([x for run in self.runs for x in (run, gap)])
        index = FmIndex(symbols, len(phrases.vocabulary))
        low, high = index.search(phrases.rows, phrases.lengths)
        there = np.flatnonzero(high > low)
        counts = (high - low)[there]
        which = np.repeat(there, counts)
        rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low[there], counts)
        places = index.locate(rows)
        begins = np.cumsum([0] + [len(run) + 1 for run in self.runs[:-1]])
        run = np.searchsorted(begins, places, "right") - 1
        doc = np.array(self.of_doc)[run]
        word = np.array(self.at_word)[run] + places - begins[run]
        out: dict[int, tuple[np.ndarray, set[str]]] = {}
        by_doc = np.argsort(doc, kind="stable")
        cuts = np.flatnonzero(np.diff(doc[by_doc])) + 1
        for group in np.split(by_doc, cuts) if len(doc) else []:
            d = int(doc[group[0]])
            change = np.zeros(self.docs[d][2] + 1, np.int64)
            np.add.at(change, word[group], 1)
            np.add.at(change, word[group] + phrases.lengths[which[group]], -1)
            items = {i for p in np.unique(which[group]).tolist() for i in phrases.items[p]}
            out[d] = (np.cumsum(change[:-1]) > 0, items)
        return out


def _edges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open bounds of the runs of true."""
    change = np.diff(np.concatenate(([False], flags, [False])).astype(np.int8))
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def spans_of(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words: word numbers ``[first, last)`` and code points ``[start, end)``."""
    raw = np.frombuffer(text.encode(), np.uint8)
    begin, end = _edges(_IS_WORD[raw])
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    first, last = _edges(hit)
    columns = (first, last, points[begin[first]], points[end[last - 1]])
    return [dict(zip(("first", "last", "start", "end"), row)) for row in zip(*(c.tolist() for c in columns))]


def _searcher(phrases: Phrases, schema: pa.Schema):
    shortest = int(phrases.lengths.min(initial=1 << 30))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(docs: list, found: dict) -> pa.RecordBatch:
            spans = [spans_of(docs[i][1], found[i][0]) if i in found else [] for i in range(len(docs))]
            items = [sorted(found[i][1]) if i in found else [] for i in range(len(docs))]
            columns = [[d[0] for d in docs], [d[2] for d in docs], spans, items]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        def close(part: _Part) -> pa.RecordBatch:
            return batch_of(part.docs, part.hits(phrases))

        part, known = _Part(), phrases.vocabulary.get
        for batch in batches:
            clear = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                words = words_of(text)
                ids = np.fromiter(map(known, words, repeat(0)), np.int64, len(words))
                begin, end = _edges(ids > 0)
                long = end - begin >= shortest
                if not long.any():
                    clear.append((key, "", len(words)))
                    continue
                for a, b in zip(begin[long].tolist(), end[long].tolist()):
                    part.runs.append(ids[a:b])
                    part.of_doc.append(len(part.docs))
                    part.at_word.append(a)
                    part.n_words += b - a
                part.docs.append((key, text, len(words)))
                part.n_bytes += len(text)
                if part.n_words >= PART_WORDS or part.n_bytes >= PART_BYTES:
                    yield close(part)
                    part = _Part()
            if clear:
                yield batch_of(clear, {})
        if part.docs:
            yield close(part)

    return search


def find_phrases(docs: DataFrame, phrases: Phrases) -> DataFrame:
    """Rows ``(doc_id, n_words, spans, items)`` for each row of ``docs (doc_id, text)``, without a
    shuffle: each task indexes what it reads."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = pa.schema(
        [("doc_id", _ARROW[kind]), ("n_words", pa.int64()), ("spans", _SPANS), ("items", pa.list_(pa.string()))]
    )
    search = _searcher(phrases, schema)
    return docs.select("doc_id", "text").mapInArrow(
        search, f"doc_id {kind}, n_words bigint, spans {SPANS}, items array<string>"
    )


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def contamination(
    docs: DataFrame, items: DataFrame, *, window: int = WINDOW, block_phrases: int = BLOCK_PHRASES
) -> DataFrame:
    """Rows ``(doc_id, n_words, spans, items)`` for each row of ``docs (doc_id, text)``.

    A phrase is a window of words of an item of ``items (item_id, text)``. ``spans`` are the merged
    runs of words inside any occurrence of a phrase, as word numbers and code points; ``items`` the
    sorted ids, as text, of items with an occurring phrase. Phrases are sent to the tasks in blocks
    of about ``block_phrases``; the number of blocks follows from their count, and results of
    blocks are merged per document.

    Null and empty texts have no words and no hits; items without words or id are none; rows that
    repeat a doc_id, or are wholly equal, are answered each; a null doc_id is kept; without items
    nothing is hit; an empty table gives no rows; other columns are ignored. doc_id is an integer
    or a string.
    """
    found = phrases_of(items.select("item_id", "text"), window)
    blocks = max(1, -(-found.count() // block_phrases))
    block = F.pmod(F.xxhash64("phrase"), F.lit(blocks))

    def of_block(n: int) -> Phrases:
        return Phrases.of(found.where(block == n).collect())

    docs = docs.select("doc_id", "text")
    if blocks == 1:
        return find_phrases(docs, of_block(0))
    # Equal rows have equal results: they are merged as one and told apart by their number.
    names = ["h1", "h2"]
    keyed = docs.groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    keyed = keyed.select(
        F.to_json(F.struct("doc_id", *[h.alias(n) for n, h in zip(names, key_of(F.col("text")))])).alias("key"),
        "doc_id", "text", "copies",
    )
    parts = [find_phrases(keyed.select(F.col("key").alias("doc_id"), "text"), of_block(n)) for n in range(blocks)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    merged = every.groupBy(F.col("doc_id").alias("key")).agg(
        F.max("n_words").alias("n_words"),
        merge_spans(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    rows = keyed.select("key", "doc_id", "copies").join(merged, "key")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.select("doc_id", "n_words", "spans", "items")


def merge_spans(spans):
    """Sorted spans with those that touch or overlap made one."""

    def add(done, span):
        last = F.element_at(done, -1)
        joined = F.struct(
            last["first"].alias("first"), F.greatest(last["last"], span["last"]).alias("last"),
            last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"),
        )
        touching = (F.size(done) > 0) & (span["first"] <= F.try_element_at(done, F.lit(-1))["last"])
        return F.when(touching, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(
            F.concat(done, F.array(span))
        )

    return F.aggregate(spans, F.array().cast(SPANS), add)


def without_spans(text, spans):
    """A text without its spans' code points."""
    bounds = F.concat(F.array(F.lit(0).cast("long")), F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["end"]))))
    kept = F.transform(
        F.sequence(F.lit(0), F.size(spans)),
        lambda i: F.substring(
            text,
            (F.get(bounds, 2 * i) + 1).cast("int"),
            F.coalesce(F.get(bounds, 2 * i + 1), F.char_length(text).cast("long")).cast("int") - F.get(bounds, 2 * i).cast("int"),
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(kept, ""))
