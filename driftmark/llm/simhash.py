"""SimHash near-dedup by deletion-variant signatures.

Two fingerprints that differ in at most ``max_bits`` bits, cut into segments so few that
``max_bits < 2 * segments``, have a segment in which they differ in at most one bit. So each
fingerprint is indexed under every segment with each of its bits left out once: 64 variants in all,
whatever the number of segments, and an equality join on the variant finds every link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import Scratch, components
from driftmark.operators.joins import skew_join

BITS, SEED = 64, 42
SHINGLE, MAX_BITS = 4, 4
# Shingles whose bits are counted at once.
BLOCK = 1 << 16
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Majority of the bits of XXH64 over the word shingles of a text, as an unsigned integer.

    Words are parted by ASCII blanks, A-Z is lower-cased; fewer words than ``size`` make one
    shingle, no words give zero. A bit is set if it is set in over half of the shingles.
    """
    raw = np.frombuffer((text or "").encode().lower(), np.uint8)
    blank = _BLANK[raw]
    # One space for each run of blanks, none at the ends.
    kept = ~blank
    kept[1:] |= ~blank[:-1]
    joined = np.where(blank, 32, raw)[kept].astype(np.uint8).tobytes().strip(b" ")
    if not joined:
        return 0
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n_words = len(spaces) + 1
    size = min(size, n_words)
    starts = np.concatenate(([0], spaces[: n_words - size] + 1)).tolist()
    ends = np.concatenate((spaces[size - 1 :], [len(joined)])).tolist()
    digest, set_in = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), BLOCK):
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, BITS // 8), axis=1)
        set_in += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * set_in > len(starts)).tobytes(), "big")


def majority(raw: bytes) -> int:
    """The fingerprint of shingles whose XXH64 stand one after the other in ``raw``."""
    each = np.frombuffer(raw, np.uint8).reshape(-1, BITS // 8)
    set_in = np.zeros(BITS, np.int64)
    for at in range(0, len(each), BLOCK):
        set_in += np.unpackbits(each[at : at + BLOCK], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * set_in > len(each)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Rows ``(doc_id, fp)`` for each row of ``docs (doc_id, text)``; fp is the fingerprint as a
    signed long. Each text is read whole, one after the other."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(hashed, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each of the fewest segments of which one differs in one bit at most."""
    if not 0 <= max_bits <= 15:
        raise ValueError("max_bits must be between 0 and 15")
    n = max_bits // 2 + 1
    bounds = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def _mask(low: int, width: int) -> int:
    return signed(((1 << width) - 1) << low)


def variants(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows ``(wild, rest, fp, ...)``: each fingerprint once for every bit, which is the only one set
    in ``wild``, with what is left of the bit's segment when that bit is left out."""
    each = [
        F.struct(
            F.lit(signed(1 << bit)).alias("wild"),
            F.col("fp").bitwiseAND(F.lit(_mask(low, width) & signed(~(1 << bit) % (1 << BITS)))).alias("rest"),
        )
        for low, width in segments(max_bits)
        for bit in range(low, low + width)
    ]
    others = [c for c in fps.columns if c != "fp"]
    return fps.select("fp", *others, F.explode(F.array(*each)).alias("v")).select("v.wild", "v.rest", "fp", *others)


def _first_meeting(differing: Column, wild: Column, max_bits: int) -> Column:
    """Whether a pair meets for the first time in the variant ``wild``, so that it is found once:
    in its first segment with at most one differing bit, at that bit or the segment's lowest."""
    out = F.lit(False)
    earlier = F.lit(True)
    for low, width in segments(max_bits):
        part = differing.bitwiseAND(F.lit(_mask(low, width)))
        here = wild.bitwiseAND(F.lit(_mask(low, width))) != 0
        out = out | (here & earlier & ((part == wild) | ((part == 0) & (wild == signed(1 << low)))))
        earlier = earlier & (F.bit_count(part) > 1)
    return out


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """All links ``(a, b)`` between distinct fingerprints of ``fps (fp, part)`` with at most
    ``max_bits`` differing bits, but those between two of the same ``part``. The check is part of
    the join, so that chance meetings never become rows."""
    index = variants(fps, max_bits)
    left, right = index.alias("l"), index.alias("r")
    differing = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    met = (
        (F.col("l.wild") == F.col("r.wild"))
        & (F.col("l.rest") == F.col("r.rest"))
        & (F.col("l.fp") < F.col("r.fp"))
        & (F.col("l.part") != F.col("r.part"))
        & (F.bit_count(differing) <= max_bits)
        & _first_meeting(differing, F.col("l.wild"), max_bits)
    )
    return left.join(right, met).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))


def star_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links of fingerprints with the smallest one of each variant they have, where close enough."""
    index = variants(fps, max_bits)
    least = index.groupBy("wild", "rest").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
    near = skew_join(index, least, ["wild", "rest"])
    near = near.where((F.col("fp") != F.col("least")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= max_bits))
    return near.select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def linked(fps: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct fingerprints of ``fps (fp)`` which links connect: those
    of a star and those between its groups, not all of a large family."""
    star = scratch.settle("star-links", star_links(fps, max_bits))
    parts = components(star, Scratch(scratch.spark, "simhash-star")).toDF("fp", "part")
    parts = fps.join(parts, "fp", "left").select("fp", F.coalesce("part", "fp").alias("part"))
    return star.unionByName(links(scratch.settle("parts", parts), max_bits))


def near_duplicates(docs: DataFrame, *, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows ``(doc_id, fp, component_id)`` for each row of ``docs (doc_id, text)``.

    Documents are linked when their fingerprints differ in at most ``max_bits`` bits; component_id
    is the smallest doc_id that links reach, the document's own included. Equal fingerprints are one
    node, so copies cost one row each. Links are found in two steps: fingerprints are first linked
    with the smallest of each variant and grouped; the full join then only looks for links between
    different groups, so a large family of close fingerprints doesn't give all its pairs. Both are
    exact together: a link inside a group changes nothing.

    Null and empty texts have fingerprint zero; rows that repeat a doc_id are answered each; a null
    doc_id belongs to its component but never names it; an empty table gives no rows; other columns
    are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.settle("fingerprints", fingerprints(docs, size))
    nodes = scratch.settle("nodes", rows.groupBy("fp").agg(F.min("doc_id").alias("least_doc")))
    grouped = components(star_links(nodes.select("fp"), max_bits), scratch)
    grouped = _with_component(nodes, grouped, "part")
    grouped = scratch.settle("grouped", grouped)
    between = links(grouped.select("fp", "part"), max_bits)
    # Groups of groups: a link between fingerprints links their groups.
    between = scratch.settle("between", between)
    part = grouped.select(F.col("fp").alias("a"), F.col("part").alias("pa"))
    other = grouped.select(F.col("fp").alias("b"), F.col("part").alias("pb"))
    joined = between.join(part, "a").join(other, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
    merged = components(joined, Scratch(docs.sparkSession, "simhash-groups"))
    merged = skew_join(grouped.withColumnRenamed("part", "node"), merged, ["node"], "left")
    merged = merged.select("fp", "least_doc", F.coalesce("component", "node").alias("component"))
    merged = scratch.settle("merged", merged)
    least = merged.groupBy("component").agg(F.min("least_doc").alias("component_id"))
    merged = scratch.settle("classes", skew_join(merged, least, ["component"]).select("fp", "component_id"))
    # Whoever asks for the result plans this join.
    return skew_join(rows, merged.hint("merge"), ["fp"]).select("doc_id", "fp", "component_id")


def _with_component(nodes: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """Nodes with their component, which is their own fingerprint where they have no link."""
    found = found.withColumnRenamed("node", "fp")
    return nodes.join(found, "fp", "left").select("fp", "least_doc", F.coalesce("component", "fp").alias(name))


def hex_fingerprint() -> Column:
    """The column ``fp`` as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex("fp"), 16, "0"))
