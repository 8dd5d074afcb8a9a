"""Near duplicates by the Jaccard similarity of word shingles: candidates by SimHash and by bands, each
verified.

Two texts are linked when they share at least ``LEAST`` of their distinct 5-word shingles. SimHash
fingerprints of these shingles and their deletion variants (``simhash``) give the closest pairs; at a
similarity of 0.8 most pairs differ in more bits than any such index can find. So a text also has
BANDS keys, each from the minima of ROWS permutations of its shingles, and two texts with
similarity s have a key in common with probability 1 - (1 - s**ROWS)**BANDS: 99.994 % at 0.8, more
above. What meets is compared by the XXH64 of all shingles, so no link is wrong.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm import simhash
from driftmark.llm.common import Scratch, components, key_of
from driftmark.operators.joins import skew_join

SHINGLE, SEED = 5, 42
# The least similarity, as a fraction of whole numbers.
LEAST = (4, 5)
BANDS, ROWS = 32, 6
# Shingles whose permutations are computed at once.
BLOCK = 512
_rng = np.random.default_rng(SEED)
_FLIP = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
_TIMES = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
_FOLD = _rng.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) | np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, BANDS, np.uint64)


def shingles(text: str | None, size: int = SHINGLE) -> list[bytes]:
    """Word shingles of a text, as in ``simhash.fingerprint``: words are parted by ASCII blanks, A-Z
    is lower-cased; fewer words than ``size`` make one shingle, no words none."""
    words = (text or "").encode().lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def _hashes(text: str | None) -> bytes:
    """XXH64 of every shingle of a text, repeats included."""
    digest = xxhash.xxh64_digest
    return b"".join([digest(s, SEED) for s in shingles(text)])


def _keys(found: np.ndarray) -> np.ndarray:
    """The key of each band, from the distinct hashes of a text's shingles."""
    low = found.astype(np.uint32)
    least = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    for at in range(0, len(low), BLOCK):
        np.minimum(least, ((low[at : at + BLOCK] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    keys = (least.reshape(BANDS, ROWS).astype(np.uint64) * _FOLD).sum(axis=1) + _BAND
    return keys.view(np.int64)


def signature(text: str | None) -> tuple[int, np.ndarray]:
    """Number of distinct shingles, and the key of each band; no words have no keys."""
    return _sketch(text)[:2]


def _sketch(text: str | None) -> tuple[int, np.ndarray, int]:
    """The signature of a text and the SimHash fingerprint of the same shingles, as a signed number."""
    raw = _hashes(text)
    if not raw:
        return 0, np.empty(0, np.int64), 0
    found = np.unique(np.frombuffer(raw, np.uint64))
    return len(found), _keys(found), simhash.signed(simhash.majority(raw))


def signatures(rows: DataFrame) -> DataFrame:
    """Rows ``(doc_id, h1, h2, n, keys, fp)`` for each row of ``rows (doc_id, h1, h2, text)``."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_sketch(t.as_py()) for t in batch.column(3)]
            counts, fps = (pa.array([f[i] for f in found], pa.int64()) for i in (0, 2))
            keys = pa.array([f[1] for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], counts, keys, fps], ["doc_id", "h1", "h2", "n", "keys", "fp"])

    kind = dict(rows.dtypes)["doc_id"]
    rows = rows.select("doc_id", "h1", "h2", "text")
    return rows.mapInArrow(signed, f"doc_id {kind}, h1 long, h2 long, n long, keys array<long>, fp long")


def _near_sizes(n, m):
    """Sets whose sizes differ by more can't be alike."""
    return (n * LEAST[1] >= m * LEAST[0]) & (m * LEAST[1] >= n * LEAST[0])


def _alike(both, n, m):
    """Whether sets of n and m that have ``both`` in common have ``LEAST`` of their union in common."""
    return both * (LEAST[0] + LEAST[1]) >= (n + m) * LEAST[0]


def fingerprint_pairs(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of nodes by SimHash and its deletion variants: each node with the smallest one of its
    fingerprint, and the smallest ones of fingerprints that differ in ``simhash.MAX_BITS`` bits at
    most. Only candidates: most pairs at a similarity of ``LEAST`` differ in more."""
    fps = scratch.settle("fps", nodes.groupBy("fp").agg(F.min("node").alias("least")))
    met = simhash.linked(fps.select("fp"), scratch)
    met = skew_join(met, fps.toDF("a", "na"), ["a"])
    met = skew_join(met, fps.toDF("b", "nb"), ["b"]).select(F.col("na").alias("a"), F.col("nb").alias("b"))
    equal = skew_join(nodes.select("fp", "node"), fps, ["fp"]).where("node <> least")
    return met.unionByName(equal.select(F.col("node").alias("a"), F.col("least").alias("b")))


def shared_keys(nodes: DataFrame) -> DataFrame:
    """Rows ``(node, n, key, met)`` of the keys that several nodes have, with their number."""
    index = nodes.select("node", "n", F.explode("keys").alias("key"))
    met = index.groupBy("key").agg(F.count("*").alias("met")).where("met > 1")
    return skew_join(index, met, ["key"])


def star_pairs(index: DataFrame) -> DataFrame:
    """Pairs of nodes with one node of each key they have, where the sizes allow a link. That one meets
    the most nodes over all its keys, so among copies of a text with changes the text itself, if it
    is there, which is nearer to each copy than they are to each other."""
    weight = index.groupBy("node").agg(F.sum("met").alias("weight"))
    weighed = skew_join(index, weight, ["node"])
    hubs = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("back"), "n")).alias("hub"))
    hubs = hubs.select("key", (-F.col("hub.back")).alias("b"), F.col("hub.n").alias("m"))
    met = skew_join(index, hubs, ["key"]).where("node <> b").where(_near_sizes(F.col("n"), F.col("m")))
    return met.select(F.col("node").alias("a"), "b").distinct()


def shingle_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows ``(node, n, hashes)`` of the nodes in ``wanted (node)``: the hashes of their distinct
    shingles. Each text is read where it lies, and only those of wanted nodes move."""
    wanted = skew_join(nodes.select("node", "least_doc", F.col("h1").alias("w1"), F.col("h2").alias("w2")), wanted.distinct(), ["node"])
    # One row of each node: the first of its copies, and of equal rows any.
    own = F.col("doc_id").eqNullSafe(F.col("least_doc"))
    texts = docs.join(wanted, (F.col("h1") == F.col("w1")) & (F.col("h2") == F.col("w2")) & own)
    texts = texts.select("node", "text").dropDuplicates(["node"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.frombuffer(bytearray(_hashes(t.as_py())), np.int64)) for t in batch.column(1)]
            sizes = pa.array([len(f) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(found, pa.list_(pa.int64()))], ["node", "n", "hashes"])

    return texts.mapInArrow(hashed, "node long, n long, hashes array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose texts are alike, by all their shingles."""
    met = skew_join(pairs, sets.toDF("a", "na", "ha"), ["a"])
    met = skew_join(met, sets.toDF("b", "nb", "hb"), ["b"])
    return met.where(_alike(F.size(F.array_intersect("ha", "hb")), F.col("na"), F.col("nb"))).select("a", "b")


def cross_pairs(index: DataFrame, part: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of nodes of different ``part`` that may be alike, among the nodes with a key that several
    parts have: all links between them, and few other pairs.

    The pairs of a key aren't built, which are as many as the square of the nodes that have it. A
    node's shingles are ordered by the number of nodes that have them, the rarest first. From a
    shingle on, a node has only ``rest`` that another has too; two nodes that are alike have a first
    shingle in common, behind which both still have enough, so they meet at one that can be it.
    """
    index = skew_join(index.select("node", "key"), part, ["node"])
    mixed = index.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q")
    mixed = skew_join(index, mixed.select("key"), ["key"]).select("node", "part").distinct()
    mixed = scratch.settle("mixed", skew_join(sets, mixed, ["node"]))
    each = mixed.select("node", F.explode("hashes").alias("hash"))
    shared = each.groupBy("hash").agg(F.count("*").alias("met")).where("met > 1")
    each = skew_join(each, shared, ["hash"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("met", "hash"))).alias("each"))
    each = skew_join(mixed.select("node", "n", "part"), each, ["node"])
    each = each.select("node", "n", "part", F.size("each").alias("size"), F.posexplode("each").alias("at", "it"))
    each = each.select("node", "n", "part", (F.col("size") - F.col("at")).alias("rest"), "it.hash")
    # Behind it there is enough for a link with a set of the same shingles.
    each = scratch.settle("prefix", each.where(F.col("rest") * LEAST[1] >= F.col("n") * LEAST[0]))
    left, right = each.alias("l"), each.alias("r")
    enough = _alike(F.least("l.rest", "r.rest"), F.col("l.n"), F.col("r.n"))
    met = (F.col("l.hash") == F.col("r.hash")) & (F.col("l.node") < F.col("r.node")) & (F.col("l.part") != F.col("r.part")) & enough
    return left.join(right, met).select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, component_id)`` for each row of ``docs (doc_id, text)``.

    Documents are linked when their shingles are alike; component_id is the smallest doc_id that
    links reach, the document's own included. Equal texts are one node. Links are found in two
    steps, as in ``simhash.near_duplicates``: nodes are first compared with one node of each key and of
    each fingerprint and grouped, then only nodes of different groups are compared.

    Texts without words are alike; rows that repeat a doc_id are answered each; a null doc_id belongs
    to its component but never names it; an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    text = F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text")).otherwise(F.lit(""))
    docs = docs.select("doc_id", text.alias("text"))
    docs = docs.withColumns(dict(zip(("h1", "h2"), key_of(F.col("text")))))
    rows = scratch.settle("rows", signatures(docs))
    nodes = rows.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("least_doc"), *[F.first(c).alias(c) for c in ("n", "keys", "fp")]
    )
    # The numbers are settled, so they stay with their nodes.
    nodes = scratch.settle("nodes", nodes.withColumn("node", F.monotonically_increasing_id()))
    rows = rows.select("doc_id", "h1", "h2")
    pairs = scratch.settle("by-fingerprint", fingerprint_pairs(nodes, scratch))
    scratch.release()
    index = scratch.settle("index", shared_keys(nodes))
    pairs = scratch.settle("star-pairs", pairs.unionByName(star_pairs(index)).distinct())
    wanted = index.select("node").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    sets = scratch.settle("sets", shingle_sets(wanted, nodes, docs))
    links = scratch.settle("star", verified(pairs, sets))
    grouped = components(links, Scratch(docs.sparkSession, "jaccard-star")).withColumnRenamed("component", "part")
    grouped = nodes.select("node", "h1", "h2", "least_doc").join(grouped, "node", "left")
    grouped = scratch.settle("grouped", grouped.withColumn("part", F.coalesce("part", "node")))
    part = grouped.select("node", "part")
    pairs = scratch.settle("cross-pairs", cross_pairs(index, part, sets, scratch))
    links = scratch.settle("cross", verified(pairs, sets))
    scratch.drop("index", "sets", "mixed", "prefix")
    # Groups of groups: a link between nodes links their groups.
    links = skew_join(links, part.toDF("a", "pa"), ["a"])
    links = skew_join(links, part.toDF("b", "pb"), ["b"]).select(F.col("pa").alias("a"), F.col("pb").alias("b"))
    merged = components(links, Scratch(docs.sparkSession, "jaccard-cross")).withColumnRenamed("node", "part")
    merged = skew_join(grouped.select("h1", "h2", "least_doc", "part"), merged, ["part"], "left")
    merged = scratch.settle("merged", merged.select("h1", "h2", "least_doc", F.coalesce("component", "part").alias("component")))
    least = merged.groupBy("component").agg(F.min("least_doc").alias("component_id"))
    merged = scratch.settle("classes", skew_join(merged, least, ["component"]).select("h1", "h2", "component_id"))
    # Whoever asks for the result plans this join.
    return skew_join(rows, merged.hint("merge"), ["h1", "h2"]).select("doc_id", "component_id")
