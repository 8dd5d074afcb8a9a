"""What several operators share: scratch tables in the shared folder, and connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.operators.joins import skew_join

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Bytes of a batch of rows on its way to a Python worker; the JVM holds it once more.
BATCH_BYTES = 8 << 20
# Bytes of text that a Python worker takes apart at a time.
SLICE_BYTES = 2 << 20
_own_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where no folder is set and the session is
    local, as in tests, a temporary one is made once and set as the checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        base = _own_root.setdefault("local", tempfile.mkdtemp(prefix="llm-"))
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of at most ``BATCH_BYTES`` go to Python workers from jobs that begin inside."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """In jobs that begin inside, a side of a join is broadcast only at a size that Spark has measured. What it
    estimates before a job goes by the files' size, and may be far too low, as behind an explode; the rows
    would then be gathered on the driver."""
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = spark.conf.get(planned), spark.conf.get(measured, None)
    spark.conf.set(measured, before[1] or before[0])
    spark.conf.set(planned, "-1")
    try:
        yield
    finally:
        spark.conf.set(planned, before[0])
        if before[1] is None:
            spark.conf.unset(measured)
        else:
            spark.conf.set(measured, before[1])


class Scratch:
    """Tables an operator writes and reads back: each is computed once, lineage ends there, and a
    lost executor costs only its own tasks. ``drop`` deletes what no result reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/llm-{name}-{uuid.uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def settle(self, table: str, rows: DataFrame) -> DataFrame:
        with small_batches(self.spark), measured_broadcasts(self.spark):
            rows.write.mode("overwrite").parquet(self.path(table))
        return self.read(table, rows.schema)

    def read(self, table: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(table))

    def release(self) -> None:
        """Let Spark delete shuffle files of finished steps: it does so when the JVM has collected
        what refers to them, which a driver with little to do may never get to by itself."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: str) -> None:
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(sizes: Sequence[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Parts ``(from, to)`` of rows that hold about ``limit`` bytes each; a longer row is one alone."""
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield at, i
            at, total = i, 0
        total += size
    if at < len(sizes):
        yield at, len(sizes)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))


def key_of(*columns: Column) -> list[Column]:
    """Two 64-bit hashes that together stand for a value."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit("other half"), *columns)]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of undirected links ``(a, b)`` of any orderable type.

    Returns ``(node, component)`` with the smallest node of each component, for every node that
    has a link to another one; nulls and loops are left out. Alternating large-star and small-star
    rounds: each reduces neighbourhoods to their minimum by an aggregate that combines before the
    shuffle, so a hub is never gathered in one task; a round's links are settled in the shared
    folder, so recovery never goes back further. The number of rounds grows with the logarithm of
    the longest path.
    """
    links = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    links = links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    links = scratch.settle("links-0", links)
    seen, turn = _digest(links), 0
    while seen[0]:
        turn += 1
        # Large star: the larger neighbours of a node move to the smallest of all around it.
        both = links.unionByName(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m"))
        large = skew_join(both, least, ["v"]).where("u > v")
        large = large.select(F.col("u").alias("v"), F.least("m", "v").alias("u")).distinct()
        large = scratch.settle(f"large-{turn}", large)
        # Small star: a node and its smaller neighbours move to the smallest of them.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = skew_join(large, least, ["v"]).where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        small = small.unionByName(least.select("v", F.col("m").alias("u"))).distinct()
        small = scratch.settle(f"links-{turn}", small)
        scratch.drop(f"links-{turn - 1}", f"large-{turn}")
        links, before = small, seen
        seen = _digest(links)
        if seen == before:
            break
    roots = links.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return links.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots)


def _digest(links: DataFrame) -> tuple:
    """Count and an order-free sum of a set of links: equal when the set hasn't changed."""
    parts = [F.sum(h.cast("decimal(38,0)")) for h in key_of(F.col("v"), F.col("u"))]
    return tuple(links.agg(F.count("*"), *parts).first())
