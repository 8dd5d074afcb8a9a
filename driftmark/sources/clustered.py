"""States clustered by their parent, with a digest of every cluster kept beside them.

A row's cluster is a hash of its parent, that is of its key without its own name. All that a
difference compares has one parent: versions of a key, and the names that share an MD5. So a state is
written as a bucketed table of this column, all snapshots in one table. Both snapshots of a
comparison are then a single scan whose partitioning every group and join of the difference can use:
nothing has to be exchanged.

With each snapshot goes a table of digests: rows per cluster and order-free sums of their hashes. A
cluster whose digests are equal holds the same rows, so it has no changes, unless it is restless: the
rules report rows without a full key on every run, and, without ``collision_safe``, keys with several
MD5s and names that share one as well. Only clusters that differ or are restless are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmark.operators.diff import MD5, has_key, versions_in

CLUSTER = "cluster"
# Clusters for each bucket, so that buckets come out alike and digests tell more than files.
CLUSTERS_PER_BUCKET = 16
# A task compares one bucket of two states; so many rows of a state keep it within a few hundred MB.
ROWS_PER_BUCKET, LEAST_BUCKETS = 150_000, 16

DIGEST_SCHEMA = T.StructType(
    [
        T.StructField("snapshot_id", T.IntegerType()),
        T.StructField("buckets", T.IntegerType()),
        T.StructField(CLUSTER, T.IntegerType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("h1", T.DecimalType(38, 0)),
        T.StructField("h2", T.DecimalType(38, 0)),
        T.StructField("restless", T.LongType()),
    ]
)
_MEASURES = ("n_rows", "h1", "h2", "restless")


def buckets_for(n_rows: int) -> int:
    """Buckets for a state of so many rows: a task's share stays the same as states grow."""
    return max(LEAST_BUCKETS, -(-n_rows // ROWS_PER_BUCKET))


@contextmanager
def co_partitioned(spark: SparkSession) -> Iterator[None]:
    """Lets joins use a partitioning by a part of their keys, for what is planned inside."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class BucketedTable:
    """A table over a folder, bucketed by cluster; the catalog entry is made again wherever it is
    missing, so the folder can be opened by any session."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, buckets: int, *, by_snapshot: bool):
        self.spark, self.path, self.schema, self.buckets, self.by_snapshot = spark, path, schema, buckets, by_snapshot
        self.name = f"driftmark_{hashlib.md5(path.encode()).hexdigest()[:16]}_{buckets}"

    def ensure(self) -> None:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        parted = "PARTITIONED BY (snapshot_id)" if self.by_snapshot else ""
        place = self.path.replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet {parted} "
            f"CLUSTERED BY ({CLUSTER}) SORTED BY ({CLUSTER}) INTO {self.buckets} BUCKETS LOCATION '{place}'"
        )
        if self.by_snapshot:
            self.spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def write(self, rows: DataFrame, snapshot_id: int | None = None) -> None:
        """Replace what the table holds, or what it holds of the snapshot."""
        self.ensure()
        part = "" if snapshot_id is None else f"PARTITION (snapshot_id={int(snapshot_id)})"
        columns = ", ".join(f"`{n}`" for n in self.schema.names if snapshot_id is None or n != "snapshot_id")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} {part} SELECT {columns} FROM {{rows}}", rows=rows)

    def read(self) -> DataFrame:
        self.ensure()
        return self.spark.table(self.name)

    def forget(self) -> None:
        """Drop the catalog entry; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


class ClusteredStates:
    """The staged states of one level: a bucketed table and the digests of its clusters."""

    def __init__(self, spark: SparkSession, root: str, table: str, schema: T.StructType, keys: Sequence[str], buckets: int, *, collision_safe: bool):
        self.spark, self.keys, self.buckets, self.collision_safe = spark, list(keys), buckets, collision_safe
        fields = [f for f in schema.fields if f.name != "snapshot_id"]
        fields += [T.StructField(CLUSTER, T.IntegerType()), T.StructField("snapshot_id", T.IntegerType())]
        self.states = BucketedTable(spark, f"{root}/{table}", T.StructType(fields), buckets, by_snapshot=True)
        self.digest_path = f"{root}/digest_{table}"

    def write(self, snapshot_id: int, rows: DataFrame) -> None:
        """Stage the rows of a snapshot and the digests of their clusters. Rows go to the buckets by a
        rebalancing that splits a large one among several tasks and files."""
        cluster = F.pmod(F.xxhash64(*self.keys[:-1]), F.lit(self.buckets * CLUSTERS_PER_BUCKET)).cast("int")
        self.states.write(rows.withColumn(CLUSTER, cluster).hint("rebalance", F.col(CLUSTER)), snapshot_id)
        with co_partitioned(self.spark):
            found = digest(self.read(snapshot_id), self.keys, collision_safe=self.collision_safe)
            # An empty state has a digest as well: one of no rows.
            nothing = self.spark.createDataFrame([(self.buckets, None, 0, None, None, 0)], T.StructType(DIGEST_SCHEMA.fields[1:]))
            found = found.select(F.lit(self.buckets).alias("buckets"), CLUSTER, *_MEASURES).unionByName(nothing)
            found.coalesce(1).write.mode("overwrite").parquet(f"{self.digest_path}/snapshot_id={snapshot_id}")

    def read(self, *snapshot_ids: int) -> DataFrame:
        return self.states.read().where(F.col("snapshot_id").isin(*snapshot_ids))

    def holds(self, snapshot_id: int) -> bool:
        """Whether the snapshot was staged with as many buckets; a state that wasn't has no digests
        here, and its files lie otherwise."""
        return not self.digests(snapshot_id).where(F.col("buckets") == self.buckets).isEmpty()

    def drop(self, snapshot_id: int) -> None:
        """Forget the snapshot's partition; its folders are the store's to delete."""
        self.states.ensure()
        self.spark.sql(f"ALTER TABLE {self.states.name} DROP IF EXISTS PARTITION (snapshot_id={snapshot_id})")

    def digests(self, snapshot_id: int) -> DataFrame:
        return self.spark.read.schema(DIGEST_SCHEMA).parquet(self.digest_path).where(F.col("snapshot_id") == snapshot_id)

    def to_read(self, current: int, previous: int) -> dict[int, int]:
        """Clusters that may hold changes, with their rows: at most as many as there are clusters,
        whatever the states hold."""
        sides = [self.digests(n).where(f"{CLUSTER} IS NOT NULL").select(F.col(CLUSTER), *[F.col(m).alias(f"{m}_{i}") for m in _MEASURES]) for i, n in enumerate((current, previous))]
        same = [F.col(f"{m}_0").eqNullSafe(F.col(f"{m}_1")) for m in _MEASURES]
        calm = same[0] & same[1] & same[2] & same[3] & (F.col("restless_0") == 0)
        found = sides[0].join(sides[1], CLUSTER, "full").where(~F.coalesce(calm, F.lit(False)))
        n = F.coalesce("n_rows_0", F.lit(0)) + F.coalesce("n_rows_1", F.lit(0))
        return {r.cluster: r.n for r in found.select(CLUSTER, n.alias("n")).collect()}

    def pair(self, current: int, previous: int, clusters: Sequence[int] | None = None) -> DataFrame:
        """Rows of both snapshots, the previous one's marked ``gone``; buckets without one of the given
        clusters aren't read."""
        rows = self.read(current, previous).withColumn("gone", F.col("snapshot_id") == previous)
        return rows if clusters is None else rows.where(F.col(CLUSTER).isin(*clusters))


def digest(rows: DataFrame, keys: Sequence[str], *, collision_safe: bool) -> DataFrame:
    """Rows, hash sums and restless groups of every cluster. The sums don't depend on the order, and
    add up: those of all clusters are a digest of the state."""
    *parent, name = keys
    row_hash = [F.xxhash64(F.lit(seed), *keys, MD5).cast("decimal(38,0)") for seed in ("one", "other")]
    zero = F.lit(0).cast("long")
    loose = F.sum(F.when(F.expr(has_key(keys)), 0).otherwise(1))
    parts = [rows.groupBy(CLUSTER).agg(F.count("*").alias("n_rows"), F.sum(row_hash[0]).alias("h1"), F.sum(row_hash[1]).alias("h2"), loose.alias("restless"))]
    if not collision_safe:
        found = versions_in(rows.where(f"{MD5} IS NOT NULL").withColumn("gone", F.lit(False)), [CLUSTER, *keys])
        for by in ([*parent, name], [*parent, MD5]):
            several = found.groupBy(CLUSTER, *by).count().where("count > 1").groupBy(CLUSTER).agg(F.count("*").alias("restless"))
            none = F.lit(0).cast("decimal(38,0)")
            parts.append(several.select(CLUSTER, zero.alias("n_rows"), none.alias("h1"), none.alias("h2"), "restless"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(CLUSTER).agg(*[F.sum(m).cast(DIGEST_SCHEMA[m].dataType).alias(m) for m in _MEASURES])


def settle_clustered(spark: SparkSession, folder: Callable[[str], str], buckets: int) -> tuple[Callable, Callable]:
    """A ``settle`` that keeps the clusters' partitioning, and what makes the catalog forget its tables."""
    made: list[BucketedTable] = []

    def settle(name: str, rows: DataFrame) -> DataFrame:
        table = BucketedTable(spark, folder(name), rows.schema, buckets, by_snapshot=False)
        table.forget()
        table.write(rows)
        made.append(table)
        return table.read()

    def forget() -> None:
        for table in made:
            table.forget()

    return settle, forget
