"""The tables of a snapshot history, as Parquet partitioned by snapshot.

Each table is a folder with one ``snapshot_id=<n>`` folder per snapshot, written whole and so
repeatable. The registry is written last: a snapshot that isn't registered doesn't exist for
readers, and a failed run leaves only folders to delete.
"""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmark import schemas
from driftmark.operators import lifecycle
from driftmark.operators.diff import row_columns
from driftmark.operators.joins import released_shuffles
from driftmark.operators.lifecycle import timestamp
from driftmark.operators.replay import state_at, state_digest
from driftmark.operators.reports import report_window
from driftmark.operators.routing import is_child, is_entity
from driftmark.sources.clustered import ClusteredStates, settle_clustered

REGISTRY, CHANGES, STATE_CHILD, STATE_ENTITY, METRICS, RUN_REPORT, STATE_DIGEST = (
    "registry",
    "changes",
    "state_child",
    "state_entity",
    "metrics",
    "run_report",
    "state_digest",
)
STATES = (STATE_CHILD, STATE_ENTITY)
SNAPSHOT_DATA = (*STATES, CHANGES, METRICS, RUN_REPORT, STATE_DIGEST)
# Rows are mostly text, which takes less disk than with Parquet's usual codec.
CODEC = "zstd"


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared one that the cluster names in ``spark.checkpoint.dir``, or in the
    warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    base = base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/driftmark"
    return f"{base.rstrip('/')}/driftmark-{uuid.uuid4().hex}"


class SnapshotStore:
    """Registry, change log, staged states, metrics and run reports under one root folder.

    With ``buckets`` states are staged as bucketed tables with digests, see
    :mod:`driftmark.sources.clustered`: comparing them reads only what may have changed, without an
    exchange. The session's catalog then gets an entry for each state table.
    """

    def __init__(self, spark: SparkSession, root: str, *, multi_db: bool = False, buckets: int | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.multi_db = multi_db
        tables = {
            CHANGES: schemas.CHANGES_SCHEMA,
            STATE_CHILD: schemas.STATE_SCHEMA,
            STATE_ENTITY: schemas.STATE_SCHEMA,
            METRICS: schemas.METRICS_SCHEMA,
        }
        if multi_db:
            tables = {name: schemas.with_db(schema) for name, schema in tables.items()}
        self.schemas: dict[str, T.StructType] = {
            **tables,
            REGISTRY: schemas.REGISTRY_SCHEMA,
            RUN_REPORT: schemas.RUN_REPORT_SCHEMA,
            STATE_DIGEST: schemas.STATE_DIGEST_SCHEMA,
        }
        for name in self.schemas:
            self._fs().mkdirs(self._path(name))
        self.clustered: dict[str, ClusteredStates] = {}
        if buckets:
            db = (schemas.DB,) if multi_db else ()
            for name, keys, safe in ((STATE_CHILD, schemas.CHILD_KEYS, False), (STATE_ENTITY, schemas.ENTITY_KEYS, True)):
                self._fs().mkdirs(self._path(f"digest_{name}"))
                self.clustered[name] = ClusteredStates(
                    spark, self.root, name, self.schemas[name], [*db, *keys], buckets, collision_safe=safe
                )

    # --- files -----------------------------------------------------------------------------

    def _path(self, table: str, snapshot_id: int | None = None):
        part = "" if snapshot_id is None else f"/snapshot_id={snapshot_id}"
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}{part}")

    def _fs(self):
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(conf)

    def _drop(self, table: str, snapshot_id: int) -> None:
        self._fs().delete(self._path(table, snapshot_id), True)
        if table in STATES:
            self._fs().delete(self._path(f"digest_{table}", snapshot_id), True)
        if table in self.clustered:
            self.clustered[table].drop(snapshot_id)

    def partitions(self, table: str) -> list[int]:
        """Snapshot ids that have a folder, registered or not."""
        names = [s.getPath().getName() for s in self._fs().listStatus(self._path(table))]
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("snapshot_id="))

    # --- tables ----------------------------------------------------------------------------

    def read(self, table: str) -> DataFrame:
        """All rows, with the declared schema; a filter on snapshot_id prunes folders."""
        return self.spark.read.schema(self.schemas[table]).parquet(f"{self.root}/{table}")

    def read_snapshot(self, table: str, snapshot_id: int) -> DataFrame:
        return self.read(table).where(F.col("snapshot_id") == snapshot_id)

    def write_snapshot(self, table: str, snapshot_id: int, rows: DataFrame) -> None:
        """Write a table's rows of one snapshot; writing them again replaces them. Rows of several
        databases need a store with ``multi_db``, or their keys would be mixed up."""
        if schemas.DB in rows.columns and table in (CHANGES, *STATES, METRICS) and not self.multi_db:
            raise ValueError("the rows have a source_db, but the store was opened for a single database")
        shaped = self._shaped(table, rows)
        with released_shuffles(self.spark):
            if table in self.clustered:
                self.clustered[table].write(snapshot_id, shaped)
            else:
                path = f"{self.root}/{table}/snapshot_id={snapshot_id}"
                shaped.write.mode("overwrite").parquet(path, compression=CODEC)

    def _shaped(self, table: str, rows: DataFrame) -> DataFrame:
        """Rows with the columns of a table's file."""
        columns = [f for f in self.schemas[table].fields if f.name != "snapshot_id"]
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in columns])

    def write_snapshots(self, table: str, rows: DataFrame) -> None:
        """Write a table's rows of several snapshots, told apart by their ``snapshot_id``, in one job.
        Every snapshot that has rows is replaced, others stay; so the job can be repeated. Rows are
        dealt to the tasks by snapshot, with a large one split and small ones put together."""
        if schemas.DB in rows.columns and table in (CHANGES, *STATES, METRICS) and not self.multi_db:
            raise ValueError("the rows have a source_db, but the store was opened for a single database")
        if table in self.clustered:
            raise ValueError("clustered states are staged snapshot by snapshot, with their digests")
        shaped = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schemas[table].fields])
        shaped = shaped.hint("rebalance", F.col("snapshot_id"))
        writer = shaped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        with released_shuffles(self.spark):
            writer.partitionBy("snapshot_id").parquet(f"{self.root}/{table}", compression=CODEC)

    def write_scratch(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows written and read back: cuts the lineage and lets Spark see their size."""
        path = f"{self.root}/_work/{name}"
        with released_shuffles(self.spark):
            rows.write.mode("overwrite").parquet(path, compression=CODEC)
        return self.spark.read.schema(rows.schema).parquet(path)

    def settle_clustered(self, prefix: str):
        """A ``settle`` for frames with a cluster, as bucketed scratch tables, and a function that
        makes the catalog forget them."""
        buckets = next(iter(self.clustered.values())).buckets
        return settle_clustered(self.spark, lambda name: f"{self.root}/_work/{prefix}-{name}", buckets)

    def drop_scratch(self) -> None:
        self._fs().delete(self._path("_work"), True)

    def write_state(self, table: str, snapshot_id: int, rows: DataFrame, at: datetime) -> DataFrame:
        """Stage rows and return them as stored."""
        if table == STATE_ENTITY:
            rows = rows.withColumn("object_type_name", F.coalesce("object_type_name", F.lit("")))
        self.write_snapshot(table, snapshot_id, rows.withColumn("processed_time", timestamp(at)))
        return self.read_snapshot(table, snapshot_id)

    def write_digests(self, snapshot_id: int) -> None:
        """Keep digests of the staged states, which outlive them."""
        levels = [state_digest(self.read_snapshot(t, snapshot_id)).withColumn("level", F.lit(t)) for t in STATES]
        self.write_snapshot(STATE_DIGEST, snapshot_id, levels[0].unionByName(levels[1]).coalesce(1))

    def rebuilt_state(self, table: str, snapshot_id: int) -> DataFrame:
        """Rows of a state that isn't staged any more, from the log; see :mod:`driftmark.operators.replay`."""
        log = self.read(CHANGES)
        keys = schemas.CHILD_KEYS if table == STATE_CHILD else schemas.ENTITY_KEYS
        if snapshot_id == self.read(REGISTRY).agg(F.min("snapshot_id")).first()[0]:
            # A baseline logs every row once and stages it where it belongs, some rows twice.
            rows = self.read_snapshot(CHANGES, snapshot_id)
            return rows.where(is_child() if table == STATE_CHILD else is_entity()).select(*row_columns(rows))
        level = log.where(F.col("object_subtype").isNotNull() if table == STATE_CHILD else F.col("object_subtype").isNull())
        keys = [*([schemas.DB] if self.multi_db else []), *keys]
        return state_at(
            level, keys, snapshot_id, collision_safe=table == STATE_ENTITY, settle=lambda n, df: self.write_scratch(f"{n}-{table}", df)
        )

    def restage(self, snapshot_id: int) -> None:
        """Stage a registered snapshot's states again from the log. An error, and nothing staged, where
        the rebuilt states don't have the digests that were kept."""
        at = self.read_snapshot(REGISTRY, snapshot_id).first().processed_time
        kept = {r.level: (r.n_rows, r.h1, r.h2) for r in self.read_snapshot(STATE_DIGEST, snapshot_id).collect()}
        try:
            for table in STATES:
                rows = self.write_scratch(f"rebuilt-{table}", self.rebuilt_state(table, snapshot_id))
                if kept.get(table) != tuple(state_digest(rows).first()):
                    raise RuntimeError(f"the log doesn't give back the {table} of snapshot {snapshot_id}; stage it again first")
                self.write_state(table, snapshot_id, rows, at)
        except BaseException:
            for table in STATES:
                self._drop(table, snapshot_id)
            raise
        finally:
            self.drop_scratch()

    def write_changes(self, snapshot_id: int, changes: DataFrame, at: datetime) -> DataFrame:
        """Append a snapshot's change rows and return them as stored."""
        self.write_snapshot(CHANGES, snapshot_id, changes.withColumn("processed_time", timestamp(at)))
        return self.read_snapshot(CHANGES, snapshot_id)

    def write_pending_changes(self, snapshot_id: int, changes: DataFrame, at: datetime) -> DataFrame:
        """Change rows as :meth:`write_changes` stores them, but not in the log yet."""
        rows = self._shaped(CHANGES, changes.withColumn("processed_time", timestamp(at)))
        return self.write_scratch(f"pending-{snapshot_id}", rows)

    def log_pending_changes(self, snapshot_id: int) -> DataFrame:
        """Put the change rows that are pending into the log, without a second copy of them."""
        pending, path = self._path(f"_work/pending-{snapshot_id}"), self._path(CHANGES, snapshot_id)
        self._fs().delete(path, True)
        if not self._fs().rename(pending, path):
            raise RuntimeError(f"the change rows of snapshot {snapshot_id} could not be moved to the log")
        return self.read_snapshot(CHANGES, snapshot_id)

    def upsert_metrics(self, snapshot_id: int, metrics: DataFrame, at: datetime) -> DataFrame:
        """Insert metrics or replace those of the same name; others of the snapshot stay."""
        fresh = metrics.drop("snapshot_id").withColumn("metrics_time", timestamp(at))
        if snapshot_id in self.partitions(METRICS):
            key = [c for c in (schemas.DB, "metric_name") if c in fresh.columns]
            kept = self.read_snapshot(METRICS, snapshot_id).drop("snapshot_id")
            kept = kept.join(fresh.select(*key).distinct(), key, "left_anti")
            # The partition can't be read while it is replaced.
            fresh = self.write_scratch(f"metrics-{snapshot_id}", kept.unionByName(fresh))
        self.write_snapshot(METRICS, snapshot_id, fresh)
        return self.read_snapshot(METRICS, snapshot_id)

    def window(self, start: datetime, end: datetime) -> DataFrame:
        """Log rows of the snapshots registered from ``start`` to ``end``; other folders aren't read."""
        return report_window(self.read(CHANGES), start, end, self.read(REGISTRY))

    # --- registry --------------------------------------------------------------------------

    def latest(self) -> int | None:
        """The newest registered snapshot."""
        return lifecycle.latest_snapshot(self.read(REGISTRY)).first()[0]

    def previous(self, snapshot_id: int) -> int | None:
        """The newest registered snapshot before the given one."""
        return lifecycle.prev_snapshot(self.read(REGISTRY), snapshot_id).first()[0]

    def is_initial(self) -> bool:
        return lifecycle.is_initial(self.read(REGISTRY)).first()[0]

    def next_snapshot(self, at: datetime) -> tuple[int, str]:
        """Id and name of the next snapshot."""
        row = lifecycle.next_snapshot(self.read(REGISTRY), timestamp(at)).first()
        return row.snapshot_id, row.snapshot_name

    def register(self, snapshot_id: int, name: str, at: datetime) -> None:
        """Make a snapshot visible."""
        row = self.spark.createDataFrame([(snapshot_id, name, at)], schemas.REGISTRY_SCHEMA)
        self.write_snapshot(REGISTRY, snapshot_id, row.coalesce(1))

    def ran_on(self, day: date) -> bool:
        """Whether a snapshot was registered on the day."""
        return lifecycle.ran_on(self.read(REGISTRY), F.lit(day)).first()[0]

    # --- life cycle ------------------------------------------------------------------------

    def staged_state(self, table: str) -> DataFrame:
        """Staged rows of the newest registered snapshot."""
        return lifecycle.staged_state(self.read(REGISTRY), self.read(table))

    def retain_latest(self, keep: int) -> None:
        """Drop the staged rows of every snapshot but one."""
        for table in STATES:
            for n in self.partitions(table):
                if n != keep:
                    self._drop(table, n)

    def rollback(self, snapshot_id: int) -> None:
        """Remove a snapshot from every table, from the registry first."""
        for table in (REGISTRY, *SNAPSHOT_DATA):
            self._drop(table, snapshot_id)

    def latest_change_count(self) -> int:
        """Log rows of the newest snapshot, UNCHANGED ones left out."""
        return lifecycle.latest_change_count(self.read(REGISTRY), self.read(CHANGES)).first()[0]

    def has_orphans(self) -> bool:
        """Whether rows are left in a store without a registered snapshot."""
        tables = [self.read(t) for t in (CHANGES, METRICS, *STATES)]
        return lifecycle.has_orphans(self.read(REGISTRY), *tables).first()[0]

    def clean_orphans(self, *, allow: bool = False) -> None:
        """Empty the data tables of a store without a registered snapshot; refuses by default."""
        if not self.has_orphans():
            return
        if not allow:
            raise RuntimeError("the store has rows but no registered snapshot; cleanup was not allowed")
        for table in SNAPSHOT_DATA:
            for n in self.partitions(table):
                self._drop(table, n)
