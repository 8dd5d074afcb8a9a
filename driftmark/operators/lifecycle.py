"""What a run asks its registry and log, each answer a one-row DataFrame."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.operators.metrics import copies, real_changes


def timestamp(at: datetime) -> Column:
    """A fixed time as a column, the same in every task and retry."""
    return F.to_timestamp_ntz(F.lit(at.strftime("%Y-%m-%d %H:%M:%S.%f")))


def next_snapshot(registry: DataFrame, at: Column) -> DataFrame:
    """Id, name and time of the next snapshot. The id is one above the newest, so the id of a
    snapshot that was rolled back is used again."""
    n = F.coalesce(F.max("snapshot_id"), F.lit(0)) + 1
    return (
        registry.agg(n.alias("snapshot_id"))
        .withColumn("processed_time", at)
        .select(
            "snapshot_id",
            F.concat_ws(
                "_", F.lit("snapshot"), "snapshot_id", F.date_format("processed_time", "yyyy_MM_dd_HHmmss")
            ).alias("snapshot_name"),
            "processed_time",
        )
    )


def latest_snapshot(registry: DataFrame) -> DataFrame:
    return registry.agg(F.max("snapshot_id").alias("snapshot_id"))


def prev_snapshot(registry: DataFrame, snapshot_id: int | Column) -> DataFrame:
    """The newest snapshot before the given one."""
    return latest_snapshot(registry.where(F.col("snapshot_id") < snapshot_id))


def is_initial(registry: DataFrame) -> DataFrame:
    return registry.agg((F.count(F.lit(1)) == 0).alias("is_initial"))


def ran_on(registry: DataFrame, day: Column) -> DataFrame:
    """Whether a snapshot is dated the given day."""
    hit = F.coalesce(F.to_date("processed_time") == day, F.lit(False))
    return registry.agg((F.count_if(hit) > 0).alias("ran_on"))


def latest_change_count(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """Log rows of the newest registered snapshot, UNCHANGED ones left out."""
    newest = latest_snapshot(registry).scalar()
    rows = real_changes(changes).where(F.col("snapshot_id") == newest)
    return rows.agg(F.coalesce(F.sum(copies(rows)), F.lit(0).cast("long")).alias("change_count"))


def staged_state(registry: DataFrame, staged: DataFrame) -> DataFrame:
    """Staged rows of the newest registered snapshot; other partitions aren't read."""
    return staged.where(F.col("snapshot_id") == latest_snapshot(registry).scalar())


def has_orphans(registry: DataFrame, *tables: DataFrame) -> DataFrame:
    """Whether a table has rows although nothing is registered. One row per table is looked at."""
    out = is_initial(registry)
    found = F.lit(False)
    for table in tables:
        found = found | (table.limit(1).agg(F.count(F.lit(1))).scalar() > 0)
    return out.select((F.col("is_initial") & found).alias("has_orphans"))
